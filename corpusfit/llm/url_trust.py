"""URL filter: explicit rules, and trust spread over the graph of hosts for everything that no rule names.

Rules name a host (with all its subdomains) and the beginning of a path; the longest one that fits decides. Hosts without a rule
are judged by two personalised PageRanks over host edges: trust starts at trusted hosts and follows links, distrust
starts at blocked hosts and goes against them (who links to a bad host is suspect). Blocked hosts without a rule are blocked.
Any other host is blocked when its distrust exceeds ``times`` its trust by more than ``least_distrust``, all in masses of one
seed of their kind, so a verdict does not depend on how many other hosts are blocked or trusted.

Host edges are counted per pair of hosts: absolute links and named hosts in the pages' HTML, and a host's parent domain
where that is a host of the table too. Seeds are the hosts of rules that cover whole hosts, and those of two given lists.

All steps are joins and sums by host, pre-aggregated in the map tasks; ranks are written to the shared folder every few
rounds, where the loop also looks whether they still move. Nothing about hosts is brought to the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; pages without HTML give no links; a
host without links or seeds has ranks 0 and is allowed; repeated pages count as often as they occur; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host after a scheme, or named after the copyright sign.
MENTION = r"(?:://|&copy;\s{0,4})((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"


@dataclass(frozen=True)
class Settings:
    follow: float = 0.7
    rounds_between_looks: int = 5
    settled: float = 1e-3
    times: float = 1.0
    #: In masses of one blocked seed.
    least_distrust: float = 1e-3


def located(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` and the page's HTML."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"), F.col("html"))


def _suffixes(host: Column, most: int) -> Column:
    """A host and its parent domains, as far as they have at most ``most`` labels."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.array_join(F.slice(parts, -n, n), "."))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules of each host, the first that fits a path being the one that decides."""
    named = rules.select(
        F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start"), "rule", "verdict")
    own = F.struct(
        (-F.length("rule")).alias("by_length"), (-F.length("suffix")).alias("by_host"), (F.col("verdict") == "allow").alias("soft"),
        "start", "rule", "verdict")
    # No longer suffix can be a rule's, so a host of very many labels is cut into few.
    most = named.agg(F.max(F.size(F.split("suffix", r"\.", -1)))).first()[0] or 1
    return (
        hosts.select("host", F.explode(_suffixes(F.col("host"), most)).alias("suffix")).where("suffix <> ''")
        .join(named, "suffix").groupBy("host").agg(F.sort_array(F.collect_set(own)).alias("rules")))


def host_edges(places: DataFrame, hosts: DataFrame) -> DataFrame:
    """``source, target, pages`` without loops."""
    mentioned = F.array_distinct(F.transform(
        F.regexp_extract_all(F.col("html"), F.lit(MENTION), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = places.where("host <> '' and html is not null").select(F.col("host").alias("source"), F.explode(mentioned).alias("target"))
    parents = hosts.where("host <> ''").select(F.col("host").alias("source"), F.expr("substring(host, instr(host, '.') + 1)").alias("target"))
    parents = parents.join(hosts.select(F.col("host").alias("target")), "target", "left_semi").select("source", "target")
    return links.union(parents).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("pages"))


def _in_domains(host: Column, domains: Sequence[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def _totals(seeds: DataFrame) -> DataFrame:
    """``kind, all``: the mass of all seeds of a kind."""
    return seeds.groupBy("kind").agg(F.sum("mass").alias("all"))


def ranks(edges: DataFrame, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``kind, host, rank``: personalised PageRank of seeds (``kind, host, mass``) along the edges of their kind.

    Edges are ``kind, source, target, pages``. Masses of a kind are scaled to a sum of 1; rank that reaches a host without
    edges ends there.
    """
    total = _totals(seeds)
    start = cut_lineage(seeds.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass")))
    out = edges.groupBy("kind", "source").agg(F.sum("pages").alias("all"))
    shares = cut_lineage(edges.join(out, ["kind", "source"]).select(
        "kind", F.col("source").alias("host"), "target", (F.col("pages") / F.col("all")).alias("share")))
    state = start.withColumnRenamed("mass", "rank")
    base = start.select("kind", "host", (F.col("mass") * (1 - settings.follow)).alias("rank"))
    # What still moves falls by ``follow`` a round, so this ends.
    while True:
        before = state
        for _ in range(settings.rounds_between_looks):
            moved = shares.join(state, ["kind", "host"]).select(
                "kind", F.col("target").alias("host"), (F.col("rank") * F.col("share") * settings.follow).alias("rank"))
            state = moved.union(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        state = cut_lineage(state)
        # In all, and at every host in masses of one seed: a single seed's surroundings are small in all when there are many.
        moved = F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0)))
        change = state.withColumnRenamed("rank", "now").join(before, ["kind", "host"], "full").join(total, "kind").agg(
            F.sum(moved), F.max(moved * F.col("all"))).first()
        if max(change[0] or 0.0, change[1] or 0.0) <= settings.settled:
            return state


def judge(
    pages: DataFrame, rules: DataFrame, trusted: Sequence[str] = (), blocked: Sequence[str] = (), settings: Settings = Settings()
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page, the last two in masses of one seed. ``rules`` has (rule, verdict)."""
    places = located(pages)
    hosts = cut_lineage(places.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    by_host = rules_by_host(hosts, rules)
    whole = F.filter("rules", lambda r: r["start"] == "/")
    marked = hosts.where("host <> ''").join(by_host, "host", "left").select(
        "host", F.get(whole, F.lit(0))["verdict"].alias("rule_says"))
    bad = _in_domains(F.col("host"), blocked) | (F.col("rule_says") == "block")
    good = (_in_domains(F.col("host"), trusted) | (F.col("rule_says") == "allow")) & ~F.coalesce(bad, F.lit(False))
    marked = marked.select("host", F.coalesce(bad, F.lit(False)).alias("bad"), good.alias("good"))
    seeds = cut_lineage(marked.select("host", F.explode(F.filter(F.array(
        F.when(F.col("good"), F.lit("trust")), F.when(F.col("bad"), F.lit("distrust"))), lambda k: k.isNotNull())).alias("kind"), F.lit(1.0).alias("mass")))
    edges = cut_lineage(host_edges(places, hosts))
    both = edges.select(F.lit("trust").alias("kind"), "source", "target", "pages").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "pages"))
    found = ranks(both, seeds, settings)
    in_seeds = found.join(_totals(seeds), "kind")
    kinds = ("trust", "distrust")
    scored = in_seeds.groupBy("host").agg(*[
        F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank") * F.col("all"))), F.lit(0.0)).alias(k) for k in kinds])
    suspect = F.col("distrust") > settings.times * F.col("trust") + settings.least_distrust
    scored = scored.join(seeds.where("kind = 'distrust'").select("host", F.lit(True).alias("bad")), "host", "left").select(
        "host", *kinds, (F.coalesce("bad", F.lit(False)) | suspect).alias("suspect"))
    # Written, so that the join below begins with plain exchanges, which Spark can split at a host with very many pages.
    verdicts = cut_lineage(hosts.select("host").join(by_host, "host", "left").join(scored, "host", "left").select(
        "host", "rules", F.coalesce("suspect", F.lit(False)).alias("suspect"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    general = F.when(F.col("suspect"), "block").otherwise("allow")
    return places.drop("html").join(verdicts, "host").withColumn("fit", fits).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), general).alias("verdict"), "trust", "distrust")
