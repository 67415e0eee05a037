"""Rules, edges and ranks against plain Python."""

import re

import pytest

from corpusfit.llm import url_trust
from corpusfit.llm.queries import URL_RULES

PAGES = [
    (1, "https://WWW.a.Example.org/en/12?x=1", "<a href='https://b.example.com/x'>"), (2, "http://a.example.org/es/", None),
    (3, "http://b.example.com", "<a href=\"http://bad.net/\"> &copy; hub.net"), (4, "http://b.example.com/fr/1#x", ""),
    (5, "x://b.example.com/de/?q", "https://hub.net/ https://HUB.net/z"), (6, None, "https://bad.net"), (7, "no scheme", None), (8, "", None),
    (9, "http://hub.net/a/b", "<a href=https://www.a.example.org/ >"), (10, "http://bad.net?u=http://c.org/", "http://worse.net"),
    (11, "http://worse.net#f", "://bad.net"), (12, "http://m.hub.net/", None), (13, "http://xorg/es/", None), (14, "http://org/", None),
    (15, "a://b://c.org/fr/", None), (16, "http://friend.net/", "https://bad.net/ https://hub.net/"), (1, "http://hub.net/a/b", None),
    (17, "http:///path", None), (18, "http://é.org/ü?", None),
]


def located(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = [(r, v) for r, v in URL_RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def plain(blocked, settings):
    hosts = {located(u)[0] for _, u, _ in PAGES}
    edges = {}
    for _, u, h in PAGES:
        s = located(u)[0]
        for t in {m.lower() for m in re.findall(url_trust.MENTION, h or "")} - {s}:
            if s:
                edges[s, t] = edges.get((s, t), 0) + 1
    for s in hosts:
        t = s.split(".", 1)[-1]
        if s and t in hosts and t != s:
            edges[s, t] = edges.get((s, t), 0) + 1
    inside = lambda h, d: h == d or h.endswith("." + d)
    bad = {h for h in hosts if any(inside(h, d) for d in blocked)}
    good = {h for h in hosts if inside(h, "org")} - bad
    out = {}
    for kind, seeds, links in (("trust", good, edges), ("distrust", bad, {(t, s): n for (s, t), n in edges.items()})):
        start = {h: 1.0 for h in seeds}
        rank = dict(start)
        for _ in range(150):
            new = {h: m * (1 - settings.follow) for h, m in start.items()}
            for (s, t), n in links.items():
                new[t] = new.get(t, 0) + settings.follow * rank.get(s, 0) * n / sum(k for (x, _), k in links.items() if x == s)
            rank = new
        out[kind] = rank
    return out


def test_judged(spark):
    settings = url_trust.Settings(settled=1e-13)
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    rows = url_trust.judge(pages, rules, blocked=["bad.net"], settings=settings).collect()
    want = plain(["bad.net"], settings)
    assert sorted(r.page_id for r in rows) == sorted(p[0] for p in PAGES)
    by_url = {}
    for p, u, _ in PAGES:
        by_url.setdefault((p, *located(u)), []).append(u)
    for r in rows:
        assert (r.page_id, r.host, r.path) in by_url
        rule, verdict = rule_of(r.host, r.path)
        trust, distrust = (want[k].get(r.host, 0.0) if r.host else 0.0 for k in ("trust", "distrust"))
        assert r.trust == pytest.approx(trust, abs=1e-12) and r.distrust == pytest.approx(distrust, abs=1e-12)
        assert r.rule == rule and r.verdict == (verdict or ("block" if distrust > trust + settings.least_distrust else "allow"))
    said = {r.host: r.verdict for r in rows if r.rule is None}
    assert said["bad.net"] == said["worse.net"] == "block" and said[""] == "allow"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    assert url_trust.judge(pages, rules).count() == 0
    assert url_trust.judge(spark.createDataFrame([(1, None, None)], pages.schema), rules.limit(0)).first().verdict == "allow"


@pytest.mark.parametrize("seeds", [1, 1000])
def test_verdicts_do_not_depend_on_the_number_of_seeds(spark, seeds):
    rows = [(k, f"http://h{k}.bad.net/", "https://good.org/" if k % 2 else None) for k in range(seeds)]
    rows += [(5000, "http://friend.net/", "https://h0.bad.net/"), (5001, "http://far.net/", "https://friend.net/ https://good.org/"),
             (5002, "http://plain.net/", None), (5003, "http://good.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("org/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in url_trust.judge(pages, rules, blocked=["bad.net"]).collect()}
    assert {got[k] for k in range(seeds)} == {"block"}
    assert [got[k] for k in range(5000, 5004)] == ["block", "block", "allow", "allow"]


@pytest.mark.parametrize("good,bad", [(1, 1), (400, 1), (1, 400)])
def test_verdicts_do_not_depend_on_the_other_side(spark, good, bad):
    """A host that a trusted host and, less, distrust reach keeps its verdict when seeds far away are added on one side."""
    rows = [(k, f"http://h{k}.bad.net/", None) for k in range(bad)] + [(1000 + k, f"http://g{k}.org/", None) for k in range(good)]
    rows += [(5000, "http://g0.org/a", "https://trusted.net/"), (5001, "http://trusted.net/", "https://h0.bad.net/ https://p.net/ https://q.net/"),
             (5002, "http://suspect.net/", "https://h0.bad.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("org/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in url_trust.judge(pages, rules, blocked=["bad.net"]).collect()}
    assert (got[5001], got[5002]) == ("allow", "block")


def test_a_long_way_from_one_of_many_seeds(spark):
    rows = [(k, f"http://h{k}.bad.net/", None) for k in range(2000)]
    rows += [(5000 + k, f"http://c{k}.net/", f"https://{'c%d.net' % (k - 1) if k else 'h0.bad.net'}/") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("org/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in url_trust.judge(pages, rules, blocked=["bad.net"]).collect()}
    assert set(got.values()) == {"block"}


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([("org/", "allow"), ("a.example.org/es/", "block"), ("b.c.example.net/", "block")], "rule string, verdict string")
    long_ = "x." * 50_000
    hosts = spark.createDataFrame([(long_ + "a.example.org",), (long_ + "b.c.example.net",), ("org",), ("net",), ("",), ("c.example.net",)], "host string")
    got = {r.host[-15:]: [x.rule for x in r.rules] for r in url_trust.rules_by_host(hosts, rules).collect()}
    assert got == {"x.a.example.org": ["a.example.org/es/", "org/"], "b.c.example.net": ["b.c.example.net/"], "org": ["org/"]}
    empty = url_trust.rules_by_host(hosts, rules.limit(0))
    assert empty.count() == 0
