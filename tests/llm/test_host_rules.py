"""Counts against a plain count in Python, and host verdicts against the formula."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpusfit.llm import host_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    found, marks = Counter(windows), set()
    for i, w in enumerate(windows):
        if found[w] > 1:
            marks |= set(range(i, i + 5))
    symbols = sum(c in host_rules.SYMBOLS for c in text)
    base = len(words) < 10 or 100 * len(marks) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marks), base


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t\n", "one", "a b c d e a b c d e", "a a a a a a a a a a", "x\n\nx\n x\nx", "é 🙂|<# b\x0bc d", "\n".join(["same line"] * 40)]
    for k in range(60):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 400))]
        if k % 3 == 0:
            words[5:5] = words[20:40]
        out.append(rng.choice([" ", "\n", " \r\n"]).join(words) + rng.choice(["", " ###", "\n"]))
    return [*out, " ".join(str(i % 7001) for i in range(30_000)), "w " * 20_000]


def test_counts_and_hosts(spark):
    rng, rows = random.Random(8), []
    for i, text in enumerate(texts()):
        rows.append((i, text, None, 5))
    for k in range(300):
        bad = k % 3 == 0
        words = " ".join(f"w{rng.randrange(10_000)}" for _ in range(30))
        rows.append((1000 + k, "few words" if bad and k % 10 else words, "bad" if bad else f"h{k % 12}", 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int").repartition(6)
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, text, source, _ in rows:
        r = got[i]
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        assert r.kept == (not want[5] and source != "bad") and r.host_failed == (source == "bad")
    # The rate of "short" by its formula.
    judged = host_rules._counts(docs, "source").select("*", *[c.alias(f"failed_{n}") for n, c in host_rules.failures(host_rules.Rules()).items()])
    hosts = {r.host: r for r in host_rules.host_verdicts(judged).collect()}
    by_host = {}
    for i, text, source, _ in rows:
        if source is not None:
            by_host.setdefault(source, []).append(plain(text)[0] < 10)
    n_docs, n_failed = sum(map(len, by_host.values())), sum(map(sum, by_host.values()))
    mean = n_failed / n_docs
    together = sum((sum(v) - 1) * sum(v) / len(v) for v in by_host.values()) / (n_docs - len(by_host))
    alike = (together - mean * mean) / (mean * (1 - mean))
    strength = max(2.0, 1 / alike - 1) if alike > 0 else 1e6
    for host, v in by_host.items():
        assert abs(hosts[host].rate_short - (sum(v) + mean * strength) / (len(v) + strength)) < 1e-9
        assert hosts[host].n_docs == len(v)


def test_empty_and_single_host(spark):
    schema = "doc_id long, text string, source string"
    assert host_rules.judge(spark.createDataFrame([], schema)).count() == 0
    one = host_rules.judge(spark.createDataFrame([(1, None, "h"), (1, None, "h"), (None, "a b", None)], schema)).collect()
    assert len(one) == 3 and all(r.base_failed and not r.kept for r in one)


def verdicts(spark, hosts):
    """Failed hosts, from (host, documents, failures of symbols)."""
    rows = [(h, k < bad) for h, n, bad in hosts for k in range(n)]
    judged = spark.createDataFrame(rows, "host string, failed_symbols boolean").select(
        "*", *[F.lit(False).alias(f"failed_{n}") for n in host_rules.failures(host_rules.Rules()) if n != "symbols"])
    return {r.host for r in host_rules.host_verdicts(judged).collect() if r.host_failed}


def test_bad_hosts_among_few_or_many(spark):
    assert verdicts(spark, [("a", 200, 200), ("b", 200, 2)]) == {"a"}
    assert verdicts(spark, [("a", 200, 200), ("b", 200, 2), ("c", 50, 0)]) == {"a"}
    assert verdicts(spark, [("a", 200, 200), ("b", 100, 100), ("c", 5, 0)]) == {"a", "b"}
    assert verdicts(spark, [(f"h{k}", 100, 100 if k % 3 == 0 else 1) for k in range(30)]) == {f"h{k}" for k in range(0, 30, 3)}


def test_one_document_is_no_verdict(spark):
    assert verdicts(spark, [(f"h{k}", 1, int(k % 20 == 0)) for k in range(400)]) == set()
    assert verdicts(spark, [(f"h{k}", 1 + k % 2, int(k % 20 == 0)) for k in range(400)]) == set()
    assert verdicts(spark, [(f"h{k}", 1, int(k % 20 == 0)) for k in range(400)] + [("bad", 200, 190)]) == {"bad"}


def test_twin_where_hosts_fail(spark, tmp_path):
    """The DuckDB twin knows the fitted prior: hosts that fail wholly, partly, hardly or with one document."""
    rng, rows = random.Random(3), []
    shares = {"bad": (60, 60), "half": (40, 24), "mixed": (50, 20), "one": (1, 1), "good": (80, 1), None: (5, 2)} | {f"h{k}": (12, 0) for k in range(6)}
    for host, (n, bad) in shares.items():
        for k in range(n):
            words = [f"w{rng.randrange(10_000)}" for _ in range(30)]
            rows.append((len(rows), "### $$$ " * 20 + " ".join(words) if k < bad else " ".join(words), host))
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op6_host_rules(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["op6_host_rules"]).fetchall(), key=str)
    assert got == want and len(got) == len(rows)
    failed = {r[8] for r in got if r[9]}
    assert "bad" in failed and not failed & {"one", "good", "h0", None}
