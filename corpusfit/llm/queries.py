"""Queries over the given tables that apply the operators, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame] | None = None, oracle: str | None = None):
    """Register a query under its function's name, with its DuckDB twin if there is one."""
    if fn is None:
        return lambda f: query(f, oracle)
    QUERIES[fn.__name__] = fn
    if oracle:
        ORACLES[fn.__name__] = oracle
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@query(oracle=r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT u, u AS r FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.r),
    low AS (SELECT u, min(r) AS r FROM reach GROUP BY u)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON u = d.doc_id""")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Rule(words=2))


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.categories_of_labels())
    return toxicity.score(docs, chain)


#: Key of the registered queries and of the pipeline; a deployment passes its own secret.
PSEUDONYM_KEY = "corpus-key-1"


@query
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import pii

    return pii.with_counts(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query(oracle=r"""WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, k FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, k)),
    rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
    c AS MATERIALIZED (SELECT w.doc_id, host, len(w) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
      coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
    f AS (SELECT doc_id, host, unnest([{'r': 'short', 'x': n_words < 10}, {'r': 'repeats', 'x': 100 * n_repeat_words > 20 * n_words}, {'r': 'symbols', 'x': 100 * n_symbols > 10 * word_chars},
      {'r': 'dup_lines', 'x': 100 * n_dup_lines > 30 * n_lines}, {'r': 'word_length', 'x': word_chars < 2 * n_words OR word_chars > 12 * n_words}]) AS q FROM c),
    h AS (SELECT host, q.r AS r, count(*) AS n, count(*) FILTER (q.x) AS k FROM f WHERE host IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT r, count(*) AS hosts, sum(n) AS docs, sum(k) AS failed, sum((k - 1) * k / n) AS pairs FROM h GROUP BY r),
    m AS (SELECT *, failed / docs AS m FROM p),
    a AS (SELECT *, CASE WHEN docs > hosts AND m * (1 - m) > 0 THEN (pairs / (docs - hosts) - m * m) / (m * (1 - m)) ELSE 0 END AS alike FROM m),
    s AS (SELECT r, m, CASE WHEN alike > 0 THEN least(1e6, greatest(2, 1 / alike - 1)) ELSE 1e6 END AS strength, least(0.9, greatest(0.5, 3 * m / (1 - m + 3 * m))) AS most FROM a),
    bad AS (SELECT DISTINCT host FROM h JOIN s USING (r) WHERE (k + m * strength) / (n + strength) > most),
    b AS (SELECT c.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, host IS NOT NULL AND host IN (SELECT host FROM bad) AS host_failed FROM c)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host, host_failed FROM b""")
def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import host_rules

    return host_rules.judge(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusfit.llm import chat

    # Conversation -1: two turns that speak in another format's control strings.
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(hostile)))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import token_store

    folder = token_store.new_folder(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), folder)
    return token_store.read_store(spark, folder)


#: Rules of the registered query, and domains whose hosts begin as distrusted.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BLOCKED_DOMAINS = [
    "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "ads-track.example.com", "spam-farm.example.com",
    "adult-x.example.net"]


@query
def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import url_trust

    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_trust.judge(table(spark, sf_dir, "pages"), rules, blocked=BLOCKED_DOMAINS)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import alignment

    return alignment.measures(table(spark, sf_dir, "documents"))


@query
def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import kd_shards

    return kd_shards.shards(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusfit.llm import prefix_trie

    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))
