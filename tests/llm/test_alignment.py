"""Alignment against whole-text encoding and a plain corpus-wide count."""

import hashlib
import random
from collections import Counter

import pytest

from corpusfit.llm import alignment

TEXTS = [
    "To thbleor theati, hein! to ertionnt of antion", "To thbleor theati, hein! to ertionnt of antion", None, "", " ", "  two  blanks ", "x" * 3000,
    "Était-ce l'été? ß İstanbul é ñandú 12.5 日本語 🙂🙃 <|endoftext|> <s> </s> <unk> <0x41>", "line\nend\n\n  tab\t\tx\r\nreturn\r", "no break　wide   \x0b\x1c",
    "piece ▁ mark", "\x00null\x7f", "I'll we've don't", " \n", "ﬁ Ａ é", "it is 2019-2021 ; );\n}", "a a a a", "a", "the the\tthe",
]


def plain(texts):
    """Measures by whole-text encoding and counting over all documents."""
    tool = alignment.Aligner(*alignment.vocabularies())
    made = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = tool.a.encode(" " + (text or ""), add_special_tokens=False).ids, tool.b.encode(text or "")
        own, other = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
        if not text or b"".join(own) != raw or b"".join(other) != raw:
            made.append(None)
            continue
        spans = []
        for pieces in (own, other):
            at = 0
            spans.append([(at := at + len(p)) - len(p) for p in pieces])
        ends_a = [s + len(p) for s, p in zip(spans[0], own)]
        ends_b = [s + len(p) for s, p in zip(spans[1], other)]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if spans[0][i] < ends_b[j] and spans[1][j] < ends_a[i]]
        cuts = sorted(set(ends_a) & set(ends_b))
        said, low = [], 0
        for cut in cuts:
            said.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= cut) + "|" + ",".join(str(x) for x, e in zip(b, ends_b) if low < e <= cut))
            low = cut
        made.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    counts = Counter(p for m in made if m for p in set(m[3]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    rows = []
    for k, m in enumerate(made):
        rows.append((k, 0, 0, 0, 0, 0, 0, "") if m is None else (
            k, *m[:3], len(m[3]), sum(counts[p] == most[p[0]] for p in m[3]), sum(counts[p] for p in m[3]), m[4]))
    return rows, counts, most


def noise(seed):
    rng = random.Random(seed)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "\t", "é", "日", "🙂", ".", ",", "'s", "1", "I", " the", " ", "\r", ");", "ing"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("chars", [1, 400, 10_000_000])
def test_equals_whole_texts_and_plain_counts(spark, chars):
    texts = TEXTS + noise(5) + noise(5)[:20]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    settings = alignment.Settings(block_chars=chars, words_kept=20, at_once=300)
    got = sorted(tuple(r) for r in alignment.measures(docs, settings=settings).collect())
    want, counts, most = plain(texts)
    assert got == want
    if chars == 400:
        pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.pair_counts(alignment.blocks(docs, settings=settings)).collect()}
        assert pairs == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_white_space_between_words_is_safe_for_b():
    tool = alignment.Aligner(*alignment.vocabularies())
    assert tool.words("a  b\n\tc ") == [" a", "  b", "\n\tc", " "] and tool.words("a\rb") == [" a\rb"]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None)]
    got = alignment.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_a for r in got) == [0, 2, 2, 2] and {r.count_sum for r in got if r.n_a} == {6}
    assert alignment.measures(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert alignment.measures(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_hot_text_is_one_row_per_task(spark):
    docs = spark.createDataFrame([(k, "hot hot text" if k % 3 else f"own {k}") for k in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.measures(docs).collect()}
    assert len(got) == 300 and got[1].groups_sha256 == got[2].groups_sha256 and got[1].n_best == got[1].n_links


def test_very_long_text(spark):
    text = "Ergon thea " * 20_000 + "z" * 100_000
    row = alignment.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    tool = alignment.Aligner(*alignment.vocabularies())
    assert row.n_a == len(tool.a.encode(" " + text, add_special_tokens=False).ids) and row.n_b == len(tool.b.encode(text))
