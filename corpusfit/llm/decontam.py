"""Benchmark decontamination: a BM25 index of test items, searched with every passage of every document.

Index. An item is cut into parts of at most ``part_words`` words. The weight of a term in a part is its BM25 weight
divided by the sum over the part's own terms, so that a passage that holds a whole part scores 1 and the
threshold is a share of the part. Postings are ordered by part and grouped in blocks with their greatest weight.

Search. Passages are windows of two strides and a half-window step over the whole text, so every run of ``part_words``
words lies in one of them whole. Bounds from the blocks' greatest weights first tell, for a whole batch of
documents at once, which blocks of which passage can reach the threshold at all; those passages are then evaluated
with block-max WAND, which gives every part at or above the threshold.

Verification. A hit counts when enough of the item's question words and of its answer words are covered by word runs
that the document has too, but for one word of each. When only one of the two is, the other counts too if enough of its
words stand in the same order within ``near`` words of the place where the first is found, so a short answer counts in its
own right, with a label before it or an edited word. The answer is the item's last sentence, or its second half if it
has one only.

The index is broadcast. It is built from groups of items whose text is within ``group_bytes`` (measured first), and
all documents are searched with one group after another, so no broadcast grows with the benchmark.

Items of fewer than ``least_words`` words are not scored: a document holds one when it has all of the item's words
one after another, which is looked up for every place of every document. Score and overlaps are then 1.

Defined cases: null or empty documents match nothing; items without a word (or null text) are not searched; repeated items and documents give a row each; an empty side gives no rows;
further columns are ignored (and returned by ``clean``).
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.llm.word_arrays import WordMemo, expand, in_parts

TERM = re.compile(r"[^\W_]+")
UNKNOWN = bytes(4)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


@dataclass(frozen=True)
class Rule:
    threshold: float = 0.7
    part_words: int = 64
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    run: int = 5
    #: Words that may stand between question and answer.
    near: int = 16
    least_words: int = 8
    question_overlap: float = 0.6
    answer_overlap: float = 0.6
    group_bytes: int = 16_000_000

    @property
    def stride(self) -> int:
        return self.part_words // 2


@dataclass
class Index:
    """Terms are numbered from 1; 0 stands for all words that no item has."""

    rule: Rule
    token: str
    terms: dict[str, int]
    items: list[tuple[int, np.ndarray, int]]  # item_id, terms, words of the question
    part_item: np.ndarray
    first: np.ndarray  # of term t: postings first[t] .. first[t + 1]
    parts: np.ndarray
    weights: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_best: np.ndarray
    #: Short items by number of words: their hashes in order, and which items have these words.
    short: dict[int, tuple[np.ndarray, dict[tuple[int, ...], list[int]]]] = field(default_factory=dict)
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))  # per block: most that common terms can add
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def build(rows: list[tuple[int | None, str | None]], rule: Rule) -> Index:
    """Index of a bounded group of items."""
    terms: dict[str, int] = {}
    items, parts = [], []
    whole: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for item_id, text in rows:
        words = terms_of(text)
        if not words:
            continue
        if len(words) < rule.least_words:
            ids = np.array([terms.setdefault(w, len(terms) + 1) for w in words], np.int64)
            whole.setdefault(len(ids), {}).setdefault(tuple(ids.tolist()), []).append(len(items))
            items.append((item_id, ids, len(ids)))
            continue
        sentences = [s for s in SENTENCE.split(text) if TERM.search(s)]
        question = len(words) - len(terms_of(sentences[-1])) if len(sentences) > 1 else 0
        ids = np.array([terms.setdefault(w, len(terms) + 1) for w in words], np.int64)
        items.append((item_id, ids, question or len(words) // 2))
        count = -(-len(ids) // rule.part_words)
        parts += [(len(items) - 1, piece) for piece in np.array_split(ids, count)]
    # Parts that share terms come near one another, which keeps block bounds tight.
    parts.sort(key=lambda p: (-int(np.median(p[1])), p[0]))
    n, vocabulary = len(parts), len(terms) + 1
    average = np.mean([len(p[1]) for p in parts]) if parts else 1.0
    found = np.zeros(vocabulary)
    for _, ids in parts:
        found[np.unique(ids)] += 1
    idf = np.log1p((n - found + 0.5) / (found + 0.5))
    rows_t, rows_p, rows_w = [], [], []
    for k, (_, ids) in enumerate(parts):
        own, tf = np.unique(ids, return_counts=True)
        weight = idf[own] * tf * (rule.k1 + 1) / (tf + rule.k1 * (1 - rule.b + rule.b * len(ids) / average))
        rows_t.append(own)
        rows_p.append(np.full(len(own), k))
        rows_w.append(weight / weight.sum())
    empty = np.zeros(0)
    t, p, w = (np.concatenate(x) if x else empty for x in (rows_t, rows_p, rows_w))
    order = np.lexsort((p, t))
    t, p, w = t[order].astype(np.int64), p[order].astype(np.int64), w[order]
    first = np.searchsorted(t, np.arange(vocabulary + 1))
    block_key = t * (n // rule.block + 1) + p // rule.block
    keys, at = np.unique(block_key, return_index=True)
    best = np.maximum.reduceat(w, at) if len(w) else empty
    block_t, blocks = keys // (n // rule.block + 1), keys % (n // rule.block + 1)
    block_first = np.searchsorted(block_t, np.arange(vocabulary + 1))
    index = Index(
        rule, uuid.uuid4().hex, terms, items, np.array([q for q, _ in parts], np.int64), first, p, w, block_first, blocks, best,
        {n: (np.unique(_keys(np.array(list(own)).reshape(-1), tuple(range(n)))[::n]), own) for n, own in whole.items()})
    # Common terms enter bounds as a constant per block: take the most frequent ones while they stay below half the threshold.
    index.common = np.zeros(vocabulary, bool)
    mass = np.zeros(n)
    for term in np.argsort(-found, kind="stable"):
        own = slice(first[term], first[term + 1])
        if found[term] < max(2, n // 20) or (mass[p[own]] + w[own]).max() > rule.threshold / 2:
            break
        mass[p[own]] += w[own]
        index.common[term] = True
    index.usual = np.array([mass[k:k + rule.block].max() for k in range(0, n, rule.block)] or [0.0])
    return index


class TermIds(WordMemo):
    """Term numbers of the words of documents; a word may hold several terms."""

    def __init__(self, index: Index):
        super().__init__()
        self.numbers = {term.encode(): number.to_bytes(4, "little") for term, number in index.terms.items()}

    def made(self, word: bytes) -> bytes:
        bare = word.rstrip(b".,")
        if bare.isalnum():  # ASCII letters and digits only
            return self.numbers.get(bare, UNKNOWN)
        return b"".join(self.numbers.get(w.encode(), UNKNOWN) for w in terms_of(word.decode()))


def block_max_wand(index: Index, query: np.ndarray, floor: float) -> list[tuple[int, float]]:
    """Parts whose weights over the distinct query terms sum to ``floor`` or more, with the sums."""
    size = index.rule.block
    lists = []
    for term in query:
        a, b = int(index.first[term]), int(index.first[term + 1])
        if a < b:
            own = slice(int(index.block_first[term]), int(index.block_first[term + 1]))
            best = dict(zip(index.blocks[own].tolist(), index.block_best[own].tolist()))
            lists.append([index.parts[a:b].tolist(), index.weights[a:b].tolist(), 0, max(best.values()), best])
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[3]
            if bound >= floor:
                pivot = k
                break
        if pivot < 0:
            break
        part = lists[pivot][0][lists[pivot][2]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == part:
            pivot += 1
        if sum(x[4].get(part // size, 0.0) for x in lists[:pivot + 1]) < floor:
            # Nothing before the end of this block, or before the next list begins, can reach the floor.
            goal = (part // size + 1) * size
            if pivot + 1 < len(lists):
                goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][2]])
            moved = lists[:pivot + 1]
        elif lists[0][0][lists[0][2]] == part:
            score = sum(x[1][x[2]] for x in lists[:pivot + 1])
            if score >= floor:
                out.append((part, score))
            goal, moved = part + 1, lists[:pivot + 1]
        else:
            goal, moved = part, lists[:pivot]
        for x in moved:
            while x[2] < len(x[0]) and x[0][x[2]] < goal:
                x[2] += 1
        lists = [x for x in lists if x[2] < len(x[0])]
    return out


def promising(index: Index, words: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """For every document of a batch, the passages that some block's bound lets through.

    A passage is three strides long and begins at a stride; its bound for a block is the sum of the block's greatest
    weights over its words, plus what common terms can add.
    """
    rule, blocks = index.rule, len(index.usual)
    floor = rule.threshold - 1e-9
    lengths = np.diff(edges)
    strides = -(-lengths // rule.stride)
    base = np.cumsum(strides) - strides
    owner = np.repeat(np.arange(len(lengths)), lengths)
    stride = base[owner] + (np.arange(len(words)) - edges[:-1][owner]) // rule.stride
    rare = (words > 0) & ~index.common[words]
    words, stride = words[rare], stride[rare]
    count = index.block_first[words + 1] - index.block_first[words]
    after = np.cumsum(count)
    total = int(after[-1]) if len(after) else 0
    at = np.repeat(index.block_first[words] - (after - count), count) + np.arange(total)
    wide = int(strides.sum())
    hit = np.zeros(wide + 2, bool)
    rows_at_once = max(1, 2_000_000 // blocks)
    place, block, gain = np.repeat(stride, count), index.blocks[at], index.block_best[at]
    for low in range(0, wide, rows_at_once):
        high = min(wide, low + rows_at_once)
        a, b = np.searchsorted(place, [low, high + 2])
        sums = np.bincount(
            (place[a:b] - low) * blocks + block[a:b], gain[a:b], (high + 2 - low) * blocks).reshape(-1, blocks)
        bound = sums[:-2] + sums[1:-1] + sums[2:] + index.usual
        hit[low:high] = (bound >= floor).any(axis=1)
    return [np.flatnonzero(hit[x:x + n]) for x, n in zip(base, strides)]


def _keys(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash at every place of the words at these offsets from it."""
    key = np.zeros(max(0, len(words) - offsets[-1]), np.uint64)
    for k in offsets:
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(key)].astype(np.uint64) + np.uint64(1)
        key ^= key >> np.uint64(29)
    return key


def covered(item: np.ndarray, passage: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the item lie in a run of ``run`` words that the passage has too but for one word, and where they are.

    The places are those in the passage at which the item would begin by each run found.
    """
    run = min(run, len(item))
    # All but one word of a run: without an outer one, or with another word inside.
    shapes = [tuple(j for j in range(run) if j != k) for k in range(1, run)] if run > 2 else [tuple(range(run))]
    marks, begins = np.zeros(len(item), bool), []
    for offsets in shapes:
        own, other = _keys(item, offsets), _keys(passage, offsets)
        starts = np.isin(own, other)
        for k in offsets:
            marks[k:k + len(starts)] |= starts
        places = np.flatnonzero(np.isin(other, own))
        by_key = np.argsort(own, kind="stable")
        low = np.searchsorted(own[by_key], other[places], "left")
        count = np.searchsorted(own[by_key], other[places], "right") - low
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begins.append(np.repeat(places, count) - by_key[np.repeat(low, count) + nth])
    return marks, np.unique(np.concatenate(begins))


def in_order(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the words of ``part`` that the passage has in the same order (longest common subsequence, bit-parallel)."""
    places: dict[int, int] = {}
    for k, word in enumerate(part.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(part)) - 1
    state = full
    for word in passage.tolist():
        if same := state & places.get(word, 0):
            state = (state + same | state - same) & full
    return (len(part) - state.bit_count()) / len(part)


def overlaps(item: np.ndarray, question: int, passage: np.ndarray, rule: Rule) -> tuple[float, float]:
    """Question and answer overlap. Runs find one of the two; the other is also looked for in the words beside it."""
    marks, begins = covered(item, passage, rule.run)
    q, a = float(marks[:question].mean()), float(marks[question:].mean())

    def beside(part: np.ndarray, before: np.ndarray, after: np.ndarray, enough: float) -> float:
        best, wide = 0.0, len(part) + rule.near
        for low, high in zip(before.tolist(), after.tolist()):
            for near in (passage[max(0, high):max(0, high) + wide], passage[max(0, low - wide):max(0, low)]):
                best = max(best, in_order(part, near))
                if best >= enough:
                    return best
        return best

    if q >= rule.question_overlap and a < rule.answer_overlap:
        a = max(a, beside(item[question:], begins, begins + question, rule.answer_overlap))
    elif a >= rule.answer_overlap and q < rule.question_overlap:
        q = max(q, beside(item[:question], begins + question, begins + len(item), rule.question_overlap))
    return q, a


def matches(index: Index, words: np.ndarray, passages: np.ndarray) -> dict[int, tuple[float, float, float, int]]:
    """Verified items of one document: item -> score, question overlap, answer overlap, first word of the passage."""
    rule, out = index.rule, {}
    for stride in passages:
        start = int(stride) * rule.stride
        passage = words[start:start + 3 * rule.stride]
        query = np.unique(passage[passage > 0])
        for part, score in block_max_wand(index, query, rule.threshold - 1e-9):
            item = int(index.part_item[part])
            _, ids, question = index.items[item]
            reach = len(ids) + rule.near
            q, a = overlaps(ids, question, words[max(0, start - reach):start + 3 * rule.stride + reach], rule)
            if q >= rule.question_overlap and a >= rule.answer_overlap and score > out.get(item, (0.0,))[0]:
                out[item] = (score, q, a, start)
    return out


def short_matches(index: Index, words: np.ndarray, edges: np.ndarray) -> dict[int, dict[int, tuple[float, float, float, int]]]:
    """Short items by document of a batch, as ``matches`` gives them."""
    out: dict[int, dict[int, tuple[float, float, float, int]]] = {}
    for n, (keys, own) in index.short.items():
        places = np.flatnonzero(np.isin(_keys(words, tuple(range(n))), keys))
        docs = np.searchsorted(edges, places, "right") - 1
        inside = places + n <= edges[docs + 1]
        for place, doc in zip(places[inside].tolist(), docs[inside].tolist()):
            for item in own.get(tuple(words[place:place + n].tolist()), ()):
                start = (place - int(edges[doc])) // index.rule.stride * index.rule.stride
                out.setdefault(doc, {}).setdefault(item, (1.0, 1.0, 1.0, start))
    return out


@functools.lru_cache(maxsize=2)
def _memo(token: str, holder) -> TermIds:
    return TermIds(holder.value)


class Broadcasted:
    """A broadcast index with the token by which a worker knows it again."""

    def __init__(self, broadcast, token: str):
        self.broadcast, self.token = broadcast, token

    def __hash__(self) -> int:
        return hash(self.token)

    def __eq__(self, other) -> bool:
        return self.token == other.token

    @property
    def value(self) -> Index:
        return self.broadcast.value


def groups(benchmark: DataFrame, rule: Rule) -> list[Broadcasted]:
    """Broadcast indexes over groups of items of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // rule.group_bytes * 2 + 1
    out = []
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        index = build([tuple(r) for r in part.orderBy("item_id", "text").collect()], rule)
        if index.items:
            out.append(Broadcasted(spark.sparkContext.broadcast(index), index.token))
    return out


def _found(text: pa.Array, holder: Broadcasted) -> Iterator[dict]:
    index, memo = holder.value, _memo(holder.token, holder)
    for part in in_parts(text):
        words, edges = expand(part, memo)
        words = words.astype(np.int64)
        short = short_matches(index, words, edges)
        for k, passages in enumerate(promising(index, words, edges)):
            yield (matches(index, words[edges[k]:edges[k + 1]], passages) if len(passages) else {}) | short.get(k, {})


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document and verified item."""
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    for holder in groups(benchmark, rule):

        def run(batches: Iterator[pa.RecordBatch], holder=holder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, found in zip(batch.column(0).to_pylist(), _found(batch.column(1), holder)):
                    rows += [(doc_id, holder.value.items[item][0], *hit) for item, hit in found.items()]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        own = texts.mapInArrow(run, SCHEMA)
        out = own if out is None else out.union(own)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without a verified item, with all their columns; nothing is shuffled."""
    for holder in groups(benchmark, rule):

        def run(batches: Iterator[pa.RecordBatch], holder=holder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not found for found in _found(text, holder)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
