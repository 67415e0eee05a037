"""Tokens of two vocabularies aligned over the same bytes, each distinct text once.

Equal texts are brought together by their full text with a count (merged in each task before the shuffle, so a text that
fills a third of all rows is one row per task). Each distinct text is encoded by both vocabularies and swept once: every
A token is linked with the B tokens whose bytes it shares, and byte offsets where both end cut them into groups. Tasks put
texts into blocks of bounded size and count, per block, in how many documents a pair of ids is linked, a text with copies
counting that often. Block counts are summed over the corpus by pair; each block then gets back the totals of its own pairs
and nothing else, so no task holds the corpus' pair table. Measures of a text meet its documents by the text's digest.

No piece of B spans a change from a character to the blank, line end or tab after it, and neither do A's pre-tokens, so texts are
encoded word by word (with the white space before) and every worker keeps the words it met last. Both facts are checked or provided
for: white space that a piece of B holds inside, and texts with any other white space, are encoded whole.

Defined cases: a text that is null, empty, or whose tokens' bytes are not blank + text has no tokens (zeros, empty digest);
strings of special tokens are ordinary text; a very long text is a block of its own, in one piece; a repeated row counts as a
document of its own and gets a row; a null document id stays null; ties for the best link all count; an empty table
gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage

BLANK = "▁"
#: A pair of ids as one number: A's id above B's.
B_BITS = 20
MARKS_AT_ONCE = 4_000_000
BLOCKS = (
    "block long, text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "link_counts binary, link_places binary, codes array<long>, docs array<long>")
#: Words whose bytes a vocabulary loses.
LOST: tuple = ()
MEASURES = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Settings:
    #: Characters of a block (one text at least) and words that a worker keeps; they bound a task's memory.
    block_chars: int = 6_000_000
    words_kept: int = 150_000
    #: Words over this length are not kept.
    kept_chars: int = 100
    at_once: int = 400_000


def vocabularies() -> tuple[str, str]:
    """Files of the production vocabularies A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Encodes texts with both vocabularies and aligns their tokens."""

    def __init__(self, a_path: str, b_path: str, settings: Settings = Settings()):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.settings = settings
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte alphabet of A: printable bytes stand for themselves, the others follow from U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown))}
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(map(byte.__getitem__, entry)) for entry, i in entries.items() if all(c in byte for c in entry)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.b_blank = self.b.piece_to_id(BLANK)
        self.a_named = {i: str(i) for i in self.a_bytes}
        self.b_named = list(map(str, range(len(pieces))))
        self.quick = self._ranked(a_path)
        held = "".join(pieces)
        white = "".join(c for c in "\t\n" if c not in held) + ("" if any(BLANK in p.lstrip(BLANK) for p in pieces) else " ")
        self.word = re.compile(f"[{white}]*[^{white}]+|[{white}]+") if " " in white else None
        self.other = re.compile(rf"[^\S{white}]|{BLANK}") if self.word else None
        self.kept: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _ranked(self, a_path: str):
        """A's merges by rank, quicker for short words; None unless ids follow the order of the merges."""
        import public_tokenizers
        import tiktoken

        with open(a_path) as f:
            told = json.load(f)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        ids, vocabulary = [told["model"]["vocab"].get(x + y) for x, y in pairs], told["model"]["vocab"]
        special = {t["id"] for t in told["added_tokens"]}
        plain = {i for entry, i in vocabulary.items() if len(entry) == 1}
        if told["normalizer"] or ids != sorted(ids) or plain | set(ids) != set(vocabulary.values()) - special or max(plain) > ids[0]:
            return None
        ranks = {self.a_bytes[i]: i for i in self.a_bytes if i not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, words: list[str]) -> list[list[int]]:
        short = self.settings.kept_chars if self.quick else 0
        whole = [w for w in words if len(w) > short]
        ours = iter(self.a.encode_batch(whole, add_special_tokens=False) if whole else [])
        return [self.quick.encode_ordinary(w) if len(w) <= short else next(ours).ids for w in words]

    def words(self, text: str) -> list[str]:
        """Blank + text in pieces that both vocabularies encode one by one."""
        whole = " " + text
        return [whole] if self.word is None or self.other.search(text) else self.word.findall(whole)

    def entries(self, words: list[str]) -> list[tuple]:
        """For each distinct word: tokens of A and B, groups, links and the groups' text; ``LOST`` where bytes are lost."""
        found = list(map(self.kept.get, words))
        new = []
        for k, entry in enumerate(found):
            if entry is None:
                found[k] = entry = self.old.get(words[k])
                if entry is None:
                    new.append(k)
                else:
                    self.kept[words[k]] = entry
        if new:
            texts = [words[k] for k in new]
            theirs = self.b.encode([w[1:] if w[0] == " " else w for w in texts], num_threads=1)
            for k, w, a, b in zip(new, texts, self._a_ids(texts), theirs):
                if w == " ":
                    b = [self.b_blank]
                elif w[0] != " " and b and b[0] == self.b_blank:  # the blank that B puts before any text
                    b = b[1:]
                found[k] = entry = self.aligned(w.encode(), a, b)
                if len(w) <= self.settings.kept_chars:
                    self.kept[w] = entry
        if len(self.kept) > self.settings.words_kept:
            self.old, self.kept = self.kept, {}
        return found

    def aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple:
        own, other = [self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b]
        if not raw or b"".join(own) != raw or b"".join(other) != raw:
            return LOST
        links, groups = array("q"), []
        a_named, b_named, last = self.a_named, self.b_named, len(a) - 1
        i = j = 0
        end_a, end_b = len(own[0]), len(other[0])
        named_a, named_b = a_named[a[0]], b_named[b[0]]
        while True:
            links.append(a[i] << B_BITS | b[j])
            if end_a == end_b:
                groups.append(f"{named_a}|{named_b}")
                if i == last:
                    break
                i, j = i + 1, j + 1
                named_a, named_b = a_named[a[i]], b_named[b[j]]
                end_a, end_b = end_a + len(own[i]), end_b + len(other[j])
            elif end_a < end_b:
                i += 1
                end_a += len(own[i])
                named_a = f"{named_a},{a_named[a[i]]}"
            else:
                j += 1
                end_b += len(other[j])
                named_b = f"{named_b},{b_named[b[j]]}"
        return len(a), len(b), len(groups), links.tobytes(), ";".join(groups).encode()


@functools.cache
def shared(a_path: str, b_path: str, settings: Settings) -> Aligner:
    """The aligner of this worker process."""
    return Aligner(a_path, b_path, settings)


class _Block:
    """Texts of one block and the words they share."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.place: dict[str, int] = {}
        self.entries: list[tuple] = []
        self.lost: set[int] = set()
        self.keys: list[bytes] = []
        self.copies: list[int] = []
        self.sequences: list[list[int]] = []

    def add(self, aligner: Aligner, rows: list[tuple[bytes, str, int]]) -> None:
        parts = [aligner.words(text) for _, text, _ in rows]
        new = list(set().union(*parts).difference(self.place))
        first = len(self.place)
        self.place.update(zip(new, range(first, first + len(new))))
        self.entries += aligner.entries(new)
        self.lost.update(k for k in range(first, len(self.entries)) if self.entries[k] is LOST)
        for (key, text, copies), own in zip(rows, parts):
            sequence = list(map(self.place.__getitem__, own))
            self.keys.append(key)
            self.copies.append(copies)
            self.sequences.append([] if self.lost and not self.lost.isdisjoint(sequence) else sequence)
            self.chars += len(text)

    def rows(self) -> pa.RecordBatch:
        entries = [e or (0, 0, 0, b"", b"") for e in self.entries]
        links = np.frombuffer(b"".join([e[3] for e in entries]), np.int64)
        sizes = np.array([len(e[3]) // 8 for e in entries], np.int64)
        counts = np.column_stack([np.array([e[:3] for e in entries], np.int64).reshape(-1, 3), sizes])
        codes, places = np.unique(links, return_inverse=True)
        said = [e[4] for e in entries]
        lengths = np.array([len(s) for s in self.sequences], np.int64)
        words = np.fromiter(itertools.chain.from_iterable(self.sequences), np.int64, lengths.sum())
        ends = np.cumsum(lengths)
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[words], 0)])
        totals = (upto[ends] - upto[ends - lengths]).tolist()
        narrow = words.astype("<u4")
        out = []
        for k, (key, sequence) in enumerate(zip(self.keys, self.sequences)):
            shown = hashlib.sha256(b";".join([said[w] for w in sequence])).hexdigest() if sequence else ""
            out.append((self.number, key, *totals[k], shown, narrow[ends[k] - lengths[k]:ends[k]].tobytes(), None, None, None, None))
        kind = "<u2" if len(codes) < 1 << 16 else "<u4"
        documents = self._documents(words, lengths, sizes, places, len(codes))
        head = (self.number, *[None] * 7, sizes.astype("<u4").tobytes(), places.astype(kind).tobytes(), codes, documents)
        columns = list(zip(*out, head))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)

    def _documents(self, words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, places: np.ndarray, n_codes: int) -> np.ndarray:
        """In how many documents each pair is linked: pairs are marked for some texts at a time."""
        out = np.zeros(n_codes, np.int64)
        first, ends, copies = np.cumsum(sizes) - sizes, np.cumsum(lengths), np.array(self.copies, np.int64)
        at_once = max(1, MARKS_AT_ONCE // max(1, n_codes))
        for low in range(0, len(lengths), at_once):
            high = min(len(lengths), low + at_once)
            own = words[ends[low] - lengths[low]:ends[high - 1]]
            owner = np.repeat(np.arange(high - low), lengths[low:high])
            links = sizes[own]
            stops = np.cumsum(links)
            at = np.repeat(first[own] - (stops - links), links) + np.arange(stops[-1] if len(stops) else 0)
            marks = np.zeros((high - low, n_codes), bool)
            marks[np.repeat(owner, links), places[at]] = True
            for text in range(high - low):
                out[marks[text]] += copies[low + text]
        return out


_NAMES = [part.split()[0] for part in BLOCKS.split(", ")]
_KINDS = [
    pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.binary(),
    pa.list_(pa.int64()), pa.list_(pa.int64())]


def text_key(text: str = "text"):
    """Digest by which equal texts meet again; null for texts without tokens from the start."""
    whole = F.col(text).cast("string")
    return F.when(whole != "", F.unhex(F.sha2(whole, 256)))


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Aligned distinct texts in blocks: a row per text, and a row per block with its links and its documents by pair. Written down."""
    default = vocabularies()
    paths = a_path or default[0], b_path or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared(*paths, settings)
        first = TaskContext.get().partitionId() << 32
        block, waiting, chars = _Block(first), [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                waiting.append(row)
                chars += len(row[1])
                if chars >= settings.at_once:
                    block.add(aligner, waiting)
                    waiting, chars = [], 0
                    if block.chars >= settings.block_chars:
                        yield block.rows()
                        block = _Block(block.number + 1)
        if waiting:
            block.add(aligner, waiting)
        if block.keys:
            yield block.rows()

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return cut_lineage(texts.select(text_key().alias("text_key"), "text", "copies").mapInArrow(run, BLOCKS))


def _totals(pairs: DataFrame) -> DataFrame:
    """Documents of each pair corpus-wide, and whether no other pair of its A id has more (an A id has at most B's vocabulary of pairs)."""
    totals = pairs.groupBy("code").agg(F.sum("docs").alias("n_docs"))
    a_id = F.shiftrightunsigned("code", B_BITS)
    return totals.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(a_id)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a_id, b_id, n_docs, best`` of all linked pairs of ids in ``blocks``."""
    pairs = aligned.where("codes is not null").select(F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    return _totals(pairs.select(F.col("p.codes").alias("code"), F.col("p.docs").alias("docs"))).select(
        F.shiftrightunsigned("code", B_BITS).cast("int").alias("a_id"),
        F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("b_id"), "n_docs", "best")


def text_measures(aligned: DataFrame) -> DataFrame:
    """Measures of each distinct text in ``blocks``."""
    heads = aligned.where("codes is not null")
    pairs = heads.select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "p")).select(
        "block", "place", F.col("p.codes").alias("code"), F.col("p.docs").alias("docs"))
    own = pairs.select("block", "place", "code").join(_totals(pairs.select("code", "docs")), "code")
    totals = own.groupBy("block").agg(F.collect_list(F.struct("place", "n_docs", "best")).alias("totals"))
    # Of a block there come first the totals of its pairs, then the links of its words, then its texts.
    kind = totals.schema["totals"].dataType
    rows = aligned.select(
        "block", F.when(F.col("codes").isNull(), 2).otherwise(1).alias("kind"), *_NAMES[1:10], F.lit(None).cast(kind).alias("totals"))
    first = totals.select("block", F.lit(0).alias("kind"), *(F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in _NAMES[1:10]), "totals")
    laid_out = rows.unionByName(first).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sums = [], np.zeros((0, 2), np.int64)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    totals = row["totals"]
                elif row["kind"] == 1:
                    sums, totals = _word_sums(row, totals), []
                else:
                    n_best, count_sum = sums[np.frombuffer(row["words"], "<u4")].sum(0).tolist()
                    out.append((*(row[n] for n in _NAMES[1:6]), n_best, count_sum, row["groups_sha256"]))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.binary(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=[p.split()[0] for p in MEASURES.split(", ")])

    return laid_out.mapInArrow(run, MEASURES)


def _word_sums(head: dict, totals: list[dict]) -> np.ndarray:
    """Best links and sum of documents over the links of every word of a block."""
    sizes = np.frombuffer(head["link_counts"], "<u4").astype(np.int64)
    places = np.frombuffer(head["link_places"], "<u2" if len(totals) < 1 << 16 else "<u4")
    by_pair = np.zeros((len(totals), 2), np.int64)
    for t in totals:
        by_pair[t["place"]] = t["best"], t["n_docs"]
    before = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(by_pair[places], 0)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def measures(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of all documents."""
    found = text_measures(blocks(docs, a_path, b_path, settings))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return ids.join(found, "text_key", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
