"""Near-duplicate detection with 64-bit SimHash fingerprints.

Equal fingerprints are collapsed to their smallest id before any comparison, so a
group of exact copies costs one row per copy, never one row per pair of copies.

Stored prints are small files, and what is made of them (bucket rows, links, labels) is many times larger than the
planner takes it for: those sides are shuffled, never sent through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.functions.text import norm_fingerprint
from corpusfit.scale import by_shuffle, cut_lineage, salted_join, spread

#: Members of a chunk, and pairs looked at in one step: they bound a task's memory, not what is compared.
CHUNK = 512
PAIRS_AT_ONCE = 1_000_000
SHINGLE_CACHE = 300_000
TEXTS_AT_ONCE = 128


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Fingerprint of each text: weighted bit votes of the MD5 of its character shingles.

    Normalising runs in the JVM; the votes are NumPy sums over Arrow batches.
    """
    import numpy as np
    import pandas as pd

    prepared = spread(docs.select(id_col, text_col)).select(
        F.col(id_col).alias("id"),
        F.regexp_replace(norm_fingerprint(F.col(text_col)), r"(?U)\W+", "").alias("body"))

    def shingles_of(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For some texts: owner, shingle number and count of every distinct shingle, and the shingles by number."""
        joined, sizes = "".join(part), np.array([len(body) for body in part], np.int64)
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(part)), sizes)
        single = key = np.unique(np.frombuffer(joined.encode("utf-32-le"), "<u4"), return_inverse=True)[1].astype(np.int64)
        for k in range(1, min(width, len(key))):
            # Numbers of runs one character longer; numbers stay below the length of the texts, so products fit.
            key = np.unique(key[:-1] * (len(single) + 1) + single[k:], return_inverse=True)[1].astype(np.int64)
        at = np.flatnonzero(np.arange(len(key)) + width <= ends[owner[:len(key)]]) if len(single) >= width else np.zeros(0, np.int64)
        pairs, counts = np.unique(owner[at] * (len(key) + 1) + key[at], return_counts=True)
        numbers, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
        names = [joined[at[i]:at[i] + width] for i in first]
        renumbered = np.searchsorted(numbers, pairs % (len(key) + 1))
        short = [k for k, size in enumerate(sizes) if size < width]  # shorter texts are one shingle
        owners = np.concatenate([pairs // (len(key) + 1), np.array(short, np.int64)])
        which = np.concatenate([renumbered, len(names) + np.arange(len(short))])
        return owners, which, np.concatenate([counts, np.ones(len(short), np.int64)]), names + [part[k] for k in short]

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[str, int] = {}          # shingle -> row of ``signs``; texts share most shingles
        signs = np.zeros((1024, 64), dtype=np.float32)
        for batch in batches:
            prints, bodies = [], list(batch["body"])
            for at in range(0, len(bodies), TEXTS_AT_ONCE):
                part = bodies[at:at + TEXTS_AT_ONCE]
                owners, which, counts, names = shingles_of(part)
                fresh = [g for g in dict.fromkeys(names) if g not in place]
                if len(place) + len(fresh) > SHINGLE_CACHE:
                    place.clear()
                    fresh = list(dict.fromkeys(names))
                if fresh:
                    first = len(place)
                    while first + len(fresh) > len(signs):
                        signs = np.concatenate([signs, np.zeros_like(signs)])
                    digests = b"".join(hashlib.md5(g.encode("utf-8")).digest()[-8:] for g in fresh)
                    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(len(fresh), 64)
                    signs[first:first + len(fresh)] = bits * 2.0 - 1.0
                    place.update(zip(fresh, range(first, first + len(fresh))))
                rows = np.fromiter(map(place.__getitem__, names), np.int64, len(names))[which]
                order = np.argsort(owners, kind="stable")
                edges = np.searchsorted(owners[order], np.arange(len(part) + 1))
                for k in range(len(part)):
                    own = order[edges[k]:edges[k + 1]]
                    packed = np.packbits((counts[own].astype(np.float64) @ signs[rows[own]]) > 0)
                    prints.append(int.from_bytes(packed.tobytes(), "big", signed=True))
            yield pd.DataFrame({"id": batch["id"], "fp": np.array(prints, dtype=np.int64)})

    kind = prepared.schema["id"].dataType.simpleString()
    return prepared.filter(F.col("body").isNotNull()).mapInPandas(votes, f"id {kind}, fp long").select(
        F.col("id").alias(id_col), "fp")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _longs(values: list[int]) -> Column:
    # the smallest long has no literal of its own
    return F.expr("array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _masks(blocks: int, keep: int) -> list[int]:
    """Bit masks of every choice of ``keep`` out of ``blocks`` contiguous blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [_signed(sum(block[i] for i in chosen)) for chosen in combinations(range(blocks), keep)]


def representatives(fps: DataFrame, id_col: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct fingerprint: its smallest id."""
    return fps.filter(F.col("fp").isNotNull()).groupBy(*group, "fp").agg(F.min(id_col).alias("rep"))


def _dealt_out(reps: DataFrame, blocks: int, keep: int, group: Sequence[str]) -> DataFrame:
    """Bucket members in runs of bounded length: one row for each run that a member takes part in.

    A bucket holds the prints that agree in one choice of blocks. Its members fall into chunks by a hash, and every two chunks (and each
    chunk with itself) are a run of their own, so a bucket that a family of copies fills is many runs, dealt out one by one.
    """
    masks = _longs(_masks(blocks, keep))
    keyed = reps.select(
        *group, "fp", F.col("rep").cast("long").alias("rep"),
        F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("__choice", "__key"))
    key = [*group, "__choice", "__key"]
    met = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    chunks = F.ceil(F.col("__n") / CHUNK).cast("int")
    rows = keyed.join(by_shuffle(met), key).withColumn("__own", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn(
        "__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    run = [*key, "__low", "__high"]
    return rows.select(
        *key, F.least("__own", "__other").alias("__low"), F.greatest("__own", "__other").alias("__high"), "__own", "fp", "rep"
    ).repartition(*run).sortWithinPartitions(*run)


class _Runs:
    """Pairs within runs of sorted rows, worked out for many runs at once in NumPy."""

    def __init__(self, max_bits: int, blocks: int, keep: int):
        import numpy as np

        self.max_bits = np.uint8(max_bits)
        self.blocks = np.array(_masks(blocks, 1), np.int64).view(np.uint64)
        chosen = list(combinations(range(blocks), keep))
        self.chosen = np.array([sum(1 << k for k in c) for c in chosen], np.int64)
        # Blocks up to the last chosen one: a pair counts in the first choice that it agrees in.
        self.upto = np.array([(2 << c[-1]) - 1 for c in chosen], np.int64)

    def pairs(self, starts, size: int, choice, own, low, high, fp):
        """(i, j, bits) of rows of a run that are near, each pair of prints in one run only; runs begin at ``starts``."""
        import numpy as np

        ends = np.repeat(np.append(starts[1:], size), np.diff(np.append(starts, size)))
        after = ends - np.arange(size) - 1
        upto = np.cumsum(after)
        at = 0
        while at < size:
            # As many rows as give a bounded number of pairs, one at least.
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n = after[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            differ = fp[i] ^ fp[j]
            bits = np.bitwise_count(differ)
            near = np.flatnonzero((bits <= self.max_bits) & ((low[i] == high[i]) | (own[i] != own[j])))
            i, j, differ, bits = i[near], j[near], differ[near], bits[near]
            agree = sum(((differ & mask) == 0).astype(np.int64) << k for k, mask in enumerate(self.blocks))
            first = (agree & self.upto[choice[i]]) == self.chosen[choice[i]]
            yield i[first], j[first], bits[first]
            at = stop


def _whole_runs(batches, n_keys: int):
    """Batches cut at ends of runs; each comes with the places where its runs begin. A run has two chunks at most."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in range(n_keys):
            column = table.column(k)
            new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy() & ~(
                pc.is_null(column[1:]).to_numpy() & pc.is_null(column[:-1]).to_numpy())
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        kept = table.slice(int(starts[-1]))
    if kept is not None and kept.num_rows:
        yield kept, np.zeros(1, np.int64)


def _kinds(reps: DataFrame, group: Sequence[str]) -> str:
    return "".join(f"{g} {reps.schema[g].dataType.simpleString()}, " for g in group)


def block_pairs(reps: DataFrame, max_bits: int, blocks: int, keep: int, group: Sequence[str] = ()) -> DataFrame:
    """Pairs (a < b, bits) of fingerprints at most ``max_bits`` apart, optionally inside a group.

    ``max_bits`` changed bits leave at least ``blocks - max_bits`` blocks alone, so with ``keep`` not above that number every true pair
    agrees in one of the choices of blocks: the buckets are exact. The same plan serves every size of bucket and group.
    """
    import pyarrow as pa

    if keep > blocks - max_bits:
        raise ValueError("keep must not exceed blocks - max_bits")
    n = len(group)

    def find(batches):
        runs = _Runs(max_bits, blocks, keep)
        for table, starts in _whole_runs(batches, n + 4):
            choice, low, high, own, fp, rep = _columns(table, n)
            for i, j, bits in runs.pairs(starts, table.num_rows, choice, own, low, high, fp):
                owners = [table.column(g).combine_chunks().take(pa.array(i)) for g in range(n)]
                first, last = rep[i], rep[j]
                columns = [*owners, *(pa.array(x) for x in (_least(first, last), _most(first, last), bits.astype("int32")))]
                yield pa.RecordBatch.from_arrays(columns, names=[*group, "a", "b", "bits"])

    return _dealt_out(reps, blocks, keep, group).mapInArrow(find, f"{_kinds(reps, group)}a long, b long, bits int")


def _least(x, y):
    import numpy as np

    return np.minimum(x, y)


def _most(x, y):
    import numpy as np

    return np.maximum(x, y)


def _columns(table, n: int):
    """choice, low, high, own chunk, print and id of rows, as arrays."""
    import numpy as np

    plain = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in (n, n + 2, n + 3, n + 4, n + 5, n + 6)]
    plain[4] = plain[4].astype(np.int64).view(np.uint64)
    return plain


def block_links(reps: DataFrame, max_bits: int, blocks: int, keep: int, group: Sequence[str] = ()) -> DataFrame:
    """Per fingerprint and run: ``rep, n_links, least, root``, never more rows than members.

    ``n_links`` adds up over a fingerprint's runs to its number of near fingerprints, the smallest ``least`` is the smallest id among
    them, and (rep, root) join those that are connected within the run: together they connect exactly what the pairs connect.
    """
    import numpy as np
    import pyarrow as pa

    if keep > blocks - max_bits:
        raise ValueError("keep must not exceed blocks - max_bits")
    n = len(group)

    def find(batches):
        runs = _Runs(max_bits, blocks, keep)
        for table, starts in _whole_runs(batches, n + 4):
            size = table.num_rows
            choice, low, high, own, fp, rep = _columns(table, n)
            count, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
            label = np.arange(size)
            for i, j, _ in runs.pairs(starts, size, choice, own, low, high, fp):
                for x, y in ((i, j), (j, i)):
                    count += np.bincount(x, minlength=size)
                    np.minimum.at(least, x, rep[y])
                label = _joined(label, i, j)
            some = np.flatnonzero(count)
            owners = [table.column(g).combine_chunks().take(pa.array(some)) for g in range(n)]
            columns = [*owners, *(pa.array(x[some]) for x in (rep, count, least, rep[label]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "rep", "n_links", "least", "root"])

    return _dealt_out(reps, blocks, keep, group).mapInArrow(find, f"{_kinds(reps, group)}rep long, n_links long, least long, root long")


def _joined(label, i, j):
    """Labels after putting the ends of all pairs together: each label is the smallest place of its set."""
    import numpy as np

    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        for x in (i, j):
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_dup_pairs(fps: DataFrame, max_bits: int = 3, blocks: int = 6, id_col: str = "doc_id") -> DataFrame:
    """Near-duplicate links (a, b, bits).

    Between different fingerprints: one row per pair of their smallest ids. For copies of
    one fingerprint: one row from its smallest id to each copy (bits = 0). Any two documents
    are near-duplicates exactly if their smallest ids are equal or linked, so nothing is lost
    while the result stays linear in the number of copies. ``near_dup_links`` is linear in families of different prints too.
    """
    reps = cut_lineage(representatives(fps, id_col))
    near = block_pairs(reps, max_bits, blocks, blocks - max_bits)
    copies = salted_join(fps.filter(F.col("fp").isNotNull()), reps, "fp").filter(
        F.col(id_col) != F.col("rep")
    ).select(F.col("rep").alias("a"), F.col(id_col).alias("b"), F.lit(0).alias("bits"))
    return near.unionByName(copies)


def near_dup_same_owner(fps: DataFrame, owner: str, max_bits: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Links like ``near_dup_pairs`` inside each owner, with a wider tolerance: a block in eleven is left alone."""
    g = (owner,)
    reps = cut_lineage(representatives(fps, id_col, g))
    wide = block_pairs(reps, max_bits, max_bits + 1, 1, g)
    copies = salted_join(fps.filter(F.col("fp").isNotNull()), reps, [owner, "fp"]).filter(
        F.col(id_col) != F.col("rep")
    ).select(owner, F.col("rep").alias("a"), F.col(id_col).alias("b"), F.lit(0).alias("bits"))
    return wide.unionByName(copies)


def near_dup_links(
    fps: DataFrame, max_bits: int = 3, blocks: int = 6, keep: int | None = None, owner: str | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """One row per distinct fingerprint (and owner): ``rep, fp, n_links, least, root`` from ``block_links``, written down.

    ``least`` is the smallest id among its near fingerprints and itself; ``roots`` joins it with others of its group of links.
    """
    g = (owner,) if owner else ()
    reps = cut_lineage(representatives(fps, id_col, g))
    found = block_links(reps, max_bits, blocks, keep or blocks - max_bits, g).groupBy(*g, "rep").agg(
        F.sum("n_links").alias("n_links"), F.min("least").alias("least"), F.collect_set("root").alias("roots"))
    return cut_lineage(reps.join(by_shuffle(found), [*g, "rep"], "left").select(
        *g, "rep", "fp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.least("least", "rep").alias("least"),
        F.coalesce("roots", F.array().cast("array<bigint>")).alias("roots")))


def near_dup_classes(fps: DataFrame, links: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, rep, class_id, n_links`` per document: its print's smallest id, the smallest id of its group, and how many other prints are near."""
    edges = links.select(F.col("rep").alias("a"), F.explode("roots").alias("b")).where("a <> b")
    groups = dup_clusters(edges).select(F.col("doc_id").alias("rep"), "cluster_id")
    classes = links.join(by_shuffle(groups), "rep", "left").select("fp", "rep", F.coalesce("cluster_id", "rep").alias("class_id"), "n_links")
    return salted_join(fps.filter(F.col("fp").isNotNull()), classes, "fp").select(id_col, "rep", "class_id", "n_links")


def _earliest(links: DataFrame, fps: DataFrame, id_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Smallest earlier near-duplicate of each document."""
    homes = salted_join(fps.filter(F.col("fp").isNotNull()), links.select(*group, "fp", F.col("least").alias("first_id")), [*group, "fp"])
    return homes.filter(F.col("first_id") < F.col(id_col)).select(id_col, "first_id")


def dup_status(
    fps: DataFrame, links: DataFrame, owner_links: DataFrame | None = None, owner: str | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """duplicate / near_duplicate / unique per document in id order, with the earliest match; links are those of ``near_dup_links``."""
    out = fps.select(id_col).join(by_shuffle(_earliest(links, fps, id_col)), id_col, "left").withColumnRenamed("first_id", "__dup")
    if owner_links is not None:
        near = _earliest(owner_links, fps, id_col, (owner,)).withColumnRenamed("first_id", "__near")
        out = out.join(by_shuffle(near), id_col, "left")
    else:
        out = out.withColumn("__near", F.lit(None).cast("long"))
    return out.select(
        id_col,
        F.when(F.col("__dup").isNotNull(), "duplicate").when(F.col("__near").isNotNull(), "near_duplicate")
        .otherwise("unique").alias("status"),
        F.coalesce("__dup", "__near").alias("match_id"))


def first_come(fps: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, kept`` as one upload after another would decide: a document stays unless it is near one that stayed before it.

    Copies of a print never stay beside its first document. Among first documents, each round keeps those with no undecided
    earlier neighbour and drops the neighbours of what it keeps; a round's rows are written down, and only undecided pairs go on.
    The rounds needed are the longest chain of documents that hang on one another, a few for most data.
    """
    reps = cut_lineage(representatives(fps, id_col))
    open_pairs = cut_lineage(pairs.where("bits > 0").select("a", "b"))
    kept = reps.join(by_shuffle(open_pairs.select(F.col("b").alias("rep")).distinct()), "rep", "left_anti").select("rep")
    out = [kept]
    while open_pairs.limit(1).count():
        # Neighbours of kept documents are dropped, and with them all their pairs.
        first = cut_lineage(open_pairs.select(F.col("a").alias("x")).distinct().join(
            by_shuffle(open_pairs.select(F.col("b").alias("x")).distinct()), "x", "left_anti"))
        gone = open_pairs.join(by_shuffle(first.select(F.col("x").alias("a"))), "a", "left_semi").select(F.col("b").alias("x")).distinct()
        settled = cut_lineage(first.unionByName(gone))
        ends = cut_lineage(open_pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct())
        left = open_pairs
        for end in ("a", "b"):
            left = left.join(by_shuffle(settled.select(F.col("x").alias(end))), end, "left_anti")
        open_pairs = cut_lineage(left.select("a", "b"))
        # A document whose pairs are all settled, and that is not dropped, stays: no earlier neighbour of it has stayed.
        waiting = open_pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
        free = ends.join(by_shuffle(settled), "x", "left_anti").join(by_shuffle(waiting), "x", "left_anti")
        later = open_pairs.select(F.col("b").alias("x")).distinct()
        out += [free.select(F.col("x").alias("rep")), open_pairs.select(F.col("a").alias("x")).distinct().join(by_shuffle(later), "x", "left_anti").select(F.col("x").alias("rep"))]
    stays = out[0]
    for part in out[1:]:
        stays = stays.unionByName(part)
    return fps.filter(F.col("fp").isNotNull()).select(id_col).join(
        by_shuffle(stays.distinct().select(F.col("rep").alias(id_col), F.lit(True).alias("kept"))), id_col, "left").select(
        id_col, F.coalesce("kept", F.lit(False)).alias("kept"))


def dup_clusters(pairs: DataFrame) -> DataFrame:
    """Connected groups of the links: every member with the group's smallest id, which is kept.

    Each round takes the smallest label among neighbours (merged map-side) and then jumps
    to the label of the label, so long chains close in few rounds. Each round is written to
    the checkpoint folder.
    """
    edges = cut_lineage(
        pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        offered = salted_join(edges, labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(
            F.min("label").alias("__near"))
        low = labels.join(by_shuffle(offered), "u").select("u", F.col("label").alias("__old"), F.least("label", "__near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("__next"))
        moved = cut_lineage(salted_join(low, jump, "label").select(
            "u", "__old", F.least("label", "__next").alias("label")))
        changed = moved.filter(F.col("label") != F.col("__old")).limit(1).count()
        labels = moved.select("u", "label")
        if not changed:
            break
    return labels.select(
        F.col("u").alias("doc_id"), F.col("label").alias("cluster_id"), (F.col("u") == F.col("label")).alias("keep"))
