"""A trie of conversations over their turns: which beginnings are shared, by how many, and how many tokens sharing them saves.

A turn is a fixed-width id: the first 16 bytes of a digest of role and text, read as a big-endian number. A conversation is the string
of its turns' ids. Each task inserts its conversations into adaptive radix trees (``radix_tree``: four node layouts that grow, compressed
paths) of bounded size, folds counts upwards and emits only turn-aligned depths; a beginning that a third of all conversations share is
one row per tree. These rows are summed by node over the corpus, a node being named by the digest of the path to it.

Places of turns come from range partitions and offsets, not from a window over a conversation. A conversation longer than a segment
is cut into segments; the names of nodes are chained over the segments' digests, so no row holds more than a segment of a conversation.
Sums over subtrees double their reach every round (descendants up to 2, 4, 8, ... turns below), so a chain of n turns takes log2(n)
rounds and no node is sent to all its ancestors. Only nodes with two members or more take part: below them each single member adds one leaf.

The digest of the members that end at a node runs over their sorted ids, packed into strings before they meet.

Defined cases: a null role or text is empty; turns of equal number follow by role and text, null numbers first; a repeated row is
a turn of its own; turns without a conversation id belong to none and are left out; a very long turn counts by its id;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.llm.radix_tree import RadixTree, aligned_depths
from corpusfit.scale import cut_lineage

ID_BYTES = 16
ROOT = hashlib.sha256(b"").digest()[:ID_BYTES]
#: A conversation's own digits choose how many turns it takes over from the first of its hundred.
HUNDRED, MOST_TAKEN = 100, 5
PARTIAL = "node binary, parent binary, depth long, chars long, n_convs long, conv_id long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Settings:
    #: Turns in a row of a conversation, nodes of a tree in memory, ids in a packed string.
    segment: int = 128
    tree_nodes: int = 50_000
    packed_ids: int = 4096


def turn_id(role: Column, text: Column) -> Column:
    """Fixed-width id of a turn. The role's length keeps (role, text) apart from other splits of the same characters."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, id, chars`` with places from 0; no texts. Written down."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where(
        "conv_id is not null").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    laid_out = cut_lineage(
        turns.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", turn_id(F.col("role"), F.col("text")).alias("id"), F.length("text").cast("long").alias("chars"))
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # A conversation's rows in a partition, and those in the partitions before: one row per conversation and partition.
    own = laid_out.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = own.select("conv_id", "part", "first", F.expr("sum(n) over (partition by conv_id order by part) - n").alias("before"))
    return cut_lineage(laid_out.join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "id", "chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns from the first of their hundred: turns (conv_id, place, id, chars), and all conversations with sizes."""
    sizes = turns.groupBy("conv_id").agg((F.max("place") + 1).alias("own"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_TAKEN + 1)).cast("int")
    heads = turns.where(F.col("place") < MOST_TAKEN).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("head"))
    convs = cut_lineage(sizes.select("conv_id", "own", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base")).join(
        heads, "base", "left").select("conv_id", "own", "taken", F.expr("slice(coalesce(head, array()), 1, taken)").alias("given")))
    given = convs.select("conv_id", F.explode("given").alias("t")).select("conv_id", "t.place", "t.id", "t.chars")
    kept = turns.join(convs.select("conv_id", "taken", F.size("given").alias("n_given")), "conv_id").where("place >= taken").select(
        "conv_id", (F.col("place") - F.col("taken") + F.col("n_given")).alias("place"), "id", "chars")
    return given.unionByName(kept), convs.select(
        "conv_id", (F.size("given") + F.greatest(F.lit(0), F.col("own") - F.col("taken"))).cast("long").alias("turns"))


def _named(start: bytes, inner: bytes) -> bytes:
    """Name of the node that ``inner`` (digest of the ids since) leads to from ``start``."""
    return hashlib.sha256(start + inner).digest()[:ID_BYTES]


def segments(turns: DataFrame, convs: DataFrame, settings: Settings) -> DataFrame:
    """``conv_id, segment, ids, chars, start``: pieces of conversations, and the name of the node that a piece starts from. Written down."""
    pieces = turns.groupBy("conv_id", F.floor(F.col("place") / settings.segment).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("list"))
    rows = pieces.select(
        "conv_id", "segment", F.aggregate("list", F.lit(b""), lambda all_, t: F.concat(all_, t["id"])).alias("ids"),
        F.transform("list", lambda t: t["chars"]).alias("chars"))
    bare = convs.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("chars"))
    rows = cut_lineage(rows.unionByName(bare))
    long_ = convs.where(F.col("turns") > settings.segment).select("conv_id")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name = None, ROOT
        for batch in batches:
            convs_, numbers, digests = (batch.column(k).to_pylist() for k in range(3))
            starts = []
            for conv, digest in zip(convs_, digests):
                if conv != now:
                    now, name = conv, ROOT
                starts.append(name)
                name = _named(name, bytes(digest))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.binary())], names=["conv_id", "segment", "start"])

    # Only digests of segments come together, in order and one after another.
    starts = rows.join(long_, "conv_id", "left_semi").select("conv_id", "segment", F.unhex(F.sha2("ids", 256)).alias("digest")).repartition(
        "conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(chain, "conv_id long, segment long, start binary")
    return cut_lineage(rows.join(starts, ["conv_id", "segment"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT))))


def _partial_nodes(pieces: DataFrame, settings: Settings) -> DataFrame:
    """Nodes of each task's trees with members so far."""
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in PARTIAL.split(", ")]
    segment = settings.segment

    def out(tree: RadixTree, lengths: dict[bytes, int]) -> pa.RecordBatch:
        rows = []
        for path, (members, least, number) in aligned_depths(tree, ID_BYTES, _both):
            if len(path) < ID_BYTES:
                continue
            start, steps = path[:ID_BYTES], len(path) // ID_BYTES - 1
            if steps == 0:
                if number == 0:  # a later segment starts from a node that the one before has given
                    rows.append((start, None, 0, 0, members, least))
                continue
            node, parent = _path_name(path), _path_name(path[:-ID_BYTES])
            rows.append((node, parent, number * segment + steps, lengths[path[-ID_BYTES:]], members, least))
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, lengths = RadixTree(_both), {}
        for batch in batches:
            for conv, number, ids, chars, start in zip(*(batch.column(k).to_pylist() for k in range(5))):
                tree.insert(start + ids, (1, conv, number))
                lengths.update((ids[k * ID_BYTES:(k + 1) * ID_BYTES], n) for k, n in enumerate(chars))
                if tree.nodes + len(lengths) >= settings.tree_nodes:
                    yield out(tree, lengths)
                    tree, lengths = RadixTree(_both), {}
        yield out(tree, lengths)

    return pieces.select("conv_id", "segment", "ids", "chars", "start").mapInArrow(run, PARTIAL)


def _both(x: tuple, y: tuple) -> tuple:
    """Members, least member and segment number (the same for equal starts) of two sets of conversations."""
    return x[0] + y[0], min(x[1], y[1]), x[2]


def _path_name(path: bytes) -> bytes:
    """Name of the node at the end of ``start + ids``."""
    if len(path) == ID_BYTES:
        return path
    return _named(path[:ID_BYTES], hashlib.sha256(path[ID_BYTES:]).digest())


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` over subtrees, from each node's own ``leaves`` and ``saved``; a round doubles the reach."""
    state = cut_lineage(shared.select("node", F.col("parent").alias("up"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    while state.where("up is not null").limit(1).count():
        below = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jump = state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        state = cut_lineage(state.join(below, "node", "left").join(jump, "up", "left").select(
            "node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")))
    return state.drop("up")


def _ends(ends: DataFrame, settings: Settings) -> DataFrame:
    """``node, ends_sha256`` of nodes where conversations end (node, conv_id)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def packed() -> list[tuple]:
            return [(now, ids[0], ",".join(map(str, ids)))] if ids else []

        for batch in batches:
            rows = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now or len(ids) >= settings.packed_ids:
                    rows += packed()
                    now, ids = node, []
                ids.append(conv)
            yield _batch(rows, [pa.binary(), pa.int64(), pa.string()], ["node", "first", "ids"])
        yield _batch(packed(), [pa.binary(), pa.int64(), pa.string()], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            rows = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node == now:
                    running.update(b"," + ids.encode())
                else:
                    rows += [(now, running.hexdigest())] if running else []
                    now, running = node, hashlib.sha256(ids.encode())
            yield _batch(rows, [pa.binary(), pa.string()], ["node", "ends_sha256"])
        yield _batch([(now, running.hexdigest())] if running else [], [pa.binary(), pa.string()], ["node", "ends_sha256"])

    packed_ = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pack, "node binary, first long, ids string")
    return packed_.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _end_names(pieces: DataFrame, convs: DataFrame, settings: Settings) -> DataFrame:
    """``node, conv_id``: the node at which each conversation ends, in the last of its segments."""
    last = F.floor(F.greatest(F.lit(0), F.col("turns") - 1) / settings.segment)
    inner = F.unhex(F.sha2("ids", 256))
    node = F.when(F.octet_length("ids") == 0, F.col("start")).otherwise(
        F.unhex(F.substring(F.sha2(F.concat("start", inner), 256), 1, 2 * ID_BYTES)))
    return pieces.join(convs.select("conv_id", last.alias("segment")), ["conv_id", "segment"]).select(node.alias("node"), "conv_id")


def nodes(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie."""
    turns, convs = rebuilt(placed_turns(conversations))
    pieces = segments(turns, convs, settings)
    whole = cut_lineage(_partial_nodes(pieces, settings).groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    shared = F.col("n_convs") >= 2
    children = whole.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(~shared).alias("single"))
    all_ = whole.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # A node of one member has one leaf below (or is it) and saves nothing.
    tops = all_.where(shared).select(
        "node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("single", F.lit(0))).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = _subtree_sums(tops)
    parents = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(_end_names(pieces, convs, settings), settings)
    return all_.join(sums, "node", "left").join(ends, "node", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
