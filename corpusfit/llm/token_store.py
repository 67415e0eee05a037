"""Token ids in binary files, each document compressed on its own with a shared dictionary.

Layout of a store (a folder of the shared file system):

* ``dictionary-<sha256>.zdict``: zstandard dictionary trained on serialized id arrays of a bounded sample of documents;
* ``part-<bucket>.bin``: magic, dictionary hash, then one frame per document, and at the end the index: an array of
  (document id, offset of the frame, ids before it in the file, number of ids) followed by its size. An id array is serialized as
  little-endian unsigned 16-bit integers when the vocabulary allows, else 32-bit; the first byte of a frame's content says which;
* ``manifest`` (a table written by Spark): bucket, first and last document id, documents, ids, dictionary hash.

One document is read with one look at its file's index and one frame, without touching its neighbours.

Buckets are ranges of document ids with about equal numbers of documents (from approximate percentiles of the id
column alone). Texts are tokenized and compressed where they are read; only compressed frames are shuffled, to their
bucket, and sorted there. A file is written under a name of the attempt and renamed, so a repeated task leaves one whole file.

Defined cases: null or empty texts are the end id alone; documents with equal ids follow by their ids' checksum; a null document id
comes first; an empty table gives a store without files and no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfit.llm import word_tokens
from corpusfit.scale import cut_lineage, ensure_checkpoint_dir

MAGIC = b"TOKS0001"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("before", "<u8"), ("count", "<u8"), ("null_id", "<u1")])
MANIFEST = "bucket int, path string, documents long, ids long"


@dataclass(frozen=True)
class Settings:
    end_id: int = 2
    level: int = 3
    dictionary_bytes: int = 112_640
    sample_documents: int = 4_000
    #: Ids of a document that the dictionary is trained on at most; encoding always takes all.
    sample_ids: int = 1_024
    documents_per_file: int = 10_000
    most_files: int = 8_192


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or of an absolute path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def serialized(ids: np.ndarray) -> bytes:
    narrow = len(ids) == 0 or int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())


def deserialized(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train_dictionary(docs: DataFrame, path: str, settings: Settings) -> bytes:
    """A dictionary from the serialized ids of at most ``sample_documents`` documents (chosen by hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [serialized(ids[:settings.sample_ids]) for ids in word_tokens.shared(path).encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["ids"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    count = ids.count()
    share = max(1, count // settings.sample_documents)
    chosen = _texts(docs).where(F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(share)) == 0)
    texts = chosen.select(F.substring("text", 1, 16 * settings.sample_ids).alias("text")).limit(2 * settings.sample_documents)
    samples = sorted(bytes(r.ids) for r in texts.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: their contents serve as they are
        return b"".join(samples)[:settings.dictionary_bytes]


@functools.lru_cache(maxsize=2)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_store(docs: DataFrame, folder: str, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Write a store below ``folder`` and return its manifest."""
    spark, path = docs.sparkSession, path or word_tokens.vocabulary()
    data = train_dictionary(docs, path, settings)
    name = hashlib.sha256(data).hexdigest()
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/dictionary-{name}.zdict") as out:
        out.write(data)
    end = np.array([settings.end_id], "<u4")
    shared = spark.sparkContext.broadcast(data)  # of a fixed size at most

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    wanted = max(1, -(-total // settings.documents_per_file), min(total, spark.sparkContext.defaultParallelism))
    files = min(settings.most_files, wanted)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 10 * files)).first()[0] if files > 1 else []
    edges = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=settings.level, dict_data=_dictionary(shared.value))
        for batch in batches:
            rows = []
            for own in word_tokens.shared(path).encode(batch.column(1)):
                own = np.concatenate([own, end])
                rows.append((len(own), zlib.crc32(own.tobytes()), packer.compress(serialized(own))))
            counts, sums, frames = zip(*rows) if rows else ((), (), ())
            # Ids up to the first edge go to bucket 0, and so do null ids.
            places = [0 if d is None else int(np.searchsorted(edges, d)) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(frames, pa.binary()),
                 pa.array(places, pa.int32())], names=["doc_id", "count", "crc", "frame", "bucket"])

    frames = _texts(docs).mapInArrow(encode, "doc_id long, count long, crc long, frame binary, bucket int")
    # Buckets are dealt by their number, one to a task; a hash would put several on one.
    laid_out = frames.repartitionById(files, "bucket").sortWithinPartitions("bucket", "doc_id", "crc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for doc_id, count, _, frame, bucket_ in zip(*columns):
                if out is None or out.bucket != bucket_:
                    if out:
                        rows.append(out.close())
                    out = _FileWriter(folder, bucket_, name)
                out.add(doc_id, count, frame)
        if out:
            rows.append(out.close())
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "path", "documents", "ids"])

    manifest = f"{folder}/manifest"
    laid_out.mapInArrow(write, MANIFEST).withColumn("dictionary", F.lit(name)).write.parquet(manifest)
    return spark.read.parquet(manifest)


class _FileWriter:
    """One file of a store; it appears under its name when it is whole."""

    def __init__(self, folder: str, bucket: int, dictionary: str):
        self.bucket = bucket
        self.system, base = file_system(folder)
        self.final = f"{base}/part-{bucket:06d}.bin"
        self.attempt = f"{self.final}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.attempt)
        self.out.write(MAGIC + bytes.fromhex(dictionary))
        self.offset, self.ids, self.entries = len(MAGIC) + 32, 0, []

    def add(self, doc_id: int | None, count: int, frame: bytes) -> None:
        self.entries.append((doc_id or 0, self.offset, self.ids, count, doc_id is None))
        self.out.write(frame)
        self.offset += len(frame)
        self.ids += count

    def close(self) -> tuple[int, str, int, int]:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(struct.pack("<QQ", self.offset, len(self.entries)))
        self.out.close()
        self.system.move(self.attempt, self.final)
        return self.bucket, os.path.basename(self.final), len(self.entries), self.ids


class StoreFile:
    """A file of a store, opened for reading; frames are read one by one."""

    def __init__(self, folder: str, name: str):
        self.system, base = file_system(folder)
        self.file = self.system.open_input_file(f"{base}/{name}")
        size = self.file.size()
        end, count = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, end), ENTRY)
        self.ends = np.append(self.index["offset"][1:], end)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no token file")
        with self.system.open_input_stream(f"{base}/dictionary-{head[len(MAGIC):].hex()}.zdict") as f:
            data = f.read()
        if hashlib.sha256(data).digest() != head[len(MAGIC):]:
            raise ValueError("the dictionary is not the one the file was written with")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def frames(self, at_once: int = 4_000_000) -> Iterator[tuple[int, bytes]]:
        """Every frame with its place, read in bounded pieces."""
        k = 0
        while k < len(self.index):
            start = int(self.index["offset"][k])
            stop = max(k + 1, int(np.searchsorted(self.ends, start + at_once, "right")))
            data = self.file.read_at(int(self.ends[stop - 1]) - start, start)
            for i in range(k, stop):
                yield i, data[int(self.index["offset"][i]) - start:int(self.ends[i]) - start]
            k = stop

    def ids(self, doc_id: int) -> np.ndarray:
        """Ids of one document."""
        own = self.index["doc_id"] if not self.index["null_id"].any() else np.where(self.index["null_id"] == 1, -1 << 62, self.index["doc_id"])
        k = int(np.searchsorted(own, doc_id))
        if k == len(own) or own[k] != doc_id:
            raise KeyError(doc_id)
        start = int(self.index["offset"][k])
        return deserialized(self.unpacker.decompress(self.file.read_at(int(self.ends[k]) - start, start)))

    def close(self) -> None:
        self.file.close()


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the files; ``start`` counts the ids of all documents before."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row per file: running totals over files, not over documents.
    starts = manifest.select("bucket", "path", F.expr("sum(ids) over (order by bucket) - ids").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, rows = StoreFile(folder, path), []

                def out() -> pa.RecordBatch:
                    columns = list(zip(*rows)) or [()] * 4
                    rows.clear()
                    return pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

                for k, frame in store.frames():
                    entry = store.index[k]
                    ids = deserialized(store.unpacker.decompress(frame))
                    doc_id = None if entry["null_id"] else int(entry["doc_id"])
                    rows.append((doc_id, first + int(entry["before"]), len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) >= 10_000:
                        yield out()
                yield out()
                store.close()

    spread = cut_lineage(starts).repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
