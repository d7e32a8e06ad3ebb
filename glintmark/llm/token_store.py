"""Token-id files: documents in id order, each compressed by itself with a shared zstandard dictionary.

A file is a Parquet table with one row per block: ``blob`` (the frames one after the other), the offset index of the
block (``doc_ids``, ``offsets``, ``sizes``, ``n_tokens``), ``start`` (ids in the documents before the block),
``first_id``, ``last_id`` and ``dictionary`` (its hash). The dictionary lies beside the blocks. A reader of one short
document opens the blocks whose id range holds it, cuts its frame at the offset and decompresses that alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintmark.llm.common import chosen, partitions, slices, texts
from glintmark.llm.encoding import Encoder, shared
from glintmark.session import Scratch

BLOCK_BYTES = 1 << 20
_BLOCK = "part int, block int, dictionary string, item_bytes int, first_id long, last_id long, doc_ids array<long>, offsets array<long>, sizes array<int>, n_tokens array<int>, rel_start long, blob binary"


def _width(vocabulary: str) -> int:
    """Bytes of an id on disk: two where all ids fit."""
    return 2 if shared(Encoder, vocabulary).library.get_vocab_size() <= 1 << 16 else 4


def _serialised(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int | None = 0, samples: int = 1000, sample_bytes: int = 8192, size: int = 65536,
                     id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from the id arrays of ``samples`` documents, those with the smallest hash of their id.

    At most ``samples`` x ``sample_bytes`` bytes reach the driver; only the training sees shortened arrays. Too few
    or too small samples give no dictionary: empty bytes, and frames are then compressed without one.
    """
    some = chosen(texts(docs, id_col, text_col), samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = shared(Encoder, vocabulary), _width(vocabulary)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_serialised(encoder.ids(t) + tail, width)[:sample_bytes] for t in b.column(1).to_pylist()], pa.binary())], ["ids"])

    arrays = [bytes(r["ids"]) for r in some.mapInArrow(run, "ids binary").collect()]
    if sum(map(len, arrays)) < 8 * size or len(arrays) < 16:
        size = sum(map(len, arrays)) // 8
    if len(arrays) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # samples too alike to learn from
        return b""


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, level: int = 3, block_bytes: int = BLOCK_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the files under ``path`` in ascending id order.

    Null text counts as empty and has the end id alone. Null ids come first; rows with the same id are ordered by a
    hash of their text, and repeated rows are written each. No rows give a store without blocks.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, end_id, id_col=id_col, text_col=text_col)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.range(1).select(F.lit(bytearray(dictionary)).alias("bytes"), F.lit(mark).alias("sha256")).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, width, part = shared(Encoder, vocabulary), _width(vocabulary), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        frames, ids, counts, size, block, start = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            sizes = [len(f) for f in frames]
            known = [i for i in ids if i is not None]
            row = {"part": part, "block": block, "dictionary": mark, "item_bytes": width, "first_id": min(known, default=None), "last_id": max(known, default=None),
                   "doc_ids": ids, "offsets": (np.cumsum([0, *sizes])[:-1]).tolist(), "sizes": sizes, "n_tokens": counts, "rel_start": start, "blob": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = encoder.ids(text) + tail
                frame = packer.compress(_serialised(raw, width))
                if frames and size + len(frame) > block_bytes:
                    yield flush()
                    start, block, size = start + sum(counts), block + 1, 0
                    frames, ids, counts = [], [], []
                frames.append(frame)
                ids.append(doc_id)
                counts.append(len(raw) // 4)
                size += len(frame)
        if frames:
            yield flush()

    ordered = texts(docs, id_col, text_col).repartitionByRange(partitions(docs), "doc_id").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("item_bytes", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())),
    ("rel_start", pa.int64()), ("blob", pa.binary())])


def _dictionary(spark: SparkSession, path: str) -> bytes:
    """The store's dictionary (its size is bounded by the training), checked against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row["bytes"])).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return bytes(row["bytes"])


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``ids_crc32``.

    With ``doc_id`` only the blocks that may hold it are read, and only its frame is decompressed.
    """
    dictionary = _dictionary(spark, path)
    mark = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row per written file: the broadcast below is bounded by their number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in slices([batch], 1):
                r = row.to_pylist()[0]
                if r["dictionary"] != mark:
                    raise ValueError("the block was written with another dictionary")
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids": [], "ids_crc32": []}
                at = r["start"]
                for i, offset, size, n in zip(r["doc_ids"], r["offsets"], r["sizes"], r["n_tokens"], strict=True):
                    if doc_id is None or i == doc_id:
                        ids = np.frombuffer(opener.decompress(r["blob"][offset:offset + size]), f"<u{r['item_bytes']}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError("a frame is damaged")
                        for name, value in zip(out, (i, at, n, ids.tobytes(), zlib.crc32(ids)), strict=True):
                            out[name].append(value)
                    at += n
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())]))

    if doc_id is not None:
        blocks = blocks.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    placed = blocks.join(F.broadcast(before), "part").select("dictionary", "item_bytes", "doc_ids", "offsets", "sizes", "n_tokens", (F.col("rel_start") + F.col("base")).alias("start"), "blob")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def stored_tokens(docs: DataFrame, vocabulary: str, **kwargs) -> DataFrame:
    """Write ``docs`` to a fresh folder under the shared one and read it back."""
    path = Scratch(docs.sparkSession, "tokens").root
    write_tokens(docs, path, vocabulary, **kwargs)
    return read_tokens(docs.sparkSession, path)
