"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import slices, texts
from glintmark.llm.encoding import Encoder, shared
from glintmark.session import settle

SHARD_ROWS = 1 << 15
WORDS = 300_000  # words that a worker keeps with their ids, from task to task


class _Stock:
    """Unpacked pieces by length: the longest that fits, and the two that fit best together."""

    def __init__(self, lengths: list[int]):
        self.rows = defaultdict(list)
        for i, n in enumerate(lengths):
            self.rows[n].append(i)
        self.lengths = sorted(self.rows)

    def take(self, length: int) -> int:
        row = self.rows[length].pop()
        if not self.rows[length]:
            self.lengths.pop(bisect_left(self.lengths, length))
        return row

    def put(self, length: int, row: int) -> None:
        if not self.rows[length]:
            insort(self.lengths, length)
        self.rows[length].append(row)

    def fit(self, gap: int) -> int | None:
        """Longest length that is at most ``gap``."""
        at = bisect_right(self.lengths, gap)
        return self.lengths[at - 1] if at else None

    def two(self, gap: int, over: int) -> tuple[int, int] | None:
        """Two lengths with the largest sum that is at most ``gap`` and more than ``over``; two pointers over the distinct lengths."""
        best, found = over, None
        lo, hi = 0, bisect_right(self.lengths, gap) - 1
        while lo <= hi:
            a, b = self.lengths[lo], self.lengths[hi]
            if a + b > gap:
                hi -= 1
                continue
            if a + b > best and (lo < hi or len(self.rows[a]) > 1):
                best, found = a + b, (a, b)
                if best == gap:
                    break
            lo += 1
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers. Each bin is filled greedily with the longest piece that fits; while it has a gap, its smallest
    piece is given back for two unpacked ones that fill the widened gap more tightly."""
    stock, bins = _Stock(lengths), []
    while stock.lengths:
        used, members = 0, []
        while (n := stock.fit(capacity - used)) is not None:
            members.append((n, stock.take(n)))
            used += n
        while used < capacity and len(members) > 1 and stock.lengths:
            small, row = min(members)
            pair = stock.two(capacity - used + small, small)
            if pair is None:
                break
            members.remove((small, row))
            members += [(n, stock.take(n)) for n in pair]
            stock.put(small, row)
            used += sum(pair) - small
        bins.append([row for _, row in members])
    return bins


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int | None = 0, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text and its end id: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` if asked for.

    Only longer documents are cut, and each piece but the last is full. Null text counts as empty: a piece of the end id.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(Encoder, vocabulary, WORDS)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts(docs, id_col, text_col).mapInArrow(run, kind)


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt to shards of about ``shard_rows`` rows by a hash of all their values and a random salt written
    with them, so neither a large corpus nor a document with many pieces or repeated rows makes a large shard, and a
    shard holds lengths and no ids. A shard leaves at most one sequence badly filled. The number of shards follows
    the count of pieces. Pieces as long as the capacity are sequences of their own.
    """
    salted = settle(pieces.withColumn("_salt", F.floor(F.rand(7) * (1 << 40)).cast("long")), "pieces")
    shards = max(1, -(-salted.count() // shard_rows))
    names = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("_salt", "ascending")])
        lengths = table["length"].to_pylist()
        number, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, rows in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for r in rows:
                number[r], place[r] = k, at
                at += lengths[r]
        number += table["_shard"][0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(place))

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return salted.withColumn("_shard", F.pmod(F.xxhash64("_salt"), F.lit(shards)).cast("long")).groupBy("_shard").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every packed sequence, from pieces that carry ``ids``; a sequence has at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int | None = 0, shard_rows: int = SHARD_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: see ``token_pieces`` and ``pack``.

    Null text counts as empty; null ids and repeated rows are packed each; no rows give no rows.
    """
    return pack(token_pieces(docs, vocabulary, capacity, end_id, False, id_col, text_col), capacity, shard_rows)
