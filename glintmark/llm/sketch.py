"""Document fingerprints: threshold-scaled sketches of word shingles, mergeable and comparable at very unequal sizes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import partitions, slices, texts
from glintmark.llm.encoding import Words

SCALE = 8
LEAST = 16
_TOP = np.uint64(2**64 - 1)


def _threshold(scale: int) -> np.uint64:
    return np.uint64((2**64 - 1) // scale)


class Sketcher:
    """``sketch(text)``: the sorted shingle hashes below 2^64 / ``scale``.

    A text with fewer than ``least`` such hashes keeps its ``least`` smallest, so that short texts stay comparable;
    both rules can be applied again to the union of two sketches, which makes sketches mergeable.
    """

    def __init__(self, words: int = 5, scale: int = SCALE, least: int = LEAST, most: int = 300_000):
        self.words, self.scale, self.least = words, scale, least
        self.known = Words(lambda w: xxhash.xxh64_intdigest(w), most)
        rng = np.random.default_rng(42)
        self.factors = rng.integers(1, 2**63, size=words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, text: str) -> np.ndarray:
        """A hash of each shingle of ``words`` words; fewer words are one shingle, none give none."""
        parts = text.encode("utf-8").lower().split()
        known = self.known
        own = np.array([known[w] for w in parts], dtype=np.uint64)
        n = min(self.words, len(own))
        if not n:
            return own
        total = np.full(len(own) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            total += own[j:len(own) - n + 1 + j] * self.factors[j]
        total ^= total >> np.uint64(30)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(27)
        total *= np.uint64(0x94D049BB133111EB)
        return total ^ (total >> np.uint64(31))

    def keep(self, hashes: np.ndarray) -> np.ndarray:
        below = np.unique(hashes[hashes < _threshold(self.scale)])
        return below if len(below) >= self.least else np.unique(hashes)[:self.least]

    def sketch(self, text: str) -> np.ndarray:
        return self.keep(self.hashes(text))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sketch of the union of two shingle sets."""
        return self.keep(np.concatenate([a, b]))

    def _reach(self, s: np.ndarray) -> np.uint64:
        """Hash up to which the sketch holds every shingle of its text."""
        if len(s) < self.least:
            return _TOP
        return max(_threshold(self.scale) - np.uint64(1), s[-1])

    def shares(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        """Shingles of a, of b and of both, up to the hash that both sketches cover."""
        top = min(self._reach(a), self._reach(b))
        a, b = a[a <= top], b[b <= top]
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated Jaccard similarity; two texts without words are alike, one without words is like no other."""
        n, m, both = self.shares(a, b)
        return both / (n + m - both) if n + m else float(len(a) == len(b))

    def containment(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated share of a's shingles that b has, however long b is."""
        n, _, both = self.shares(a, b)
        return both / n if n else float(not len(a))


def written(sketch: np.ndarray) -> str:
    """Sketch as text: 16 hex digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, words: int = 5, scale: int = SCALE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row. Null text counts as empty; texts without words have an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(words, scale, least)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(sketcher.sketch(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the start of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are smaller: first whole blocks of them, then inside one block, so a row compares with 2 x sqrt of their number."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]

    def literal(x: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(x)), kind)

    def smaller(x: Column) -> Column:
        return F.size(F.filter(x, lambda c: c < value))

    whole = smaller(literal([b[-1] for b in blocks], "array<bigint>"))
    inside = F.coalesce(F.get(literal(blocks, "array<array<bigint>>"), whole), F.array().cast("array<bigint>"))
    return F.least(whole * width, F.lit(len(cuts))) + smaller(inside)


def _in_order(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of (doc_id, text) dealt to ranges of descending id and sorted there, each range ended by a copy of the next range's first row.

    ``range`` numbers the ranges, ``ahead`` marks the copies. The driver sees one id per range. Null ids come last;
    rows with the same id are ordered by a hash of their text.
    """
    spark = rows.sparkSession
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    number = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _below(cuts, F.col("doc_id"))).cast("int")
    ranged = rows.select(number.alias("range"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("first")).collect())
    own = ranged.withColumn("ahead", F.lit(False))
    if not firsts:
        return own
    goes_to = {n: firsts[i - 1][0] for i, (n, _) in enumerate(firsts)}  # the first range's first row ends the last range
    top = ranged.join(F.broadcast(spark.createDataFrame([(n, goes_to[n], first) for n, first in firsts], "range int, to int, first long")), "range")
    top = top.filter(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("to", "doc_id").agg(F.min(F.struct("tie", "text")).alias("x"))
    heads = top.select(F.col("to").alias("range"), "doc_id", "x.tie", "x.text", F.lit(True).alias("ahead"))
    return own.unionByName(heads).repartition(max(1, parts // 4), "range").sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), "tie")


def edited_fingerprints(docs: DataFrame, words: int = 5, scale: int = SCALE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The edited text has its last third replaced by the start of the next document in descending id (after the last:
    the first). Texts are shuffled once, by ranges of ids. ``near_edited`` and ``near_next`` are estimated Jaccard
    similarities from the fingerprints alone. Null text counts as empty. A lone row follows itself. Null ids come
    last; rows of one id are ordered by a hash of their text, repeated rows count each. No rows give no rows.
    """
    rows = texts(docs, id_col, text_col)
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
             ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(words, scale, least)
        held = None  # id, text and sketch of the row before, which waits for this one
        for b in slices(batches):
            out: list[tuple] = []
            for ahead, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sketcher.sketch(text)
                if held is not None:
                    edit = edited_text(held[1], text)
                    edited = sketcher.sketch(edit)
                    out.append((held[0], len(held[1]), hashlib.sha256(edit.encode()).hexdigest(), written(held[2]), written(edited),
                                sketcher.likeness(held[2], edited), sketcher.likeness(held[2], own)))
                held = None if ahead else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    ordered = _in_order(rows, min(4 * partitions(docs), 1 << 16)).select("ahead", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
