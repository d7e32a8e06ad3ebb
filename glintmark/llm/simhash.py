"""SimHash near-duplicates: fingerprints of word shingles, linked through one-wildcard variants of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import partitions, slices, texts
from glintmark.llm.components import components
from glintmark.session import settle

SEED = 42
BITS = 64
MOST_IDS, MOST_KEYS = 250_000, 100_000  # rows that are broadcast; the driver builds their table, of up to 17 and 8 MB


def fingerprint(text: str, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half of the shingle hashes have it; no words give zero."""
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(parts[i:] for i in range(words)), strict=False)]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text needs no more memory than this for its bits
        block = np.array(hashes[at:at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row; null text counts as empty and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame, distance: int) -> DataFrame:
    """Every fingerprint under each of its 64 keys: a segment with one of its bits left out.

    With ``distance // 2 + 1`` segments, two fingerprints within the distance differ by at most one bit in some
    segment, so they share the key that leaves this bit out. A key is the bit's number above the rest of the segment
    in one long; a single segment of 64 bits is hashed, which can only add candidates.
    """
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    spans = list(zip(edges, edges[1:], strict=False))
    shift = "CASE " + " ".join(f"WHEN bit < {hi} THEN shiftrightunsigned(fp, {lo})" for lo, hi in spans) + " END"
    width = "CASE " + " ".join(f"WHEN bit < {hi} THEN {(1 << (hi - lo)) - 1 if count > 1 else -1}L" for lo, hi in spans) + " END"
    place = "CASE " + " ".join(f"WHEN bit < {hi} THEN bit - {lo}" for lo, hi in spans) + " END"
    rest = f"({shift}) & ({width}) & ~shiftleft(1L, {place})"
    key = f"shiftleft(cast(bit AS bigint), 32) | ({rest})" if count > 1 else f"xxhash64(bit, {rest})"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).select(F.expr(key).alias("key"), "fp")


def _ball(radius: int) -> Column:
    """Array of the masks of at most ``radius`` (0 to 2) bits, made from bit numbers so that the plan stays small."""
    none, one = "array(0L)", "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    return F.expr(f"concat({', '.join([none, one, two][:radius + 1])})")


def _hub_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of crowded keys, in proportion to their number.

    Two fingerprints lie within the distance just when some 64-bit value lies within ``distance // 2`` of one and
    within the rest of the other. Every fingerprint is put at all such values, and at each value all are linked to
    the smallest of the near ones: each such link is a true one, and no true one is without its path.
    """
    near, far = distance // 2, distance - distance // 2
    at = fps.select("fp", F.explode(_ball(far)).alias("mask"))
    at = at.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"), (F.bit_count("mask") <= near).alias("near"))
    least = at.groupBy("hub").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND a IS NOT NULL")
    return at.join(least, "hub").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 2, crowd: int = 32, most_keys: int = MOST_KEYS) -> DataFrame:
    """``a`` and ``b``: links between distinct fingerprints of at most ``distance`` (0 to 3) differing bits.

    Keys are counted first, with a map-side step, so a hot key sends one row per task. A key of two gives its pair at
    once. Keys of more fetch their members; those up to ``crowd`` meet by an equality join and are verified; the
    fingerprints of more crowded keys are linked without pairs by ``_hub_links``, which keeps every connection, so
    no link is lost to the limit. The keys of more than two are broadcast while there are at most ``most_keys`` (84
    bytes or more each on the driver), else joined by shuffle; the result is the same.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    base = fps.select("fp").repartition(partitions(fps), "fp")
    shared = settle(_variants(base, distance).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "keys")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    out = shared.filter("n = 2").filter(within).select("a", "b")
    wanted = settle(shared.filter("n > 2").select("key", "n"), "wanted")
    count = wanted.count()
    if count:
        members = settle(_variants(base, distance).join(F.broadcast(wanted) if count <= most_keys else wanted, "key"), "members")
        few = members.filter(F.col("n") <= crowd).select("key", "fp")
        pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").filter("a < b").filter(within)
        many = members.filter(F.col("n") > crowd).select("fp").distinct()
        out = out.unionByName(pairs.select("a", "b")).unionByName(_hub_links(settle(many, "crowd"), distance))
    return settle(out.distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, crowd: int = 32) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id reachable over links, itself included), ``n_links`` of the fingerprint's links.

    Documents with the same fingerprint are one node, so copies are never expanded into pairs. ``n_links`` counts the
    links kept for a fingerprint, which in crowded keys are those to hubs. Null text counts as empty; texts without
    words have fingerprint zero and are linked like any other. Null ids get a component but never name one; where all
    of a component are null, so is its id. Repeated rows are returned each. No rows give no rows.
    """
    own = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select("fp"), distance, crowd)
    ends = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(found).withColumnRenamed("node", "fp")
    members = roots.join(nodes, "fp")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.select("fp", "root").join(ids, "root").join(ends, "fp").select("fp", "component_id", "n_links")
    table = settle(nodes.join(linked, "fp", "left").select("fp", F.when(F.col("n_links").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
                                                           F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return own.join(table, "fp").select("doc_id", "fp", "component_id", "n_links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, most_ids: int = MOST_IDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, columns unchanged.

    Rows that share an id are one document, which stays if one of them names its component; rows without an id
    cannot be named and stay. The ids that go are broadcast while there are at most ``most_ids`` (67 bytes or more
    each on the driver), so the texts are not shuffled; else they are joined by shuffle, with the same result.
    """
    return rows_that_stay(docs, near_duplicates(docs, id_col, text_col, words, distance).filter("doc_id IS NOT NULL"), id_col, most_ids)


def rows_that_stay(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", most_ids: int = MOST_IDS) -> DataFrame:
    """The rows of ``docs`` whose id names a component of ``found`` (``doc_id``, ``component_id``) or is not in it."""
    found = settle(found.select("doc_id", "component_id"), "found")
    stay = found.filter("doc_id = component_id").select("doc_id")
    gone = settle(found.filter("doc_id <> component_id").select("doc_id").distinct().join(stay, "doc_id", "left_anti").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= most_ids else gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
