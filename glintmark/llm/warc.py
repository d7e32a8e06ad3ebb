"""WARC archives written and read with Spark's text files, and record boundaries verified as chains.

A record starts with the magic ``WARC/1.1`` and its length is in its header, so each record names the offset of its
successor. Payloads may hold the magic too. Reading cuts files at every magic (any byte range of a file can be cut by
itself), each task emits candidates with their successor offsets, and only candidates on the chain from the start of
the file are records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintmark.session import Scratch, settle

MAGIC = b"WARC/1.1\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100,
               compression: str = "gzip") -> None:
    """A record per row of ``pages``: response with the payload, or revisit of the response with an equal payload.

    Payloads are the html in UTF-8, null as empty. Of rows with equal payloads of at least ``least_bytes`` bytes the
    one with the smallest id is the response; rows that share this id and payload are responses too, since none may
    revisit itself; where all ids are null all are responses. Digests alone are grouped. Line ends in urls are
    percent-encoded; a null url or id leaves its header line out. The text sink ends every value with the two line
    ends that close a record. No rows give no files but the folder.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    first = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, "digest", "left").withColumn("is_response", F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def record_id(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(F.col("is_response"), F.col("html")).otherwise(F.lit("")))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(F.col("is_response"), F.lit("response")).otherwise(F.lit("revisit")), F.lit("\r\n"),
        _line("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.lit("<urn:page:none>"))), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("is_response"), F.lit("")).otherwise(F.concat(_line("WARC-Refers-To", record_id(F.col("first_id"))), F.lit(f"WARC-Profile: {_PROFILE}\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


_CANDIDATE = "file string, split long, rel long, total long, run long, jump long, page_id long, url string, record_type string, refers_to long, named string, digest string, size long, whole boolean"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _page(value: bytes | None) -> int | None:
    m = _PAGE.fullmatch(value or b"")
    return int(m[1]) if m else None


def parse_record(segment: bytes) -> dict | None:
    """Header fields of a segment that follows the magic, the length of its record (magic included) and, if the whole record is here, payload figures."""
    end = segment.find(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(segment[:end])} if end >= 0 else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18 or b"warc-type" not in fields:
        return None
    block = segment[end + 4:end + 4 + int(length)]
    out = {"length": len(MAGIC) + end + 4 + int(length) + 4, "page_id": _page(fields.get(b"warc-record-id")), "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") if b"warc-target-uri" in fields else None,
           "record_type": fields[b"warc-type"].decode("utf-8", "replace"), "refers_to": _page(fields.get(b"warc-refers-to")),
           "named": fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("utf-8", "replace"), "digest": None, "size": None, "whole": len(block) == int(length)}
    if out["record_type"] == "response" and out["whole"]:
        out |= payload_figures(block)
    return out


def payload_figures(block: bytes) -> dict:
    """Digest and size of what follows the HTTP header of a record's block."""
    body = block.partition(b"\r\n\r\n")[2]
    return {"digest": hashlib.sha256(body).hexdigest(), "size": len(body)}


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every magic: ``file``, ``split`` (where the reader's byte range begins), ``value`` in order inside a split."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("split"), F.col("value").cast("binary").alias("value"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, split, offset inside the split, segment, whether it is the first of the file)."""
    at, here = 0, None
    for b in batches:
        for file, split, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, split) != here:
                at, here = 0, (file, split)
            yield file, split, at, value, at == 0 and split == 0
            at += len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per magic found; candidates that name the next one form a run, ``jump`` is the successor named by a run's last one.

    ``rel`` is counted from the split's first magic's end, so that a record's own magic starts at ``rel`` - 10.
    ``total`` is the number of bytes of the split seen so far; its largest value is the length that the split covers.
    """
    names = [c.split(" ")[0] for c in _CANDIDATE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in _CANDIDATE.split(", ")])
    rows: list[dict] = []
    here, run, due = None, 0, None

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)
        rows.clear()
        return batch

    for file, split, at, value, opening in _ordered(batches):
        if (file, split) != here:
            here, due = (file, split), None
        record = None if opening else parse_record(value)
        if record is None or due != at:
            run = at  # an unreadable segment is a run of its own, and so is one that its neighbour does not name
        due = None if record is None else at + record["length"]
        rows.append({"file": file, "split": split, "rel": at, "total": at + len(value) + len(MAGIC), "run": run, "jump": due} | (record or {}))
        if len(rows) >= 4096:
            yield out()
    if rows:
        yield out()


def _reached(runs: DataFrame) -> DataFrame:
    """Runs on the chain from the start of their file, and the offset at which each is entered, by pointer jumping.

    ``runs`` has ``file``, ``head`` (offset of the first candidate), ``next`` (head of the run that the last one names)
    and ``entry`` (offset named there). A round doubles the length of all jumps, so rounds grow with the log of the
    number of runs in a file, and a run is about a byte range of the reader.
    """
    spark = runs.sparkSession
    scratch = Scratch(spark, "chain")
    jumps = scratch.save(runs.select("file", F.col("head").alias("node"), F.col("next").alias("to")).filter("to IS NOT NULL"), "j0")
    seen = scratch.save(runs.filter("head = 0").select("file", F.col("head").alias("node")), "s0")
    count, turn = seen.count(), 0
    while True:
        turn += 1
        more = seen.join(jumps, ["file", "node"]).select("file", F.col("to").alias("node"))
        seen = scratch.save(seen.unionByName(more).distinct(), f"s{turn}")
        scratch.drop(f"s{turn - 1}")
        now = seen.count()
        if now == count:
            return seen
        count = now
        far = jumps.withColumnRenamed("to", "mid").join(jumps.select("file", F.col("node").alias("mid"), "to"), ["file", "mid"])
        jumps = scratch.save(far.select("file", "node", "to"), f"j{turn}")
        scratch.drop(f"j{turn - 1}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``file``, ``offset``, ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest`` (of the full payload).

    Candidates are cut and parsed where the bytes are; payloads are hashed there and do not leave the task. Runs of
    candidates that name each other are contracted before the jumping. Records whose payload holds the magic are
    put together again from their segments. A revisit's figures are those of the response it refers to.
    """
    cut = settle(_segments(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("file", "split").agg(F.max("total").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(by_file), F.lit(0)))
    magic = len(MAGIC)
    at = cut.join(bases.select("file", "split", "base"), ["file", "split"]).withColumns({
        "offset": F.col("base") + F.col("rel") - magic, "head": F.col("base") + F.col("run") - magic, "jump": F.col("base") + F.col("jump") - magic}).drop("base", "rel", "run", "total", "split")
    # The empty segment before the first magic has offset -10 and opens nothing.
    at = settle(at.filter("offset >= 0"), "offsets")
    last = at.groupBy("file", "head").agg(F.max("offset").alias("offset"))
    exits = at.join(last, ["file", "head", "offset"]).select("file", "head", F.col("jump").alias("entry"))
    targets = at.select("file", F.col("offset").alias("entry"), F.col("head").alias("next"))
    runs = settle(exits.join(targets, ["file", "entry"], "left"), "runs")
    seen = _reached(runs)
    entries = runs.join(seen.select("file", F.col("node").alias("head")), ["file", "head"]).filter("next IS NOT NULL").groupBy("file", F.col("next").alias("head")).agg(F.min("entry").alias("entry"))
    entered = seen.select("file", F.col("node").alias("head")).join(entries, ["file", "head"], "left").select("file", "head", F.when(F.col("head") == 0, 0).otherwise(F.col("entry")).cast("long").alias("entry"))
    records = settle(at.join(entered, ["file", "head"]).filter((F.col("offset") >= F.col("entry")) & F.col("jump").isNotNull()), "records")
    broken = records.filter("NOT whole").select("file", "offset", "jump")
    if not broken.isEmpty():
        records = _mended(spark, path, records, broken)
    responses = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("named")).agg(F.max("size").alias("full_size"))
    own = records.select("file", "offset", "page_id", "url", "record_type", "refers_to", "size", "digest", F.when(F.col("record_type") == "revisit", F.col("named")).alias("named"))
    full = own.join(responses.withColumn("full_digest", F.col("named")), ["refers_to", "named"], "left")
    return full.select("file", "offset", "page_id", "url", "record_type", "refers_to", F.coalesce("size", "full_size").alias("payload_bytes"), F.coalesce("digest", "full_digest").alias("payload_digest"))


def _mended(spark: SparkSession, path: str, records: DataFrame, broken: DataFrame) -> DataFrame:
    """``records`` with the figures of those whose payload holds the magic, put together from their segments.

    The archives are read again only if there are such records; a record is no larger than what one task may hold.
    """
    magic = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for file, split, at, value, _ in _ordered(batches):
            rows.append({"file": file, "split": split, "rel": at, "total": at + len(value) + magic, "value": value})
            held += len(value)
            if held > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    parts = _segments(spark, path).mapInArrow(run, "file string, split long, rel long, total long, value binary")
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("file", "split").agg(F.max("total").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(by_file), F.lit(0)))
    parts = parts.join(bases, ["file", "split"]).select("file", (F.col("base") + F.col("rel") - magic).alias("at"), "value")
    # A block of 1 MiB is the equality key of the range join: a record asks for the blocks it covers.
    asked = broken.withColumn("block", F.explode(F.sequence(F.col("offset").bitwiseAND(-1048576), F.col("jump"), F.lit(1048576).cast("long"))))
    held = parts.withColumn("block", F.col("at").bitwiseAND(-1048576)).join(asked, ["file", "block"]).filter("at >= offset AND at < jump")
    whole = held.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, offset, pieces in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                record = parse_record(MAGIC.join(p["value"] for p in pieces)) or {}
                yield pa.RecordBatch.from_pylist([{"file": file, "offset": offset, "m_digest": record.get("digest"), "m_size": record.get("size")}],
                                                 schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("m_digest", pa.string()), ("m_size", pa.int64())]))

    mended = whole.mapInArrow(join_up, "file string, offset long, m_digest string, m_size long")
    return settle(records.join(mended, ["file", "offset"], "left").withColumns({"digest": F.coalesce("digest", "m_digest"), "size": F.coalesce("size", "m_size")}).drop("m_digest", "m_size"), "mended")


def archived_pages(pages: DataFrame, **kwargs) -> DataFrame:
    """Write ``pages`` to a fresh folder under the shared one and read the archives back."""
    path = Scratch(pages.sparkSession, "warc").root
    write_warc(pages, path, **kwargs)
    return read_warc(pages.sparkSession, path)
