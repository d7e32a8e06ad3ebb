"""Archives written and read back; boundaries next to a sequential reader."""

import gzip
import hashlib
import pathlib

import duckdb
import pytest

from glintmark.llm import queries, warc

FALSE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
PAGES = [
    (1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "http://e\r\nWARC-Type: evil", ""),
    (7, "http://f", f"before {FALSE} after " + "y" * 150), (8, "http://g", FALSE * 40), (9, "http://h", "WARC/1.1\r\n"), (10, "http://i", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + "z" * 90),
    (None, "http://j", "x" * 200), (11, "http://k", "é日😀" * 60), (12, "http://l", "\r\n\r\n" * 60), (2, "http://b", "x" * 200), (13, "http://m", "q" * 120), (13, "http://m", "q" * 120),
    (14, "http://n", "long " * 40000), (15, "http://o", ("WARC/1.1\r\n" + "p" * 7) * 3000), (16, "http://p", "line\nends\r\n" * 20), (None, None, "n" * 300), (None, None, "n" * 300)]


def _want():
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        to = first.get(html)
        yield (-1 if i is None else i, len(raw), hashlib.sha256(raw).hexdigest(), *(("response", -1) if to is None or to == i else ("revisit", to)))


def _got(rows):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in rows)


def _pages(spark):
    return spark.createDataFrame([(*p, "a", 1, False) for p in PAGES], "page_id long, url string, html string, digest string, size int, is_response boolean").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("split", ["128m", "1000", "4k"])
def test_odd_pages(spark, tmp_path, compression, split):
    warc.write_warc(_pages(spark).coalesce(2), str(tmp_path / "w"), compression=compression)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert _got(rows) == sorted(_want())
    urls = {r.page_id: r.url for r in rows}
    assert urls[6] == "http://e%0D%0AWARC-Type: evil" and urls[5] is None
    files = {p.as_uri(): p.read_bytes() for p in pathlib.Path(tmp_path / "w").iterdir() if p.name.startswith("part-")}
    found = sorted((r.file.replace("file:///", "file:/").removeprefix("file:"), r.offset) for r in rows)
    want = []
    for uri, raw in files.items():  # the sequential reader
        raw, at = gzip.decompress(raw) if compression == "gzip" else raw, 0
        while at < len(raw):
            want.append((uri.removeprefix("file://"), at))
            end = raw.index(b"\r\n\r\n", at)
            fields = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
            at = end + 4 + int(fields[b"Content-Length"]) + 4
    assert found == sorted(want)


def test_no_pages(spark, tmp_path):
    assert warc.archived_pages(_pages(spark).limit(0)).collect() == []


def test_query_equals_its_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = queries.op4_warc(spark, sf)
    rel = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op4_warc']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rel))
