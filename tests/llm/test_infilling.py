"""Fill-in-middle next to plain string slicing, and exact round trips."""

import hashlib
import re

from glintmark.llm import infilling
from hypothesis import given, settings
from hypothesis import strategies as st

MARKS = ("<P>", "<S>", "<M>")


def _plain_way(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@settings(max_examples=400, deadline=None)
@given(st.integers(-5, 10**12), st.lists(st.one_of(st.text(max_size=5), st.sampled_from(["abc", "<P>", "<", "P>", "é", "日", "😀", "\n", "\x00"]))).map("".join))
def test_split_and_round_trip(doc_id, text):
    got = infilling.split(doc_id, text.encode())
    assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.table.content().decode()) == _plain_way(doc_id, text)
    back = infilling.read_back(got.table.content(), got.form)
    assert back.content().decode() == text and back.sha256() == hashlib.sha256(text.encode()).hexdigest()
    if got.form != "plain":
        assert got.table.restore(infilling.FORMS[got.form]).content() == text.encode()


def test_cuts_keep_buffers_and_bytes():
    table = infilling.PieceTable.of(b"abcdef")
    cut = table.cut(0, 2, 2, 6)
    assert cut.content() == b"abcdef" and [p[2] for p in cut.pieces] == [0, 2, 0, 4, 0] and cut.buffers is table.buffers
    assert table.cut(1).cut(3).pieces == table.cut(1, 3).pieces


def _want(rows):
    out = []
    for i, t in rows:
        n, form, p, m, text = _plain_way(i, t)
        out.append((i, n, form, p, m, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(odd, none, odd_rows):
    rows = [*odd_rows]
    assert sorted((tuple(r) for r in infilling.digests(odd).collect()), key=repr) == _want(rows)
    assert infilling.digests(none).collect() == []
    full = infilling.restore(infilling.fill_in_middle(odd))
    assert sorted((r.doc_id, r.text) for r in full.collect() if r.doc_id) == sorted((i, t or "") for i, t in rows if i)
    assert infilling.restore(infilling.fill_in_middle(none)).collect() == []


def test_texts_with_sentinels_stay_plain(spark):
    rows = [(i, "one two <M> three four five") for i in range(50)] + [(100 + i, "one two three four five six") for i in range(300)]
    out = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.form for r in out if r.doc_id < 100} == {"plain"}
    shares = [sum(r.form == f for r in out if r.doc_id >= 100) for f in ("plain", "spm", "psm")]
    assert 10 < shares[0] < 60 and 25 < shares[1] < 95 and sum(shares) == 300
    every = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), plain_share=0, spm_share=100).collect()
    assert {r.form for r in every if r.doc_id >= 100} == {"spm"}


def test_restore_of_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "psm"), ("x", "plain")], "output string, form string")
    assert [r.text for r in infilling.restore(df).collect()] == [None, None, "x"]
