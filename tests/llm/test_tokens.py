"""Token counts, token files, packing and pieces next to the public libraries."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glintmark.llm import encoding, packing, pieces, queries, token_counts, token_store
from glintmark.llm.encoding import Encoder, Words

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ANY_TEXT = st.lists(st.sampled_from(["the", "Word", " ", "  ", "\n", "\t", "'s", "!", "***", "é", "ß", "\x1c", " ", "<|endoftext|>", "12", "日", "é", "▁", "İ", "Σ", "x" * 40]) | st.text(max_size=5), max_size=12).map("".join)


def u4(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path, odd_rows):
    library, own = Tokenizer.from_file(path), Encoder(path)
    for _, text in odd_rows:
        assert own.ids(text or "") == u4(library.encode(text or "", add_special_tokens=False).ids), text

    @settings(max_examples=300, deadline=None)
    @given(ANY_TEXT)
    def check(text):
        assert own.ids(text) == u4(library.encode(text, add_special_tokens=False).ids)

    check()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_and_sign_beside_others(path):
    library, own, counter = Tokenizer.from_file(path), Encoder(path), token_counts.Counter(path)
    for c in map(chr, range(1, 0x180)):
        for text in (f"ab{c} x", f"x {c}ab", f"x ab{c}!{c} y", f"x {c}", f"{c} x\n{c}\n", f"x  {c} \n y"):
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.ids(text) == u4(ids) and counter.count(text) == len(ids), repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts_equal_the_library(path, odd_rows):
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    for _, text in odd_rows:
        assert own.count(text or "") == len(library.encode(text or "", add_special_tokens=False).ids), text

    @settings(max_examples=300, deadline=None)
    @given(ANY_TEXT)
    def check(text):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)

    check()


def test_caches_stay_bounded(byte_library):
    own, counter = Encoder(BYTE, most=4), token_counts.Counter(BYTE, most=4)
    text = " ".join(f"w{i}x word" for i in range(50))
    assert own.ids(text) == u4(byte_library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text) == len(own.ids(text)) // 4
    assert max(map(len, (own.cores, own.known, counter.cores, counter.known))) <= 4
    own.ids("x" * 1000 + " y" + "z" * 1000)
    assert max(map(len, [*own.cores, *own.known])) <= 64


def test_token_counts_table(odd, none, odd_rows, byte_library):
    rows = sorted(tuple(r) for r in token_counts.token_counts(odd, BYTE).fillna(-1).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(byte_library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in odd_rows)
    assert rows == want
    assert token_counts.token_counts(none, BYTE).collect() == []


def test_token_files_round_trip(spark, odd, none, odd_rows, byte_library, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_tokens(odd, path, BYTE, block_bytes=200)
    back = token_store.read_tokens(spark, path).collect()
    ids = lambda t: byte_library.encode(t or "", add_special_tokens=False).ids + [0]
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in back) == sorted((i is not None, i or 0, u4(ids(t))) for i, t in odd_rows)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens == len(bytes(r.ids)) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    one = token_store.read_tokens(spark, path, doc_id=9).collect()
    assert [(r.doc_id, bytes(r.ids), r.start) for r in one] == [(9, u4(ids(odd_rows[12][1])), next(r.start for r in back if r.doc_id == 9))]
    assert token_store.stored_tokens(none, BYTE).collect() == []


def test_token_files_use_their_dictionary(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, BYTE)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert len(row["bytes"]) > 1024
    spark.range(1).select(F.lit(bytearray(b"other")).alias("bytes"), F.lit("00").alias("sha256")).write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="damaged"):
        token_store.read_tokens(spark, path)


def test_queries_equal_the_library(spark, sf, byte_library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in queries.op2_token_counts(spark, sf).collect()}
    files = {r.doc_id: r for r in queries.op3_token_store(spark, sf).collect()}
    at = 0
    for i in sorted(docs):
        ids = byte_library.encode(docs[i], add_special_tokens=False).ids
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len(docs[i].encode()), len(ids) > 1024)
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (at, len(ids) + 1, zlib.crc32(u4([*ids, 0])))
        at += len(ids) + 1
    assert len(counts) == len(files) == len(docs)


def _check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and sum(places[-1]) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_two_fit_places_each_piece_once(lengths):
    bins = packing.best_two_fit(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= 2 * max(1, -(-sum(lengths) // 64))


def test_best_two_fit_replaces_the_smallest():
    assert sorted(sorted(b) for b in packing.best_two_fit([60, 30, 21, 19], 100)) == [[0, 2, 3], [1]]  # greedy alone: 60 + 30, 21 + 19


def test_packing_of_odd_rows(odd, none, odd_rows):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(odd, WORD, 2048, shard_rows=8).collect()
    want = []
    for i, t in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(-1 if i is None else i, k, at, len(ids[at:at + 2048]), zlib.crc32(u4(ids[at:at + 2048]))) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    _check_places(rows, 2048)
    assert packing.pack_documents(none, WORD).collect() == []


def test_packed_sequences_hold_the_ids(odd):
    pieces_ = packing.token_pieces(odd, WORD, 64, with_ids=True)
    packed = packing.pack(pieces_, 64)
    rows = packed.collect()
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert len(whole) == _check_places(rows, 64)
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_packing_query_is_tight(spark, sf):
    rows = queries.op5_packing(spark, sf).collect()
    used = sum(r.length for r in rows)
    assert _check_places(rows, 2048) <= used / 2048 * 1.02 + 1


def test_pieces_equal_the_library(odd_rows):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.Pieces(PIECE)
    batch = [t or "" for _, t in odd_rows]
    ids = own.encode(batch)
    assert ids == [u4(library.encode(t)) for t in batch]
    assert [own.decode(i) for i in ids] == [library.decode(library.encode(t)) for t in batch]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ANY_TEXT, max_size=4))
    def check(some):
        got = own.encode(some)
        assert got == [u4(library.encode(t)) for t in some]
        assert [own.decode(i) for i in got] == [library.decode(library.encode(t)) for t in some]

    check()


def test_words_share_the_states_of_their_prefix(monkeypatch):
    own, steps = pieces.Pieces(PIECE), []
    last = own._last
    monkeypatch.setattr(own, "_last", lambda word, end, states: steps.append((word, end)) or last(word, end, states))
    own.encode_words(["▁walker", "▁walk", "▁walking", "▁walked", "▁talk"])
    assert len(steps) == len({w[:e] for w, e in steps}) == len({w[:e] for w in ("▁walker", "▁walking", "▁walked", "▁talk") for e in range(1, len(w) + 1)})


def test_pieces_table(odd, none, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = pieces.decode_pieces(pieces.encode_pieces(odd, PIECE, rows=4), PIECE).collect()
    want = sorted((-1 if i is None else i, zlib.crc32(u4(library.encode(t or ""))), library.decode(library.encode(t or ""))) for i, t in odd_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.text) for r in rows) == want
    assert sorted(map(repr, pieces.round_trip(odd, PIECE, rows=3).collect())) == sorted(map(repr, rows))
    assert pieces.decode_pieces(pieces.encode_pieces(none, PIECE), PIECE).collect() == [] and pieces.round_trip(none, PIECE).collect() == []


def test_pieces_query_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.decoded_chars) == (len(ids), zlib.crc32(u4(ids)), len(library.decode(ids)))


def test_word_cache_keeps_what_is_in_use_and_is_bounded():
    made = []
    cache = Words(lambda w: made.append(w) or len(w), 100)
    for i in range(1000):
        assert cache["often"] == 5 and cache[f"once{i}"] == len(f"once{i}")
        assert len(cache) + len(cache.older) <= 100
    assert made.count("often") == 1 and len(made) == 1001
    assert cache["x" * 65] == 65 and "x" * 65 not in cache


def test_packing_keeps_few_words_in_a_worker(monkeypatch):
    monkeypatch.setattr(encoding, "_OBJECTS", {})
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26**k % 26] for k in range(5)) for i in range(360_000)]
    seen = []
    monkeypatch.setattr(packing, "shared", lambda *args: seen.append(encoding.shared(*args)) or seen[-1])

    class Rows:
        def mapInArrow(self, run, kind):
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)])], ["doc_id", "text"])
            return sum(b.num_rows for b in run([batch]))

    monkeypatch.setattr(packing, "texts", lambda *args: Rows())
    assert packing.token_pieces(None, WORD) > 100
    assert sum(len(c) + len(c.older) for c in (seen[0].cores, seen[0].tails, seen[0].known, seen[0].heads)) <= 300_000
