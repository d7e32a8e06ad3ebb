"""Shared-prefix Viterbi next to the library, over model files written by hand."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from glintmark.llm import pieces


def _number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(k, v):
    return _number(k << 3) + _number(v) if isinstance(v, int) else _number(k << 3 | 2) + _number(len(v)) + v


def _model(path, listed, kind=1, bytes_too=False):
    """A model file of given pieces (text, score, type); nothing is trained."""
    raw = b"".join(_field(1, _field(1, t.encode()) + _number(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k)) for t, s, k in listed)
    raw += _field(2, _field(3, kind) + (_field(35, 1) if bytes_too else b""))
    raw += _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    path.write_bytes(raw)
    return str(path)


def _pieces(seed, bytes_too, mark=True, letters="abcdeé日"):
    rng = random.Random(seed)
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(150)} - {"日"}
    found |= {"▁" + t for t in rng.sample(sorted(found), 40)}
    out = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *([("▁", -3.3, 1)] if mark else [])]
    out += [(t, -rng.uniform(1, 12), 5 if rng.random() < 0.1 else 1) for t in sorted(found)] + [("USER", 0, 4)]
    return out + [(f"<0x{b:02X}>", 0, 6) for b in range(256)] * bytes_too


def _texts(seed, letters="abcdeé日x", user=("",)):
    rng = random.Random(seed)
    return ["", " ", "  x  ", *(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(user) for _ in range(rng.randint(0, 60))) for _ in range(300))]


@pytest.mark.parametrize("seed, bytes_too, mark", [(1, False, True), (2, True, True), (3, False, False), (4, True, False)])
def test_unigram_equals_the_library(tmp_path, seed, bytes_too, mark):
    path = _model(tmp_path / "m.model", _pieces(seed, bytes_too, mark), 1, bytes_too)
    own, library = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert isinstance(own, pieces.Unigram)
    docs = _texts(seed)
    for at in range(0, len(docs), 50):  # words known from an earlier batch are used again
        for text, ids in zip(docs[at:at + 50], own.encode(docs[at:at + 50]), strict=True):
            want = library.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert own.decode(ids) == library.decode(want)


def test_rounding_ties_are_settled_over_the_whole_text(tmp_path):
    """Whole scores make many segmentations equally good; the library's sums over the text before decide, user-defined pieces among them."""
    rng = random.Random(5)
    listed = [(t, float(-rng.choice([1, 2, 3])) if k == 1 else s, k) for t, s, k in _pieces(5, True)]
    path = _model(tmp_path / "m.model", listed, 1, True)
    own, library = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    docs = _texts(6, user=("", "USER"))
    same = sum(np.frombuffer(i, "<u4").tolist() == library.encode(t) for t, i in zip(docs, own.encode(docs), strict=True))
    assert same >= 0.98 * len(docs)


def test_best_sum_equals_all_segmentations(tmp_path):
    listed = _pieces(7, False)
    own = pieces.load(_model(tmp_path / "m.model", listed))
    rng = random.Random(7)
    for _ in range(60):
        word = "▁" + "".join(rng.choice("abcdeéx") for _ in range(rng.randint(1, 9)))
        best = -np.inf
        for cut in range(1 << (len(word) - 1)):
            ends = [k + 1 for k in range(len(word) - 1) if cut >> k & 1] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(p in own.scores or len(p) == 1 for p in parts):
                best = max(best, sum(own.scores.get(p, own.unknown) for p in parts))
        got = own.encode_words([word])[word]
        assert "".join(got) == word and abs(sum(own.scores.get(p, own.unknown) for p in got) - best) < 1e-3


def test_forward_scores_of_common_prefixes_are_reused(tmp_path):
    own = pieces.load(_model(tmp_path / "m.model", _pieces(8, False)))
    seen = []

    class Scores(dict):
        def get(self, key, default=None):
            seen.append(key)
            return super().get(key, default)

    own.scores = Scores(own.scores)
    own.encode_words(["▁abcdeab"])
    once = len(seen)
    seen.clear()
    own.encode_words(["▁abcdeab", "▁abcdeabc", "▁abcdeabd"])
    assert len(seen) < 2 * once


def test_other_models_are_refused(tmp_path):
    for kind in (3, 4):
        with pytest.raises(ValueError, match="model type"):
            pieces.load(_model(tmp_path / f"m{kind}.model", _pieces(1, False), kind))


def test_table_by_a_unigram_model(spark, odd, none, odd_rows, tmp_path):
    path = _model(tmp_path / "m.model", _pieces(9, True), 1, True)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id, r.n_pieces, r.text) for r in pieces.round_trip(odd, path).collect()), key=repr)
    assert got == sorted(((i, len(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in odd_rows), key=repr)
    assert pieces.round_trip(none, path).collect() == []
