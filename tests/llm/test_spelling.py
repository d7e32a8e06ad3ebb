"""Spelling variants next to a brute-force comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from glintmark.llm import boxes, spelling


def _edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _brute(rows, divisor=97, shortest=5, least=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % divisor == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if _edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _texts(seed, n_words, docs, length=400, letters="abé"):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 7))) for _ in range(n_words)]
    weights = [1 / (k + 1) for k in range(n_words)]
    return [(i, " ".join(rng.choices(stock, weights, k=length))) for i in range(docs)]


@pytest.mark.parametrize("capacity, sample", [(8192, 100_000), (20, 100_000), (7, 15)])
def test_equals_brute_force_at_any_capacity(spark, capacity, sample):
    rows = _texts(1, 400, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _brute(rows, 7)
    assert sum(w[2] for w in want) > 100 and any(w[3] and w[5] != w[3] for w in want)
    assert _got(spelling.spelling_variants(df, divisor=7, capacity=capacity, sample=sample)) == want


def test_words_of_one_letter_count_are_cut_in_tiles(spark):
    """All words are arrangements of the same letters, so no tree can part them."""
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("aabbcd", 6)) for _ in range(400)} | {"".join(rng.sample("aabbcde", 7)) for _ in range(60)})
    rows = [(0, " ".join(words * 3)), (1, " ".join(words[::5] * 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(spelling.spelling_variants(df, capacity=16)) == _brute(rows)


def test_chain_of_forms(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)))]
    got = {r[0]: r for r in _got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), divisor=10**10))}
    assert got["aaaaaaaa"][5] == "aaabbbbb" and got["aaaaaaaa"][3] == "aaaaaaab"


def test_odd_rows(spark, odd, none, odd_rows):
    assert _got(spelling.spelling_variants(odd)) == _brute(odd_rows)
    assert _got(spelling.spelling_variants(none)) == []
    rows = [(1, "Ärger Ärger ärger ärger ärgern ×÷×÷× ×÷×÷× ×÷×÷× " * 3 + "x" * 30000 + " "), (2, ("x" * 30000 + " " + "x" * 30001 + " ") * 3), (None, "ÄRGER " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(spelling.spelling_variants(df, least=2)) == _brute(rows, least=2)
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, factor=1)


def test_words_flushed_early_count_the_same(spark):
    rows = _texts(5, 60, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    a, b = spelling.word_counts(df, held=3), spelling.word_counts(df)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_reach_prunes_but_never_loses():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, size=(600, 5)).astype(float)
    tree = boxes.grow(points, 10)
    home = boxes.place(tree, points)
    assert np.bincount(home).max() <= 10 and tree.leaves() > 60
    found = {leaf: set(rows.tolist()) for leaf, rows in boxes.reach(tree, points, spelling.SAME)}
    diff = points[:, None] - points[None]
    near = (np.maximum(diff, 0).sum(2) <= 1) & (np.maximum(-diff, 0).sum(2) <= 1)
    for i, j in zip(*np.nonzero(near), strict=True):
        assert i in found[home[j]]
    assert sum(map(len, found.values())) < 600 * tree.leaves() / 2
