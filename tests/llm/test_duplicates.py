"""Exact copies, near copies, sketches, components, next to brute force."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glintmark.llm import exact, queries, simhash, sketch
from glintmark.llm.components import components


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups_of_odd_rows(odd, none, odd_rows):
    for keep, pick in (("largest", max), ("smallest", min)):
        rows = exact.exact_groups(odd, keep=keep).collect()
        assert len(rows) == len(odd_rows)
        for r in rows:
            same = [i for i, t in odd_rows if fold(t) == fold(r.text)]
            assert r._size == len(same)
            assert r._keep == pick([i for i in same if i is not None], default=None)
            assert r._sha256 == hashlib.sha256(fold(r.text).encode()).hexdigest()
    kept = exact.exact_dedup(odd).collect()
    assert sorted(fold(r.text) for r in kept) == sorted({fold(t) for _, t in odd_rows})
    assert kept[0].asDict().keys() == set(odd.columns)
    assert exact.exact_groups(none).collect() == [] and exact.exact_dedup(none).collect() == []


def test_bytes_decide_inside_a_hash(odd, odd_rows):
    rows = exact.exact_groups(odd, hashed=lambda text: F.substring(F.sha2(text, 256), 1, 1)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r._size == sum(fold(t) == fold(r.text) for _, t in odd_rows)


def test_exact_query_equals_its_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.op7_exact_dedup(spark, sf)
    rel = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op7_exact_dedup']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(rel)


def _brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(fps, distance):
    root = dict.fromkeys(fps)
    for start in fps:
        if root[start] is not None:
            continue
        stack, seen = [start], {start}
        while stack:
            here = stack.pop()
            near = [f for f in fps if f not in seen and (f ^ here).bit_count() <= distance]
            seen.update(near)
            stack += near
        for f in seen:
            root[f] = min(seen, key=lambda x: x - (1 << 64) if x >> 63 else x)
    return root


def test_fingerprints_equal_brute_force(odd_rows):
    for _, text in odd_rows:
        if len(text or "") < 10000:
            assert simhash.fingerprint(text or "") % (1 << 64) == _brute_fingerprint(text), text
    long = " ".join(str(i * 7919 % 1000) for i in range(70000))  # more than one block of hashes
    assert simhash.fingerprint(long) % (1 << 64) == _brute_fingerprint(long)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd, most_keys", [(2, 0), (32, 10**6), (32, 0)])
def test_links_keep_every_connection(spark, distance, crowd, most_keys):
    rng = random.Random(distance)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(12):  # clusters, chains and strangers
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(base)
    fps |= {b for f in list(fps)[:3] for b in (f ^ (1 << i) for i in range(40))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, crowd, most_keys)
    pairs = [tuple(r) for r in found.collect()]
    assert all(0 < ((a ^ b) % (1 << 64)).bit_count() <= distance for a, b in pairs)
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in components(found).collect()}
    want = _brute_components(sorted(fps), distance)
    assert {f: root.get(f, f) for f in fps} == want
    if crowd == 32 and distance:
        every = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= distance}
        assert {(min(p), max(p)) for p in pairs} <= every


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (5, 5)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_of_odd_rows(odd, none, odd_rows):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    fps = sorted({_brute_fingerprint(t) if len(t or "") < 10000 else simhash.fingerprint(t) % (1 << 64) for _, t in odd_rows})
    root = _brute_components(fps, 2)
    least = {}
    for i, t in odd_rows:
        if i is not None:
            r = root[simhash.fingerprint(t or "") % (1 << 64)]
            least[r] = min(least.get(r, i), i)
    for r in rows:
        assert r.component_id == least.get(root[r.fp % (1 << 64)])
    kept = simhash.near_dedup(odd).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())
    assert sum(r.doc_id is None for r in kept) == 2
    assert kept[0].asDict().keys() == set(odd.columns)
    assert sorted(map(repr, simhash.near_dedup(odd, most_ids=0).collect())) == sorted(map(repr, kept))
    assert simhash.near_duplicates(none).collect() == [] and simhash.near_dedup(none).collect() == []


def test_near_copies_of_long_texts_are_linked(spark):
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(4000)]
    docs = [(i, " ".join(words[:2000 + i] if i else words)) for i in (0, 1990, 1991, 1995)] + [(77, "something else entirely " * 5)]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = {i: _brute_fingerprint(t) for i, t in docs}
    root = _brute_components(sorted(set(fps.values())), 2)
    assert rows == {i: min(j for j in fps if root[fps[j]] == root[fps[i]]) for i in fps}


def _shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    s = sketch.Sketcher()
    words = [str(rng.randrange(10**5)) for _ in range(20000)]
    whole, part, small = " ".join(words), " ".join(words[:4000]), " ".join(words[100:112])
    a, b, c = s.sketch(whole), s.sketch(part), s.sketch(small)
    assert np.array_equal(s.merge(b, a), np.unique(s.sketch(whole)))
    assert abs(s.containment(b, a) - 1) < 1e-9 and abs(s.containment(a, b) - 0.2) < 0.03 and s.containment(c, a) == 1
    assert abs(s.likeness(a, b) - 0.2) < 0.03
    halves = s.merge(s.sketch(" ".join(words[:1000])), s.sketch(" ".join(words[996:2000])))
    assert np.array_equal(halves, s.sketch(" ".join(words[:2000])))
    assert np.array_equal(sketch.read(sketch.written(a)), a) and len(sketch.read("")) == 0
    assert s.likeness(s.sketch(""), s.sketch(" ")) == 1 and s.likeness(s.sketch(""), c) == 0


@pytest.mark.parametrize("rows", ["odd", "one", "ids"])
def test_edited_fingerprints(spark, odd, none, odd_rows, rows):
    docs = {"odd": odd_rows, "one": [(4, "just one text of some words here")], "ids": [(i, " ".join(str(x) for x in range(i, i + i % 60))) for i in range(0, 900, 3)]}[rows]
    df = odd if rows == "odd" else spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sketch.edited_fingerprints(df).collect()
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1] or ""]))
    s, want = sketch.Sketcher(), []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), sketch.written(s.sketch(t)), sketch.written(s.sketch(e)), s.likeness(s.sketch(t), s.sketch(e)), s.likeness(s.sketch(t), s.sketch(u))))
        if len(_shingles(t) | _shingles(e)) <= 16:
            assert want[-1][5] == (len(_shingles(t) & _shingles(e)) / len(_shingles(t) | _shingles(e)) if _shingles(t) | _shingles(e) else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sketch.edited_fingerprints(none).collect() == []
    assert sorted(r.fingerprint for r in sketch.sketches(df).collect()) == sorted(w[3] for w in want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 100])
def test_ranges_are_found_in_blocks(spark, n):
    cuts = sorted(random.Random(n).sample(range(-500, 500), n))
    rows = spark.range(-510, 510).select("id", sketch._below(cuts, F.col("id")).alias("k")).collect()
    assert all(r.k == sum(c < r.id for c in cuts) for r in rows)


def test_likeness_is_near_the_true_one(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf).collect()}
    ids = sorted(docs, reverse=True)
    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t = docs[i]
        a, b = _shingles(t), _shingles(t[:len(t) - len(t) // 3] + docs[j][:len(t) // 3])
        errors.append(rows[i].near_edited - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.12 and abs(np.mean(errors)) < 0.02


def test_simhash_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, sf).collect()}
    fps = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    for i in list(docs)[:20]:
        if len(docs[i]) < 5000:
            assert fps[i] == _brute_fingerprint(docs[i])
    root = _brute_components(sorted(set(fps.values())), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {i: r.component_id for i, r in rows.items()} == {i: least[root[f]] for i, f in fps.items()} and len(rows) == len(docs)
