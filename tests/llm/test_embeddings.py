"""Embedding links next to brute-force cosines."""

import numpy as np
import pytest
from glintmark.llm import embeddings

NAN, INF = float("nan"), float("inf")


def _brute(rows, similarity=0.95):
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.asarray(v, float) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, sound, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= similarity] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = [], [i]
        seen.add(i)
        while todo:
            k = todo.pop()
            part.append(k)
            for j in near[k]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[k][0] for k in part if rows[k][0] is not None), default=None)
        for k in part:
            out[k] = (rows[k][0], len(near[k]), least, rows[k][0] is not None and rows[k][0] == least)
    return sorted(out, key=repr)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, node int, n_links string").repartition(3)
    return sorted((tuple(r) for r in embeddings.near_embeddings(df, **options).collect()), key=repr)


def _clusters(seed, d=16, groups=25, members=8, alone=150, noise=0.22):
    rng = np.random.default_rng(seed)
    rows = [c + noise * rng.normal(size=d) for c in rng.normal(size=(groups, d)) for _ in range(members)] + list(rng.normal(size=(alone, d)))
    return [(int(i), (v * rng.choice([0.01, 1, 300])).tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("options", [{}, {"capacity": 12}, {"capacity": 40, "sample": 30}, {"width": 3, "capacity": 25}, {"similarity": 0.8, "capacity": 30}])
def test_equals_brute_force(spark, options):
    rows = _clusters(4)
    want = _brute(rows, options.get("similarity", 0.95))
    assert sum(w[1] for w in want) > 200
    assert _run(spark, rows, **options) == want


def test_one_large_group_is_cut_in_tiles(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=12)
    rows = [(i, (centre + 0.05 * rng.normal(size=12)).tolist()) for i in range(250)] + [(1000 + i, centre.tolist()) for i in range(200)] + [(5000 + i, rng.normal(size=12).tolist()) for i in range(50)]
    assert _run(spark, rows, capacity=32) == _brute(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 2]), (5, [1, NAN, 2]), (6, [1, INF, 2]), (7, [1, 2, 3]), (8, [2, 4, 6]), (9, [-1, -2, -3]),
            (None, [1, 2, 3]), (7, [1, 2, 3]), (10, [1e-300, 2e-300, 3e-300]), (11, [1e300, 2e300, 3.001e300]), (12, [1, 2, 3, 0]), (13, [1, 2, 3, 0.01]),
            (None, [5, 0, 0]), (None, [5, 0.01, 0]), (14, [7]), (15, [9]), (16, [-2]), (17, [0.0, -0.0, 1]), (18, [-0.0, 0.0, 1]), (19, [1.0] * 1500), (20, [1.0] * 1499 + [1.1])]
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, rows, sample=1) == _brute(rows)
    assert embeddings.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError):
        _run(spark, rows, similarity=0)


def test_pairs_at_the_threshold(spark):
    """Cosines just above and below the threshold, along many directions."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        a, b = np.linalg.qr(rng.normal(size=(20, 2)))[0].T
        angle = np.arccos(0.95) + (1e-7 if k % 2 else -1e-7)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (np.cos(angle) * a + np.sin(angle) * b).tolist())]
    got = _run(spark, rows, capacity=10)
    assert got == _brute(rows) and sum(r[1] for r in got) == 60


def test_pairs_are_found_in_few_blocks():
    """The blocks' budgets hold every link, and let far fewer pairs through than there are."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x[1000:] = x[:1000] + 0.25 * rng.normal(size=(1000, 64))
    x = embeddings.scaled(x)
    made = embeddings.index(x, 0.95, len(x), 8, 500)
    at = made.coordinates(x)
    cos = at @ at.T
    near = np.zeros_like(cos, dtype=bool)
    for block, budget in zip(made.blocks, made.budgets, strict=True):
        b = at[:, block]
        near |= ((b[:, None] - b[None]) ** 2).sum(2) <= budget
    assert near[cos >= 0.95].all() and (cos >= 0.95).sum() > 3000 and near.mean() < 0.03
