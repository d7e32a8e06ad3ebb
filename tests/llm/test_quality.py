"""The quality classifier on held-out labels and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from glintmark.llm import quality, queries


def _fitted(positive, unlabelled, prior, **options):
    rows = quality.expand(np.concatenate([positive, unlabelled]))
    flags = np.arange(len(rows)) < len(positive)
    return quality.Model(np.zeros(positive.shape[1]), np.ones(positive.shape[1]), quality.fit_pu(lambda w: quality.Sums.of(rows, flags, w), rows.shape[1], prior, **options), prior)


def _plain_risk(x, positive, w, prior, ridge):
    """The non-negative risk term by term."""
    z = x @ w
    p = z[positive]
    negative = np.mean([np.log(1 + np.exp(v)) for v in z]) - prior * np.mean([np.log(1 + np.exp(v)) for v in p])
    return prior * np.mean([np.log(1 + np.exp(-v)) for v in p]) + max(0, negative) + ridge * (w**2).sum() / 2


def test_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    model = _fitted(good[:1000], np.concatenate([good[1000:3000], bad[:1000]]), 3 / 4)
    assert (model.score(good[3000:]) > 0.5).mean() > 0.9 and (model.score(bad[1000:]) < 0.5).mean() > 0.9


def test_risk_is_held_at_zero():
    """With no negatives in the unlabelled text nothing is pushed below the positives."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (3000, 3))
    model = _fitted(x[:1000], x[1000:], 0.97)
    assert (model.score(x) > 0.3).mean() > 0.9
    rows, flags = quality.expand(x), np.arange(3000) < 1000
    assert quality.Sums.of(rows, flags, model.weights).negative_risk(0.97) > -0.05


def test_risk_and_minimum_equal_a_plain_recomputation():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (200, 2))])
    rows, flags = quality.expand(x), np.arange(500) < 120
    for _ in range(3):
        w = rng.normal(size=5)
        sums = quality.Sums.back(quality.Sums.of(rows, flags, w).flat())
        assert np.isclose(sums.risk(0.6, w, 0.01), _plain_risk(rows, flags, w, 0.6, 0.01))
        parts = [quality.Sums.of(rows[i:i + 90], flags[i:i + 90], w).flat() for i in range(0, 500, 90)]
        assert np.allclose(sum(parts), quality.Sums.of(rows, flags, w).flat())
    x = np.concatenate([rng.normal(1, 1, (3000, 2)), rng.normal(-1, 1, (2500, 2))])
    rows, flags = quality.expand(x), np.arange(5500) < 1500
    w = quality.fit_pu(lambda v: quality.Sums.of(rows, flags, v), 5, 0.5, 200, 0.01)
    assert quality.Sums.of(rows, flags, w).negative_risk(0.5) > 0.01
    least = _plain_risk(rows, flags, w, 0.5, 0.01)
    assert all(_plain_risk(rows, flags, w + 0.01 * rng.normal(size=5), 0.5, 0.01) >= least - 1e-9 for _ in range(50))


def test_fit_and_scores_over_a_table_equal_plain_sums(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    table = quality.feature_table(docs)
    model = quality.fit(table, labels)
    ones = {r.doc_id for r in labels.collect() if r.quality == 1}
    got = [(r.doc_id, quality.features(r.text or "").astype("<f4").astype(float)) for r in docs.collect()]
    known = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    outside = [(i, x) for i, x in got if zlib.crc32(str(i).encode()) % 5]
    x, flags = np.stack([x for _, x in outside]), np.array([i in ones for i, _ in outside])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rows = quality.expand((x - centre) / scale)
    w = quality.fit_pu(lambda v: quality.Sums.of(rows, flags, v), rows.shape[1], np.mean([r.quality for r in known]))
    plain = quality.Model(centre, scale, w, 0.5)
    scores = {r.doc_id: r.score for r in quality.quality_scores(table, model).collect()}
    assert all(abs(scores[i] - plain.score(v[None])[0]) < 1e-4 for i, v in got)
    kept = {r.doc_id for r in quality.quality_filter(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}


def test_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, 7) for i, _ in odd_rows if i is not None] + [(None, 1, 7), (3, None, 7)], "doc_id long, quality int, text int")
    for learnt in (labels, labels.limit(0), labels.withColumn("quality", F.lit(0))):
        table = quality.feature_table(odd)
        model = quality.fit(table, learnt)
        rows = quality.quality_scores(table, model).collect()
        assert len(rows) == len(odd_rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
        assert quality.quality_filter(odd, model).columns == odd.columns
        assert quality.quality_scores(quality.feature_table(none), model).collect() == []
    assert quality.fit(quality.feature_table(none), labels).score(np.zeros((1, quality.WIDTH)))[0] == 0.5


def test_held_out_labels_are_not_learned(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    table = quality.feature_table(docs)
    a, b = quality.fit(table, labels), quality.fit(table, turned)
    assert np.allclose(a.weights, b.weights)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.93
    assert np.mean([r.predicted == q for r, q in held]) > 0.93
