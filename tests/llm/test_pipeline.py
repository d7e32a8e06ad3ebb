"""The pipeline stage by stage, each next to a brute-force version of its own input."""

import inspect
from collections import defaultdict

import corpus_pipeline
import pytest
from glintmark.llm import quality
from pyspark.sql import functions as F

import __spark_entry__
from test_near import _stays as stays_of


def _fold(text):
    return text.encode().lower()


def test_stages_over_a_small_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.limit(30).withColumn("doc_id", F.col("doc_id") + 100000)
    docs.unionByName(copies).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 3:
            assert docs.columns == columns
        if k == 0:
            model = quality.fit(quality.feature_table(spark.read.parquet(str(tmp_path / "in"))), spark.read.parquet(f"{sf}/labels.parquet"))
            assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(quality.features(r.text).astype('<f4')[None])[0] >= 0.3}
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
            kept = {r.doc_id for r in after}
            assert len(kept & good) > 0.97 * len(good) and len(kept & bad) < 0.4 * len(bad)
        elif k == 1:
            least = {}
            for r in before:
                least[_fold(r.text)] = min(least.get(_fold(r.text), r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        elif k == 2:
            stays = stays_of([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == stays and len(after) == len(stays)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            sizes = defaultdict(int)
            for r in after:
                sizes[r.sequence_id] += r.length
            assert max(sizes.values()) <= 2048 and len(sizes) <= sum(sizes.values()) / 2048 * 1.03 + 1


def test_run_applies_all_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len({r.doc_id for r in rows}) > 100


def test_stages_take_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).collect() == []


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
    assert pytest.importorskip("glintmark.llm.queries").ORACLES.keys() <= __spark_entry__.oracle_sql().keys()
