"""Every registered query next to its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from glintmark import session
from glintmark.operators import prefix
from glintmark.plans.catalog import ORACLES, QUERIES, formats, graphs
from glintmark.plans.views import TABLES, view
from glintmark.sources import documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_but_the_quality_plan_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == {"source_quality"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    rel = db.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in rel.fetchall()) == rows


@pytest.mark.parametrize("name", ["call_edges", "eval_truth", "eval_runs"])
def test_large_views_of_distinct_rows_are_dealt_to_more_tasks(spark, monkeypatch, name):
    few = view(spark, SF, name)
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    many = view(spark, SF, name)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 400


@pytest.mark.parametrize("graph, names", [("_graph", ["edges", "node_files"]), ("_rank_graph", ["rank_nodes", "rank_edges"])])
def test_graphs_are_written_once(spark, graph, names):
    frames = getattr(graphs, graph)(spark, SF)
    assert all(f"/{name}-" in path for name, df in zip(names, frames, strict=True) for path in df.inputFiles())


def test_json_export_reads_the_head_of_a_part_once(spark):
    lines = QUERIES["json_export"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "posexplode" in line)
    assert not any("array_sort" in line for line in lines[:at]) and any("array_sort" in line and "map_entries" in line for line in lines[at:])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sarif_roundtrip", "rules_roundtrip"])
def test_results_are_neither_shuffled_to_the_manifest_nor_written_before_their_documents(spark, monkeypatch, name):
    assert "SortMergeJoin" not in _plan(formats._results(spark, SF))
    written = []
    monkeypatch.setattr(documents, "settle", lambda df, name: written.append((name, df.columns)) or session.settle(df, name))
    QUERIES[name](spark, SF)
    assert written == [("sizes", ["_run", "_parts"]), ("wanted", ["run_id", "part", "rule_id"])]


def test_ranks_and_heads_of_reports_shuffle_findings_once(spark):
    rows = spark.range(1000).select(F.expr("id % 3").alias("g"), F.expr("id * 7919 % 1000").alias("v"), F.lit("text").alias("message"))
    ranked = prefix.numbered(rows, ["g"], [F.desc("v")], "no")
    assert _plan(ranked).count("- Window ") == 1  # over the totals of the ranges
    own = {}
    for r in sorted(rows.collect(), key=lambda r: -r.v):
        own.setdefault(r.g, []).append(r.v)
    assert sorted((r.g, r.no, r.v) for r in ranked.collect()) == sorted((g, i, v) for g, vs in own.items() for i, v in enumerate(vs, 1))
    plan = _plan(QUERIES["json_export"](spark, SF))
    assert plan.count("- Window ") == 1 and plan.count("Exchange hashpartitioning") == 2  # ranges' totals by run, findings by run and part


def test_full_review_dedup_carries_no_place_in_the_document(spark):
    plan = QUERIES["full_review"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    best = [line for line in plan.splitlines() if "Aggregate" in line and "AS best" in line]
    assert best and not any("ordinal_parts" in line or "run_pos" in line for line in best)


def test_reach_both_walks_as_far_as_the_source_system(spark, monkeypatch):
    walks, reach = [], graphs.G.reach

    def watched(seeds, edges, hops, direction="backward", min_confidence=0.3):
        walks.append((direction, hops, min_confidence))
        return reach(seeds, edges, hops, direction, min_confidence)

    monkeypatch.setattr(graphs.G, "reach", watched)
    QUERIES["reach_both"](spark, SF)
    assert sorted(walks) == [("backward", 4, 0.3), ("forward", 4, 0.3)]
