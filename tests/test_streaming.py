"""Streams: replay, resume, late events, finished and damaged stages."""

import datetime

import pytest
from pyspark.sql import functions as F

from glintmark.session import folders, remove, shared_path
from glintmark.streaming import ledger as L
from glintmark.streaming import windows as W
from glintmark.streaming.stages import Stages


def write_lines(spark, path, rows):
    spark.createDataFrame([(f'{{"ts": "{ts}", "kind": "{kind}", "run_id": "r"}}',) for ts, kind in rows], "value string").coalesce(1).write.mode("append").text(path)


def test_late_events_are_dropped_after_the_watermark(spark):
    inbox, out, checkpoint = (shared_path(spark, n) for n in ("in", "out", "cp"))
    for rows in ([("2024-01-01T00:01:00", "a"), ("2024-01-01T00:30:00", "a")], [("2024-01-01T00:02:00", "a"), ("2024-01-01T00:31:00", "a")],
                 [("2024-01-01T01:00:00", "a")]):
        write_lines(spark, inbox, rows)
        L.run_to_end(L.windowed_counts(L.ledger_stream(spark, inbox)), L.overwrite_batches(out), "w", checkpoint=checkpoint)
    got = {(str(r.window_start), r.n) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-01 00:30:00", 2)}


def test_budget_survives_a_restart_and_a_repeated_batch(spark):
    guard = L.BudgetGuard(spark, shared_path(spark, "guard"), 2.0, "run_id", ["seq"])
    first = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 1.0), ("s", 3, 5.0)], "run_id string, seq int, cost_usd double")
    second = spark.createDataFrame([("r", 4, 1.0), ("t", 5, 1.0)], "run_id string, seq int, cost_usd double")
    guard(first, 0)
    guard(first, 0)
    again = L.BudgetGuard(spark, guard.path, 2.0, "run_id", ["seq"])
    again(second, 1)
    got = {r.seq: (r.spent_before, r.allowed) for r in again.result().collect()}
    assert got == {1: (0.0, True), 2: (1.0, True), 3: (0.0, True), 4: (2.0, False), 5: (0.0, True)}


def test_seen_state_spans_batches_and_replays(spark):
    cols = "fingerprint string, run_id string, ordinal int"
    tracker = L.SeenTracker(spark, shared_path(spark, "seen"), ["ordinal"])
    one = spark.createDataFrame([("f", "r1", 2), ("f", "r1", 1), ("g", "r1", 3)], cols)
    two = spark.createDataFrame([("f", "r2", 4), ("h", "r2", 5), ("h", "r2", 6)], cols)
    tracker(one, 0)
    tracker(two, 1)
    tracker(two, 1)
    got = {r.ordinal: (r.status, r.first_seen_run) for r in tracker.result().collect()}
    assert got == {1: ("new", "r1"), 2: ("recurring", "r1"), 3: ("new", "r1"), 4: ("recurring", "r1"), 5: ("new", "r2"), 6: ("recurring", "r2")}


def test_seen_state_finds_the_first_rows_of_a_batch_once(spark, monkeypatch):
    made, found = [], []
    monkeypatch.setattr(L, "first_places", lambda df, order, f=L.first_places: made.append(1) or f(df, order))
    monkeypatch.setattr(L, "first_seen", lambda df, order, first, f=L.first_seen: found.extend(first.inputFiles()) or f(df, order, first))
    rows = spark.createDataFrame([("f", "r1", 2), ("f", "r1", 1), ("g", "r1", 3)], "fingerprint string, run_id string, ordinal int")
    tracker = L.SeenTracker(spark, shared_path(spark, "seen"), ["ordinal"])
    tracker(rows, 0)
    got = {r.ordinal: (r.status, r.first_seen_run) for r in tracker.result().collect()}
    assert got == {1: ("new", "r1"), 2: ("recurring", "r1"), 3: ("new", "r1")}
    assert made == [1] and found and all("/firsts-" in f for f in found)


def test_stages_resume_and_report_damage(spark):
    stages = Stages(spark, shared_path(spark, "stages"))
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stages.run("a", build).count() == stages.run("a", build).count() == 3
    assert calls == [1] and stages.completed(["a", "b"]) == ["a"]
    spark.createDataFrame([("not parquet",)], "value string").write.mode("overwrite").text(stages._path("bad"))
    with pytest.raises(Exception):
        stages.run("bad", build).count()


def test_snapshot_is_the_latest_full_result(spark):
    inbox, out = shared_path(spark, "in"), shared_path(spark, "snap")
    for i in range(3):
        write_lines(spark, inbox, [("2024-01-01T00:00:00", "a")])
    L.run_to_end(L.kind_counts(L.ledger_stream(spark, inbox, files_per_batch=1)), L.snapshot_batches(out), "k", mode="complete")
    assert L.latest_snapshot(spark, out).select("kind", F.col("n").cast("int")).collect()[0] == ("a", 3)


def test_snapshots_do_not_pile_up_and_readers_see_whole_ones(spark):
    out = shared_path(spark, "snap")
    write = L.snapshot_batches(out, keep=2)
    with pytest.raises(FileNotFoundError):
        L.latest_snapshot(spark, out)
    sizes = []
    for batch in range(20):
        write(spark.range(10).select(F.lit(batch).alias("n")), batch)
        sizes.append(len(folders(spark, out)))
        assert {r.n for r in L.latest_snapshot(spark, out).collect()} == {batch}
    assert sizes[1:] == [4] * 19
    held = L.latest_snapshot(spark, out)
    spark.range(10).select(F.lit(99).alias("n")).write.parquet(f"{out}/version=20")  # complete, but no pointer names it yet
    spark.createDataFrame([("x",)], "v string").write.text(f"{out}/pointer=21")
    remove(spark, f"{out}/pointer=21/_SUCCESS")  # a pointer whose writing was broken off
    assert {r.n for r in L.latest_snapshot(spark, out).collect()} == {19}
    write(spark.range(10).select(F.lit(20).alias("n")), 20)
    assert {r.n for r in held.collect()} == {19} and {r.n for r in L.latest_snapshot(spark, out).collect()} == {20}


def _seen_batches(spark, n, size=40):
    cols = "fingerprint string, run_id string, ordinal int"
    return [spark.createDataFrame([(f"f{(k * 7 + i * 3) % (25 + 10 * k)}", f"r{k}", k * 1000 + i) for i in range(size)], cols) for k in range(n)]


def _first_seen_by_hand(batches):
    seen, out = {}, {}
    for df in batches:
        for r in sorted(df.collect(), key=lambda r: r.ordinal):
            out[r.ordinal] = ("recurring" if r.fingerprint in seen else "new", seen.setdefault(r.fingerprint, r.run_id))
    return out


def test_seen_state_survives_a_crash_at_every_step(spark):
    batches = _seen_batches(spark, 5)
    tracker = L.SeenTracker(spark, shared_path(spark, "seen"), ["ordinal"])
    for k, df in enumerate(batches):
        fresh = L.SeenTracker(spark, tracker.path, ["ordinal"])  # a new process
        if k == 1:  # broken off after the question
            fresh._ask(L.first_seen(df, ["ordinal"]).filter("status = 'new'"), k)
        if k == 2:  # broken off after the answer
            fresh._ask(L.first_seen(df, ["ordinal"]).filter("status = 'new'"), k)
            fresh._answer(df.schema["fingerprint"], df.schema["run_id"])
        fresh(df, k)
        if k == 3:  # done, but not noted by the stream
            L.SeenTracker(spark, tracker.path, ["ordinal"])(df, k)
    got = {r.ordinal: (r.status, r.first_seen_run) for r in tracker.result().collect()}
    assert got == _first_seen_by_hand(batches)


def test_seen_state_reads_no_more_in_later_batches(spark):
    """Batches of one size: what they read and leave behind does not grow."""
    tracker = L.SeenTracker(spark, shared_path(spark, "seen"), ["ordinal"])
    kept = []
    for k, df in enumerate(_seen_batches(spark, 6)):
        tracker(df, k)
        kept.append((len([f for f in folders(spark, f"{tracker.path}/asked") if f.startswith("batch=")]), len([f for f in folders(spark, f"{tracker.path}/answered") if f.startswith("turn=")])))
    assert kept[2:] == [(2, 2)] * 4
    tracker(spark.createDataFrame([], "fingerprint string, run_id string, ordinal int"), 6)
    assert tracker.result().count() == 240


def _arrivals(spark, gate, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(None if t is None else datetime.datetime.fromisoformat(f"2024-01-01T{t}:00"), key) for t, key in rows], "ts timestamp, key string")
        gate(df, k)


def test_late_gate_accounts_for_every_event_once(spark):
    batches = [[("10:00", "a"), ("10:30", "a")], [("10:19", "late"), ("10:20", "late"), ("10:21", "b"), ("11:00", "b")], [], [("10:50", "late"), ("10:51", "c"), (None, "late")], [("09:00", "late")]]
    gate = W.LateGate(spark, shared_path(spark, "gate"), "10 minutes")
    _arrivals(spark, gate, batches)
    _arrivals(spark, W.LateGate(spark, gate.path, "10 minutes"), batches[:3])  # repeated after a restart
    passed, late = spark.read.parquet(f"{gate.path}/passed"), gate.late_rows()
    assert sorted(r.key for r in passed.collect()) == ["a", "a", "b", "b", "c"] and {r.key for r in late.collect()} == {"late"}
    assert passed.count() + late.count() == sum(map(len, batches))
    assert {r.batch: r.watermark and r.watermark.strftime("%H:%M") for r in gate.watermarks().collect()} == {0: None, 1: "10:20", 2: "10:50", 3: "10:50", 4: "10:50"}


def test_late_gate_repeats_a_batch_that_was_broken_off(spark):
    batches = [[("10:00", "a")], [("10:05", "b"), ("09:00", "late")]]
    gate = W.LateGate(spark, shared_path(spark, "gate"), "10 minutes")
    _arrivals(spark, gate, batches)
    before = sorted(spark.read.parquet(f"{gate.path}/passed").inputFiles())
    remove(spark, f"{gate.path}/clock/batch=1")
    remove(spark, f"{gate.path}/late/batch=1/_SUCCESS")
    _arrivals(spark, gate, batches)
    assert sorted(spark.read.parquet(f"{gate.path}/passed").inputFiles()) == before  # readers of what passed see no file twice
    assert gate.late_rows().count() == 1 and gate.watermarks().count() == 2


def test_sessions_and_sliding_windows_drop_nothing_that_passed(spark):
    gate = W.LateGate(spark, shared_path(spark, "gate"), "30 minutes")
    batches = [[("10:00", "a"), ("10:10", "a"), ("12:00", "b")], [("11:40", "a"), ("11:55", "a"), ("11:00", "a")], [("14:00", "a")]]
    _arrivals(spark, gate, batches)
    schema = spark.read.parquet(f"{gate.path}/passed").drop("batch").schema
    out = {}
    for name, made in (("sessions", lambda s: W.session_counts(s, "30 minutes", "20 minutes", ["key"])), ("sliding", lambda s: W.sliding_counts(s, "30 minutes", "1 hour", "30 minutes", ["key"]))):
        out[name] = shared_path(spark, name)
        L.run_to_end(made(gate.passed(schema)), L.overwrite_batches(out[name]), name)
    sessions = {(r.key, f"{r.session_start:%H:%M}", f"{r.session_end:%H:%M}", r.n) for r in spark.read.parquet(out["sessions"]).collect()}
    assert sessions == {("a", "10:00", "10:30", 2), ("b", "12:00", "12:20", 1), ("a", "11:40", "12:15", 2)}
    sliding = {(r.key, f"{r.window_start:%H:%M}", r.n) for r in spark.read.parquet(out["sliding"]).collect()}
    assert sliding == {("a", "09:30", 2), ("a", "10:00", 2), ("a", "11:00", 2), ("a", "11:30", 2), ("b", "11:30", 1), ("b", "12:00", 1)}
    assert [r.key for r in gate.late_rows().collect()] == ["a"]
