"""Streams over the ledger and findings, run to the end of their input and read back."""

from pyspark.sql import functions as F

from glintmark.functions.text import fingerprint
from glintmark.operators import reports, scoring
from glintmark.plans.catalog.registry import ORD, ORDER, query, scored_sql
from glintmark.plans.catalog.runs import _CALLS, _PRICED, _SLICE, _priced
from glintmark.plans.views import sql_with, table, view
from glintmark.session import shared_path
from glintmark.sources import ledger as lines
from glintmark.streaming import ledger as L
from glintmark.streaming import windows as W
from glintmark.streaming.stages import Stages


def _parts(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ledger(spark, sf):
    """Events written as ledger lines, dealt at random to as many files as a shuffle has parts."""
    path = shared_path(spark, "ledger")
    table(spark, sf, "events").repartition(_parts(spark)).select(
        lines.event_line(F.col("ts"), F.col("event_type"), run_id=F.col("user_id").cast("string"), value=F.col("value"))
    ).write.text(path)
    return path


@query("""SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type""")
def ledger_counts(spark, sf):
    out = shared_path(spark, "kind_counts")
    counts = L.kind_counts(L.ledger_stream(spark, _ledger(spark, sf), files_per_batch=-(-_parts(spark) // 4)))
    L.run_to_end(counts, L.snapshot_batches(out), "kind_counts", mode="complete")
    return L.latest_snapshot(spark, out)


# Events in four quarters of the ledger; every tenth comes a batch late, every fiftieth two. An event more than two days behind is late.
_LATE = "2 days"
_BATCHES = 5
_GATED = """b AS (SELECT *, least(4, CAST(floor(4 * event_id / (SELECT max(event_id) + 1 FROM events)) AS INT) + CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS batch FROM events),
marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM b GROUP BY batch),
gated AS (SELECT b.*, mark, coalesce(ts <= mark, false) AS late FROM b JOIN marks USING (batch)),
closed AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 2 DAY AS until FROM gated)"""


def _gate(spark, sf):
    """The ledger, arriving in five batches, behind a gate that resumes from its checkpoint each time."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    delay = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    batch = F.least(F.lit(_BATCHES - 1), F.floor(F.col("event_id") * 4 / (last + 1)) + delay)
    inbox, checkpoint = shared_path(spark, "ledger"), shared_path(spark, "gate-checkpoint")
    gate = W.LateGate(spark, shared_path(spark, "gate"), _LATE)
    for k in range(_BATCHES):
        events.filter(batch == k).select(
            lines.event_line(F.col("ts"), F.col("event_type"), run_id=F.col("user_id").cast("string"), event_id=F.col("event_id").cast("string"))
        ).write.mode("append").text(inbox)
        L.run_to_end(L.ledger_stream(spark, inbox), gate, "gate", checkpoint=checkpoint)
    return gate


def _passed(spark, gate):
    return gate.passed(spark.read.parquet(f"{gate.path}/passed").drop("batch").schema)


@query(f"""WITH {_GATED} SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS kind, count(*) AS n FROM gated WHERE NOT late GROUP BY 1, 2""")
def event_windows(spark, sf):
    """Every tumbling window, open ones too, of the events that are not late."""
    out = shared_path(spark, "windows")
    L.run_to_end(L.windowed_counts(_passed(spark, _gate(spark, sf)), late=_LATE), L.overwrite_batches(out), "windows", mode="update")
    return L.latest_rows(spark, out, ["window_start", "kind"], "n").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n")


@query(f"""WITH {_GATED}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - unnest([0, 6, 12, 18]) * INTERVAL 1 HOUR AS window_start, event_type AS kind FROM gated WHERE NOT late)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, kind, count(*) AS n FROM w GROUP BY window_start, kind HAVING window_start + INTERVAL 1 DAY <= (SELECT until FROM closed)""")
def sliding_windows(spark, sf):
    """Closed windows of a day that begin every six hours, read from the gate in several micro-batches."""
    out = shared_path(spark, "sliding")
    stream = _passed(spark, _gate(spark, sf))
    L.run_to_end(W.sliding_counts(stream, _LATE, "1 day", "6 hours", ["kind"]), L.overwrite_batches(out), "sliding")
    rows = spark.read.parquet(out)
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "kind", "n")


@query(f"""WITH {_GATED}, o AS (SELECT user_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOURS AS starts FROM gated WHERE NOT late),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors
FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT until FROM closed)""")
def session_windows(spark, sf):
    """Closed sessions of every user, twelve hours without an event apart."""
    out = shared_path(spark, "sessions")
    stream = _passed(spark, _gate(spark, sf))
    sessions = W.session_counts(stream, _LATE, "12 hours", ["run_id"], errors=F.count_if(F.col("kind") == "error"))
    L.run_to_end(sessions, L.overwrite_batches(out), "sessions")
    rows = spark.read.parquet(out)
    return rows.select("run_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n", "errors")


@query(f"""WITH {_GATED} SELECT event_id, batch, mark AS watermark, late FROM gated""")
def late_events(spark, sf):
    """Every event once: with the watermark it was behind if it was late, or as one that passed."""
    gate = _gate(spark, sf)
    marks = gate.watermarks().select("batch", F.col("watermark").cast("timestamp_ntz").alias("watermark"))
    both = [spark.read.parquet(f"{gate.path}/{side}").select(F.col("fields")["event_id"].cast("bigint").alias("event_id"), "batch", F.lit(late).alias("late"))
            for side, late in (("passed", False), ("late", True))]
    return both[0].unionByName(both[1]).join(marks, "batch").select("event_id", "batch", "watermark", "late")


@query(f"""{_CALLS}, {_PRICED}, c AS (SELECT run_id, seq, coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM priced)
SELECT run_id, seq, b::DOUBLE AS spent_before, b < 1.0 AS allowed FROM c""")
def budget_guard(spark, sf):
    """The log arrives in two halves; the second run resumes from the first one's checkpoint and state."""
    calls = _priced(spark, sf).select("run_id", "seq", "cost_usd")
    half = calls.agg(F.max("seq")).first()[0] // 2
    inbox, state, checkpoint = (shared_path(spark, n) for n in ("calls", "guard", "guard-checkpoint"))
    guard = L.BudgetGuard(spark, state, 1.0, "run_id", ["seq"], F.floor(F.col("seq") / _SLICE))
    for part in (calls.filter(F.col("seq") <= half), calls.filter(F.col("seq") > half)):
        part.write.mode("append").parquet(inbox)
        L.run_to_end(spark.readStream.schema(calls.schema).parquet(inbox), guard, "guard", checkpoint=checkpoint)
    return guard.result().select("run_id", "seq", F.col("spent_before").cast("double").alias("spent_before"), "allowed")


@query(f"""{sql_with('findings')}, t AS (SELECT sha256(coalesce(cwe, '') || '||' || file || '|' || CAST(line AS VARCHAR))[:16] AS fingerprint, run_no, {ORD} FROM findings)
SELECT {ORD}, fingerprint, first_value('run' || run_no) OVER w AS first_seen_run, CASE WHEN row_number() OVER w = 1 THEN 'new' ELSE 'recurring' END AS status
FROM t WINDOW w AS (PARTITION BY fingerprint ORDER BY run_no, {ORD})""")
def seen_state(spark, sf):
    """Findings arrive run by run, those of the last run in two halves; each start of the stream goes on from its state."""
    f = view(spark, sf, "findings").select(
        *ORDER, "run_no", F.concat(F.lit("run"), F.col("run_no").cast("string")).alias("run_id"),
        fingerprint(F.col("cwe"), F.lit(""), F.col("file"), F.col("line").cast("string")).alias("fingerprint"))
    inbox, state, checkpoint = (shared_path(spark, n) for n in ("tracked", "seen", "seen-checkpoint"))
    tracker = L.SeenTracker(spark, state, ["run_no", *ORDER])
    half = f.agg(F.percentile_approx("ordinal", 0.5)).first()[0]
    last = F.col("run_no") == 2
    for part in (f.filter("run_no = 0"), f.filter("run_no = 1"), f.filter(last & (F.col("ordinal") <= half)), f.filter(last & (F.col("ordinal") > half))):
        part.write.mode("append").parquet(inbox)
        L.run_to_end(spark.readStream.schema(f.schema).parquet(inbox), tracker, "seen", checkpoint=checkpoint)
    return tracker.result().select(*ORDER, "fingerprint", "first_seen_run", "status")


@query(f"""{sql_with('findings', 'manifest')}, {scored_sql('findings')} SELECT band, level, count(*) AS n FROM scored GROUP BY band, level""")
def snapshot(spark, sf):
    """Band counts rewritten after every batch of findings."""
    f = view(spark, sf, "findings")
    inbox, out = shared_path(spark, "findings"), shared_path(spark, "snapshot")
    f.repartition(_parts(spark)).write.parquet(inbox)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", -(-_parts(spark) // 4)).parquet(inbox)
    scored = scoring.score(scoring.with_exposure(stream, view(spark, sf, "manifest")))
    L.run_to_end(scored.groupBy("band", "level").agg(F.count(F.lit(1)).alias("n")), L.snapshot_batches(out), "snapshot", mode="complete")
    return L.latest_snapshot(spark, out)


@query(f"""{sql_with('findings', 'manifest')}, {scored_sql('findings')} SELECT run_no, count(*) FILTER (band = 'LOW') AS low, count(*) AS total FROM scored GROUP BY run_no""")
def stage_resume(spark, sf):
    """Scoring and counting as stages; the second pass must find both done and run neither."""
    stages = Stages(spark, shared_path(spark, "stages"))

    def must_not_run():
        raise AssertionError("a finished stage ran again")

    scored = stages.run("scored", lambda: scoring.score(scoring.with_exposure(view(spark, sf, "findings"), view(spark, sf, "manifest"))))
    stages.run("counts", lambda: reports.report_counts(scored, ["run_no"]))
    stages.run("scored", must_not_run)
    return stages.run("counts", must_not_run).select("run_no", "low", "total")


