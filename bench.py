"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from glintmark.plans.catalog import QUERIES
from glintmark.session import build_session

HEADLINE = [
    "score_bands", "dedup_findings", "band_ranks", "cross_source_suppress", "run_diff", "first_seen", "running_cost",
    "budget_cutoff", "vote_verdict", "confusion_rollup", "token_packing", "fingerprints", "redact_text", "line_rules",
    "security_weight", "context_windows", "path_resolve", "reach_backward", "pagerank", "dimension_scores",
    "quality_index", "source_metrics", "sarif_roundtrip", "seen_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus),
        {"spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["verdict_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
