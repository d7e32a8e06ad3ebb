"""Operators against literal cases, brute force and shuffled input."""

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from glintmark import session
from glintmark.functions import constants as K
from glintmark.operators import analyzers, dedup, evaluation, graph, history, matching, packing, prefix, quality, reports, retries, rules, scoring
from glintmark.session import Scratch

FINDING = "ordinal bigint, rule_id string, cwe string, file string, line int, level string"


def random_findings(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice("ABC"), rnd.choice([None, "89"]), rnd.choice(["", "f", "g"]), rnd.choice([0, 1, 2]),
             rnd.choice(["error", "Warning", "note", "none", "odd", None])) for i in range(n)]


def loop_dedup(rows):
    rank = {"error": 4, "warning": 3, "note": 2, "none": 1}
    kept = {}
    for row in rows:
        key = (row[2] or row[1], row[3], row[4])
        value = rank.get((row[5] or "none").lower(), 0)
        if key not in kept:
            kept[key] = [row, value, row[0]]
        elif value > kept[key][1]:
            kept[key][:2] = [row, value]
    return sorted((r[0][0], r[2]) for r in kept.values())


def test_dedup_equals_a_loop_in_any_input_order(spark):
    rows = random_findings(300)
    for parts in (1, 7):
        shuffled = rows[:]
        random.Random(parts).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, FINDING).repartition(parts)
        got = sorted((r.ordinal, r.position.ordinal) for r in dedup.dedup_findings(df, ["ordinal"]).collect())
        assert got == loop_dedup(rows)


def test_single_document_passes_through(spark):
    df = spark.createDataFrame([("d", 0, *r) for r in random_findings(20)], "doc string, run_pos int, " + FINDING)
    assert dedup.is_single_document(df)
    assert dedup.dedup_findings(df, ["ordinal"], pass_through=True).count() == 20


def test_model_findings_without_line_are_never_suppressed(spark):
    scan = spark.createDataFrame([("a", 3), ("a", 0)], "file string, line int")
    model = spark.createDataFrame(
        [(1, "SR-1", "a", 3, "CWE-1"), (2, "SR-1", "a", None, "CWE-1"), (3, "SR-1", "a", 0, "CWE-1"), (4, "SR-2", "a", None, "CWE-1"), (5, "SR-3", "b", 3, None)],
        "ordinal int, rule_id string, file string, line int, cwe string")
    left = dedup.dedup_model_findings(dedup.suppress_reported(model, scan), ["ordinal"])
    assert sorted(r.ordinal for r in left.collect()) == [2, 4]


def test_running_totals_with_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{i % 20}", i, rnd.randint(0, 9)) for i in range(2000)]
    want, totals = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = (totals.get(g, (0, 0))[0], totals.get(g, (0, 0))[1])
        totals[g] = (totals.get(g, (0, 0))[0] + v, totals.get(g, (0, 0))[1] + 1)
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    measures = {"s": F.col("v"), "c": F.lit(1).cast("bigint")}
    for slices in (None, F.floor(F.col("i") / 100)):
        got = {r.i: (r.s, r.c) for r in prefix.running_totals(df, ["g"], ["i"], measures, slices).collect()}
        assert got == want


def test_percentile_and_gini_from_histograms(spark):
    rnd = random.Random(5)
    groups = {f"g{n}": [rnd.randint(0, 30) for _ in range(n)] for n in (1, 2, 9, 10, 11, 100)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v int")
    p90 = {r.g: r.p for r in prefix.index_percentile(df, ["g"], "v", 0.9, "p").collect()}
    assert p90 == {g: sorted(vs)[min(int(len(vs) * 0.9), len(vs) - 1)] for g, vs in groups.items()}

    def gini(vs):
        n, s = len(vs), sorted(vs)
        return 0.0 if n < 2 or not sum(s) else sum((2 * (i + 1) - n - 1) * v for i, v in enumerate(s)) / (n * sum(s))

    got = {r.g: r.gini for r in prefix.gini(df, ["g"], "v").collect()}
    assert got == pytest.approx({g: gini(vs) for g, vs in groups.items()})


def test_page_rank_rounds_join_by_numbers(spark, monkeypatch):
    kinds, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: kinds.update({name: dict(df.dtypes)}) or save(self, df, name))
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "c"), ("b", "e"), ("x", "a"), (None, "a")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame([(n,) for n in "abcde"], "node string"), df).collect()}
    kept = [(s, d) for s, d in edges if s in list("abcde") and s != d]
    rank = dict.fromkeys("abcde", 0.2)
    for _ in range(200):
        lost = sum(rank[n] for n in rank if not any(s == n for s, _ in kept))
        rank = {n: 0.03 + 0.85 * lost / 5 + 0.85 * sum(rank[s] / sum(s == t for t, _ in kept) for s, d in kept if d == n) for n in rank}
    assert got == pytest.approx({n: r / max(rank.values()) for n, r in rank.items()}, abs=1e-5)
    assert {k["node"] for name, k in kinds.items() if name.startswith("round=")} == {"bigint"}


def test_few_files_exist_as_python_objects_at_once():
    class Batch:
        def __init__(self, rows):
            self.num_rows, self.rows = len(rows), rows

        def slice(self, at, n):
            return Batch(self.rows[at:at + n])

        def to_pylist(self):
            made.append(self.num_rows)
            return self.rows

    made = []
    assert list(analyzers._few_at_once([Batch(list(range(1000))), Batch([]), Batch([1000])])) == list(range(1001))
    assert max(made) <= 32


def counted(df, seen):
    """``df``, whose rows are added up in ``seen`` as often as they are made."""

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def test_reach_makes_its_seeds_once(spark):
    seen = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "caller string, callee string, confidence double")
    seeds = counted(spark.createDataFrame([("t", "c"), ("u", "b")], "tag string, node string"), seen)
    got = sorted(map(tuple, graph.reach(seeds, edges, 2).collect()))
    assert got == [("t", "a", 2), ("t", "b", 1), ("t", "c", 0), ("u", "a", 1), ("u", "b", 0)] and seen.value == 2


def test_affected_checks_make_the_blast_once(spark):
    seen = spark.sparkContext.accumulator(0)
    checks = spark.createDataFrame([("89", "backward", "89"), ("79", "forward", "79")], "cwe_id string, direction string, sinks string")
    edges = spark.createDataFrame([("a", "cursor.execute", "f.py")], "caller string, callee string, file string")
    files = spark.createDataFrame([("a", "f.py")], "qname string, file string")
    blast = counted(spark.createDataFrame([("f.py",), ("g.py",)], "file string"), seen)
    got = graph.affected_checks(checks, blast, edges, files, spark.createDataFrame([("b",)], "qname string")).collect()
    assert [tuple(r) for r in got] == [("89", True)] and seen.value == 2


def test_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("v"))
    assert session.dealt(df, 1000, "k") is df
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    sizes = [r["count"] for r in session.dealt(df, 1000, "k").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100


def test_confusion_rows_are_dealt_by_the_number_of_predictions(spark, monkeypatch):
    rnd = random.Random(8)
    place = lambda: (f"f{rnd.randint(0, 1)}", rnd.randint(0, 6))
    predictions = spark.createDataFrame(
        [(rnd.choice("mn"), rnd.randint(0, 1), rnd.randint(0, 9), rnd.choice(["source", "patched"]), *place()) for _ in range(400)],
        "model string, run_no int, case_id bigint, variant string, file string, line int")
    truth = spark.createDataFrame([(rnd.randint(0, 9), *place(), "true_positive") for _ in range(40)], "case_id bigint, file string, line int, label string")
    runs = spark.createDataFrame([(m, r, c, c % 2 == 0) for m in "mn" for r in (0, 1) for c in range(10)], "model string, run_no int, case_id bigint, has_patched boolean")
    few = evaluation.confusion_rows(predictions, truth, runs)
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    many = evaluation.confusion_rows(predictions, truth, runs)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({by}, 20), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "", plan) for by in ("case_id", "case_id, file, line"))


def loop_pack(sizes, available):
    used, out = 0, []
    for size in sizes:
        if size is None:
            out.append(("included", None))
        elif used + size <= available:
            used += size
            out.append(("included", None))
        elif used < available:
            out.append(("truncated", (available - used) * 4))
            used = available
        else:
            out.append(("omitted", None))
    return out


@pytest.mark.parametrize("available", [0, 5, 20, -3])
def test_packing_equals_a_loop(spark, available):
    rnd = random.Random(available)
    rows = [(g, i, rnd.choice([None, 0, 0, 1, 3, 5, 9])) for g in range(40) for i in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, tokens int")
    got = {(r.g, r.i): (r.packed, r.keep_chars) for r in packing.pack_files(df, ["g"], ["i"], available, 0, slice_by=F.col("i") % 1).collect()}
    want = {}
    for g, items in groupby(rows, key=lambda r: r[0]):
        items = list(items)
        want.update({(g, i[1]): r for i, r in zip(items, loop_pack([x[2] for x in items], available))})
    assert got == want


def test_budget_stops_before_a_batch(spark):
    calls = spark.createDataFrame([("r", i, 1.0) for i in range(7)], "run_id string, seq int, cost_usd double")
    got = [(r.batch_no, r.cost_before, r.ran) for r in history.budget_cutoff(calls, ["run_id"], ["seq"], 2, 4.0, F.lit(0)).orderBy("seq").collect()]
    assert got == [(0, 0.0, True)] * 2 + [(1, 2.0, True)] * 2 + [(2, 4.0, False)] * 2 + [(3, 6.0, False)]


def test_repeat_in_one_run_is_recurring(spark):
    df = spark.createDataFrame([("f", "r1", 1, 1), ("f", "r1", 1, 2), ("f", "r2", 2, 1), ("g", "r2", 2, 2)], "fingerprint string, run_id string, at int, ordinal int")
    got = {(r.fingerprint, r.at, r.ordinal): (r.first_seen_run, r.status) for r in history.first_seen(df, ["at", "ordinal"]).collect()}
    assert got == {("f", 1, 1): ("r1", "new"), ("f", 1, 2): ("r1", "recurring"), ("f", 2, 1): ("r1", "recurring"), ("g", 2, 2): ("r2", "new")}


def test_path_resolution_against_a_loop(spark):
    rnd = random.Random(9)
    files = [f"{a}/{b}/{c}.py" for a in "ab" for b in "xy" for c in "mn"] + ["m.py", "q.py", "a/q.py", "z/only.py"]
    raws = files + ["./a/x/m.py", "x/m.py", "root/a/x/m.py", "only.py", "k/only.py", "", "unknown", "q.py", "../z/only.py", "nothing.py", "deep/z/only.py"]
    included = rnd.sample(files, 9)

    def loop(raw):
        if not raw or raw == "unknown":
            return "unknown"
        cand = raw.lstrip("./")
        if cand in included:
            return cand
        for matches in ([p for p in included if p.endswith("/" + cand) or cand.endswith("/" + p)],
                        [p for p in included if p.split("/")[-1] == cand.split("/")[-1]]):
            if len(matches) == 1:
                return matches[0]
        return "unknown"

    out = matching.resolve_paths(spark.createDataFrame([(1, r) for r in raws], "c int, raw string"),
                                 spark.createDataFrame([(1, f) for f in included], "c int, file string"), ["c"])
    assert {r.raw: r.file for r in out.collect()} == {r: loop(r) for r in raws}


EDGES = [("A", "B", 0.9), ("B", "C", 0.9), ("C", "sink", 0.9), ("D", "E", 0.9), ("X", "C", 0.1)]


@pytest.fixture
def chain(spark):
    return spark.createDataFrame(EDGES, "caller string, callee string, confidence double")


def test_reach_stops_at_hops_and_weak_edges(spark, chain):
    seeds = spark.createDataFrame([("t", "C")], "tag string, node string")
    back = {r.node: r.depth for r in graph.reach(seeds, chain, 5).collect()}
    assert back == {"C": 0, "B": 1, "A": 2}
    assert {r.node for r in graph.reach(seeds, chain, 1).collect()} == {"C", "B"}
    assert {r.node for r in graph.reach(seeds, chain, 1, min_confidence=0.0).collect()} == {"C", "B", "X"}
    start = spark.createDataFrame([("t", "A")], "tag string, node string")
    assert {r.node for r in graph.reach(start, chain, 3, "forward").collect()} == {"A", "B", "C", "sink"}


def test_reach_of_many_tags_equals_one_walk_each(spark, monkeypatch):
    """More tags than a long and than a mask hold, with limits of their own, a null tag and a tag without seeds in the graph."""
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 0.9) for a, b in pairs], "caller string, callee string, confidence double")
    seeds = [(t, f"n{rng.randrange(60)}") for t in range(150) for _ in range(rng.randint(1, 3))] + [(None, "n3"), (7, "elsewhere")]
    df = spark.createDataFrame(seeds, "check int, node string")
    want = set()
    for t in {t for t, _ in seeds}:
        front = {n for s, n in seeds if s == t}
        seen, limit = dict.fromkeys(front, 0), 4 if t is None else t % 5
        for hop in range(1, min(4, limit) + 1):
            front = {f"n{a}" for a, b in pairs if f"n{b}" in front} - seen.keys()
            seen |= dict.fromkeys(front, hop)
        want |= {(t, n, d) for n, d in seen.items()}
    limit = F.coalesce(F.col("check") % 5, F.lit(4))
    for words in (16, 1):
        monkeypatch.setattr(graph, "_WORDS", words)
        got = [tuple(r) for r in graph.reach(df, edges, 4, tag="check", max_hops=limit).collect()]
        assert set(got) == want and len(got) == len(want)
    assert graph.reach(df.limit(0), edges, 4, tag="check").collect() == []


def test_both_ways_falls_back_to_the_side_that_has_files(spark):
    back = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "tag string, file string")
    ahead = spark.createDataFrame([("b",), ("z",)], "file string")
    got = {(r.tag, r.file) for r in graph.both_ways(back, ahead, ["1", "2", "3"]).collect()}
    assert got == {("1", "b"), ("2", "c"), ("3", "b"), ("3", "z")}


def _cyclic_by_hand(edges):
    """Strongly connected components by reachability of every node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        todo, seen = [a], set()
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[a] = seen
    return {(a, max(b for b in reach[a] if a in reach.get(b, ()))) for a in reach if a in reach[a]}


@pytest.mark.parametrize("seed", range(5))
def test_cycles_equal_mutual_reachability(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range([60, 75, 90, 110, 160][seed])}
    edges |= {(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)} | {("x", "x"), ("n1", "c0"), ("c5", "n2"), ("l0", "l1"), ("l1", "l0")}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(5)} | {("h", "k0"), ("k0", "k1"), ("k1", "h")} | {(f"d{i}", f"d{i + 1}") for i in range(12)} | {("d3", "h")}
    got = [tuple(r) for r in graph.cyclic_components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()]
    assert set(got) == _cyclic_by_hand(edges) and len(got) == len(set(got))


def test_a_long_chain_costs_few_rounds(spark, monkeypatch):
    saves = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saves.append(name) or save(self, df, name))
    edges = [(f"v{i:05}", f"v{i + 1:05}") for i in range(10_000)] + [("v10000", "v09998")]
    got = {tuple(r) for r in graph.cyclic_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {(f"v{i:05}", "v10000") for i in (9998, 9999, 10000)} and len(saves) < 40


def loop_pagerank(nodes, edges):
    out = {n: [b for a, b in edges if a == n and b != n and b in nodes] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(100):
        lost = sum(r for n, r in rank.items() if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
        for n in nodes:
            for m in out[n]:
                new[m] += 0.85 * rank[n] / len(out[n])
        delta, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if delta < 1e-6:
            break
    top = max(rank.values())
    return {n: r / top for n, r in rank.items()}


def test_pagerank_equals_the_plain_iteration(spark):
    rnd = random.Random(2)
    nodes = [f"n{i}" for i in range(12)]
    edges = list({(rnd.choice(nodes[:9]), rnd.choice(nodes)) for _ in range(25)}) + [("n0", "gone")]
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r.node: r["rank"] for r in got.collect()} == pytest.approx(loop_pagerank(nodes, edges), abs=1e-9)


def test_cycles_do_not_depend_on_order(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c"), ("e", "f"), ("g", "g"), ("f", "h")]
    got = {(r.node, r.component) for r in graph.cyclic_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {("a", "b"), ("b", "b"), ("c", "e"), ("d", "e"), ("e", "e"), ("g", "g")}
    dag = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.cyclic_components(dag).count() == 0


def test_word_selection_falls_back_to_weight(spark):
    m = spark.createDataFrame([("src/plain.py", "python", 5), ("src/low.py", "python", 1), ("src/auth.py", "python", 0), ("x/controller.json", "config", 9)],
                              "file string, language string, weight int")
    got = {}
    for r in matching.files_by_words(m).collect():
        got.setdefault(r.cwe_id, set()).add(r.file)
    assert got["521"] == {"src/auth.py"} and got["79"] == {"src/plain.py"}


def test_evidence_needs_every_word(spark):
    cases = spark.createDataFrame([(1, "found", None, ["Rate", "limit"]), (2, "found", "HIGH", ["absent"]), (3, "not_found", None, []), (4, "not_found", None, []), (5, "found", None, [])],
                                  "case_id int, expect string, severity string, evidence_contains array<string>")
    found = spark.createDataFrame([(1, "LOW", "rate", "", ""), (1, "LOW", "", "a LIMIT", ""), (2, "LOW", "x", "", ""), (3, "LOW", "x", "", "")],
                                  "case_id int, severity string, evidence string, description string, title string")
    rows = evaluation.case_status(evaluation.evidence_matches(cases, found, ["case_id"]))
    assert {r.case_id: r.status for r in rows.collect()} == {1: "PASS", 2: "FAIL", 3: "FP", 4: "PASS", 5: "FAIL"}
    assert {r.case_id: r.severity_ok for r in rows.collect()}[2] is False
    s = evaluation.status_summary(rows, []).first()
    assert (s.passed, s.failed, s.false_positives, s.precision, s.recall) == (2, 2, 1, 0.5, pytest.approx(1 / 3))


def test_confusion_counts(spark):
    truth = spark.createDataFrame([(1, "f", 10, "true_positive"), (1, "f", 30, "true_positive"), (1, "f", 50, "noise")], "case_id int, file string, line int, label string")
    pred = spark.createDataFrame([("m", 0, 1, "source", "f", 11), ("m", 0, 1, "source", "f", 11), ("m", 0, 1, "source", "f", 20), ("m", 0, 1, "patched", "f", 10), ("m", 0, 9, "source", "f", 1)],
                                 "model string, run_no int, case_id int, variant string, file string, line int")
    ran = spark.createDataFrame([("m", 0, 1, True), ("m", 0, 2, True), ("m", 0, 3, False)], "model string, run_no int, case_id int, has_patched boolean")
    got = {r.case_id: (r.tp, r.fp, r.tn, r.fn) for r in evaluation.confusion_rows(pred, truth, ran).collect()}
    assert got == {1: (1, 2, 0, 1), 2: (0, 0, 2, 0), 3: (0, 0, 1, 0)}


def test_metrics_without_cases_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (3, 1, 2, 1)], "tp bigint, fp bigint, tn bigint, fn bigint")
    a, b = evaluation.detection_metrics(df).collect()
    assert (a.precision, a.recall, a.f_beta, a.mcc, a.youden_j) == (0.0, 0.0, 0.0, 0.0, -1.0)
    assert b.f_beta == pytest.approx(0.75) and b.mcc == pytest.approx((6 - 1) / (4 * 4 * 3 * 3) ** 0.5)


@pytest.mark.parametrize("samples,votes,want", [
    (1, ["FALSE_POSITIVE"], "FALSE_POSITIVE"), (3, ["CONFIRMED", "CONFIRMED", None], "CONFIRMED"), (3, ["CONFIRMED", None, None], "NEEDS_CONTEXT"),
    (4, ["CONFIRMED", "CONFIRMED", "FALSE_POSITIVE", "NEEDS_CONTEXT"], "FALSE_POSITIVE"), (3, [None, None, None], "NEEDS_CONTEXT")])
def test_votes(spark, samples, votes, want):
    v = spark.createDataFrame([(1, i, x, x is None) for i, x in enumerate(votes)], "finding_id int, sample_id int, vote string, failed boolean")
    row = evaluation.vote_verdicts(spark.createDataFrame([(1,)], "finding_id int"), v, F.lit(samples)).first()
    assert row.verdict == want and row.unresolved == (not any(votes))


def test_actionable_falls_back_when_nothing_reaches_the_threshold(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.0), (3, 0.05)], "ordinal int, priority double")
    assert [r.ordinal for r in reports.actionable(rows, ["ordinal"]).collect()] == [1, 3]
    more = rows.union(spark.createDataFrame([(4, 0.3)], "ordinal int, priority double"))
    assert [r.ordinal for r in reports.actionable(more, ["ordinal"]).collect()] == [4]


def test_line_rules_skip_comments_and_exempt_paths(spark):
    text = "\n".join(["x = 1", "# shell=True", "f'shell=True'", "run(shell = True)", "SR-XXX and XXX", "except :", 'password = "0123456789"'])
    df = spark.createDataFrame([("src/a.py", text), ("tests/a.py", text)], "path string, text string")
    got = {(r.path, r.line, r.rule) for r in rules.line_rules(df).collect()}
    assert got == {("src/a.py", 4, "001.5"), ("src/a.py", 5, "002.3"), ("src/a.py", 6, "002.2"), ("src/a.py", 7, "003.1"), ("tests/a.py", 6, "002.2")}


def test_duplicate_evidence_path_fails(spark):
    from glintmark.sources import files

    df = spark.createDataFrame([("a", "1", 1, "s"), ("a", "2", 1, "s")], "path string, sha256 string, size_bytes bigint, source string")
    with pytest.raises(Exception, match="duplicate evidence path"):
        files.require_unique_paths(df).collect()


def test_call_without_price_fails(spark):
    df = spark.createDataFrame([("openai:nothing", 1, 1)], "model string, tokens_in int, tokens_out int")
    with pytest.raises(Exception, match="no price"):
        matching.priced(df).collect()


def test_mapping_outside_the_registry_fails(spark):
    from glintmark.sources import dimensions

    r = spark.createDataFrame([("t", "X", None)], "tool string, rule_id string, tags array<string>")
    bad = spark.createDataFrame([("t", "X", "CWE-99999")], "tool string, rule_id string, mapped_cwe string")
    with pytest.raises(Exception, match="outside the registry"):
        scoring.map_rules(r, r, bad, dimensions.cwe_registry(spark), [])[0].collect()


def dims(spark, scores):
    return spark.createDataFrame([("p", d, float(s)) for d, s in scores.items()], "project string, dim string, score double")


def test_composite(spark):
    even = quality.composite_index(dims(spark, {d: 81 for d in K.DIMENSIONS})).first()
    assert even.composite == pytest.approx(81.0) and even.quality_band == "Excellent" and even.floor_penalty == 1.0
    low = quality.composite_index(dims(spark, {d: 80 for d in K.DIMENSIONS} | {"security": 10})).first()
    assert low.floor_penalty == pytest.approx(0.85)
    missing = quality.composite_index(dims(spark, {"security": 50})).first()
    assert missing.composite == pytest.approx(50.0) and missing.quality_band == "Acceptable"


def test_python_metrics(spark):
    text = ('import os\n\nclass low(Base):\n    """Doc."""\n    def getName(self, x: int) -> str:\n        try:\n            eval(x)\n'
            '        except:\n            pass\n\ndef _hidden(a, b):\n    for i in a:\n        if b:\n            subprocess.run(a, shell=True)\n')
    wide = "def f(x: " + " | ".join(["int"] * 3000) + "): pass\n"
    deep = "class A(" + ".".join(["a"] * 3000) + "): pass\n"
    nested = "x = " + "(" * 5000 + "1" + ")" * 5000
    files = [("src/m.py", text), ("src/m.py", text), ("x.py", "def broken(:"), ("w.py", wide), ("d.py", deep), ("n.py", nested), ("z.py", "\0"), ("e.py", ""),
             ("y.py", None), ("k.txt", "def f(): pass"), ("u.py", "def größe(ä: 'Ö') -> Ü:\r\n  return ä\r\n")]
    df = spark.createDataFrame(files, "path string, text string")
    rows = analyzers.file_metrics(df).collect()
    m = {r.path: r for r in rows}
    assert sorted(r.path for r in rows if r.path == "src/m.py") == ["src/m.py"] * 2
    own = m["src/m.py"]
    assert (own.lines, own.functions, own.classes, own.total_callables, own.documented_callables) == (14, 2, 1, 3, 1)
    assert (own.total_params, own.annotated_params, own.annotated_returns, own.bare_excepts, own.broad_excepts) == (4, 1, 1, 2, 0)
    assert (own.max_nesting, own.naming_violations, own.public_definitions, own.private_definitions) == (2, 2, 2, 1)
    assert own.unsafe_calls == ["line 7: CWE-94: Code injection via eval()", "line 14: CWE-78: subprocess with shell=True"]
    assert [s.name for s in own.symbols] == ["low", "getName", "_hidden"] and own.symbols[1].qname == own.symbols[1].parent_qname + ".getName"
    assert own.symbols[1].params == ["x: int"] and own.symbols[0].bases == ["Base"] and own.imports == ["os"] and own.function_lengths == [5, 4]
    assert (m["e.py"].lines, m["e.py"].functions, m["e.py"].symbols) == (0, 0, [])
    assert m["u.py"].symbols[0].params == ["ä: 'Ö'"] and m["u.py"].symbols[0].return_type == "Ü"
    assert {r.path for r in analyzers.rejected_files(df).collect()} == {p for p, t in files if p.endswith(".py") and t is not None} - set(m)
    assert {"x.py", "n.py", "z.py"} <= {r.path for r in analyzers.rejected_files(df).collect()}


def test_bulk_score_isolates_failures_and_stops_on_fatal(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")

    def half(row):
        return 1 // (row["x"] - 1)

    got = {r.x: (r.score, r.error_type) for r in analyzers.bulk_score(df, half, "score", 2).collect()}
    assert got == {1: (None, "ZeroDivisionError"), 2: ("1", None)}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        analyzers.bulk_score(df, half, "score", fatal=lambda e: isinstance(e, ZeroDivisionError)).collect()


def _trimmed_by_hand(items, budget):
    """Cut one code map step by step until it fits."""
    left = list(items)

    def fits():
        return sum(i["tokens"] for i in left) <= budget

    steps = [[i] for i in sorted((i for i in items if i["kind"] == "symbol"), key=lambda i: (i["rank"], i["module"], i["name"]))]
    steps += [[i for i in items if i["kind"] == kind] for kind in ("private_method", "constant", "import")]
    rest = [i for i in items if i["kind"] == "module"]
    steps.append([i for i in rest if i["module_lines"] < 20])
    for module in sorted({(i["module_rank"], i["module"]) for i in rest if i["module_lines"] >= 20}):
        steps.append([i for i in rest if (i["module_rank"], i["module"]) == module])
    decided = 0
    for gone in steps:
        if fits():
            break
        left = [i for i in left if i not in gone]
        decided += 1
    return {(i["module"], i["name"]) for i in left}


def test_trim_in_stages_equals_cutting_step_by_step(spark):
    rng = random.Random(4)
    rows, budgets, want = [], [], {}
    for project in range(14):
        modules = {f"m{k}": (rng.choice([5, 19, 20, 80]), float(rng.randrange(4))) for k in range(5)}
        items = [dict(project=project, kind=rng.choice(["symbol", "symbol", "private_method", "constant", "import", "module"]), module=m, name=f"x{n}", rank=float(rng.randrange(3)),
                      tokens=rng.randint(1, 9), module_lines=modules[m][0], module_rank=modules[m][1]) for n, m in enumerate(rng.choices(list(modules), k=40))]
        total = sum(i["tokens"] for i in items)
        budget = [0, 3, total, total - 1, -1][project] if project < 5 else rng.randrange(total)
        rows += items
        budgets.append((project, budget))
        want[project] = _trimmed_by_hand(items, budget)
    df = spark.createDataFrame(rows, "project int, kind string, module string, name string, rank double, tokens int, module_lines int, module_rank double")
    out = packing.trim_in_stages(df, spark.createDataFrame(budgets, "project int, max_tokens int"), ["project"]).collect()
    assert len(out) == len(rows) and {r.stage for r in out} == {1, 2, 3, 4, 5, 6}
    got = {p: {(r.module, r.name) for r in out if r.project == p and r.kept} for p, _ in budgets}
    assert got == want


def test_attempts_halve_on_overflow_and_stop(spark):
    """An item is too large until it has three files; one fails for good, one needs a second try, one is never answered."""
    sizes = {"big": 13, "one": 1, "fatal": 4, "slow": 5, "never": 2}
    work = spark.createDataFrame([(i, p, f"{i}{p}") for i, n in sizes.items() for p in range(n)], "item string, pos int, file string")
    asked = []

    def attempt(items, k):
        asked.append(sorted((r.item, r.n_files) for r in items.collect()))
        i, n = F.col("item"), F.col("n_files")
        error = (F.when(i == "fatal", "credit balance is too low").when((i == "big") & (n > 3), "Maximum context length exceeded")
                 .when((i == "slow") & F.lit(k == 1) | (i == "never"), "timeout"))
        kind = F.when(i == "fatal", K.FATAL_TYPES[0]).when(error.isNotNull(), "TimeoutError")
        return items.select("*", error.alias("error"), kind.alias("error_type"), F.lit(1).alias("n_findings"), F.lit(False).alias("parse_failed"))

    rows = retries.attempt_rounds(work, attempt, 4).collect()
    by = {(r.item, r.attempt): r for r in rows}
    assert {k: (r.n_files, r.outcome) for k, r in by.items()} == {
        ("big", 1): (13, "overflow"), ("big", 2): (6, "overflow"), ("big", 3): (3, "completed"), ("one", 1): (1, "completed"), ("fatal", 1): (4, "fatal"),
        ("slow", 1): (5, "retry"), ("slow", 2): (5, "completed"), ("never", 1): (2, "retry"), ("never", 2): (2, "retry"), ("never", 3): (2, "retry"), ("never", 4): (2, "retry")}
    assert sorted(r.file for r in rows if (r.item, r.attempt) == ("big", 3)) == ["big0", "big1", "big2"]
    assert asked[1:] == [[("big", 6), ("never", 2), ("slow", 5)], [("big", 3), ("never", 2)], [("never", 2)]]
    lost = retries.omitted_files(spark.createDataFrame(rows), 4).collect()
    assert {(r.item, r.attempt, r.kind, r.n) for r in lost} == {("big", 1, "files_omitted", 7), ("big", 2, "files_omitted", 3), ("fatal", 1, "check_failed", 4), ("never", 4, "check_failed", 2)}
    assert retries.attempt_rounds(work.limit(0), attempt, 2).collect() == []


def test_histogram_of_one_hot_group_of_doubles(spark):
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("hot", 0.5)] * 400 + [("few", float(rng.randrange(3))) for _ in range(50)] + [(None, 1.5), (None, 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g in ("hot", "few", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, v): (values.count(v), values.index(v), len(values)) for v in set(values)}
    got = {(r.g, r.v): (r.n, r.n_before, r.n_all) for r in prefix.histogram(df, ["g"], "v").collect()}
    assert got == want
    hot = sorted(v for k, v in rows if k == "hot")
    assert {r.g: r.p for r in prefix.index_percentile(df, ["g"], "v", 0.9, "p").collect()}["hot"] == hot[int(len(hot) * 0.9)]
    every = sorted(v for _, v in rows if v is not None)
    assert prefix.index_percentile(df, [], "v", 0.9, "p").collect()[0].p == every[int(len(every) * 0.9)]
