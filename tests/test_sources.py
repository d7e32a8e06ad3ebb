"""Documents, scanner outputs, files, truth and exports, read and written for real."""

import json

import pytest
from pyspark.sql import functions as F

from glintmark.plans import project
from glintmark.plans.review import review
from glintmark.sources import documents, files, ledger, scanners, truth


def result(rule, level=None, file=None, line=1, **more):
    out = {"ruleId": rule, "message": {"text": f"{rule} hit"}, **more}
    if level:
        out["level"] = level
    if file:
        out["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": file}, "region": {"startLine": line}}}]
    return out


def document(tool, results, rules=()):
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": list(rules)}}, "results": results}]})


def texts(spark, **named):
    return spark.createDataFrame(list(named.items()), "doc string, value string")


def test_scan_splits_good_and_bad_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.sarif").write_text(document("bandit", [result("B1", "error", "a.py", 3)]))
    (tmp_path / "deep" / "b.sarif").write_text("{not json")
    (tmp_path / "deep" / "c.sarif").write_text('{"version": "2.0.0", "runs": []}')
    parsed = documents.parse_documents(documents.read_texts(spark, str(tmp_path)))
    rows = documents.flatten_results(documents.good_documents(parsed)).collect()
    assert [(r.tool, r.rule_id, r.file, r.line) for r in rows] == [("bandit", "B1", "a.py", 3)]
    bad = {r.doc.rsplit("/", 1)[-1]: r.reason for r in documents.quarantined_documents(parsed).collect()}
    assert bad == {"b.sarif": "not JSON", "c.sarif": "version 2.0.0"}


def test_flatten_takes_the_taxon_before_the_tag(spark):
    taxa = [{"id": "79", "toolComponent": {"name": "CWE"}}]
    tags = {"tags": ["external/cwe/cwe-089"]}
    doc = document("t", [result("a", taxa=taxa, properties=tags), result("b", properties=tags), result("c"), result("d", file="f.py", line=7)])
    rows = documents.flatten_results(documents.good_documents(documents.parse_documents(texts(spark, d=doc)))).orderBy("result_pos").collect()
    assert [r.cwe for r in rows] == ["79", "89", None, None]
    assert [(r.file, r.line, r.location_unresolved) for r in rows][2:] == [("", 0, True), ("f.py", 7, False)]


def test_whole_review(spark):
    tag = {"tags": ["external/cwe/cwe-089"]}
    rules = [{"id": "B6", "defaultConfiguration": {"level": "error"}, "properties": {"tags": ["external/cwe/cwe-022"]}}]
    one = document("bandit", [result("B1", "warning", "file:///repo/src/a.py", 10, properties=tag), result("B6", None, "src/a.py", 20), result("B9", "error", "other/x.py", 1)], rules)
    two = document("opengrep", [result("O1", "error", "/repo/src/a.py", 10, properties=tag | {"triage_verdict": "CONFIRMED"})])
    good = documents.good_documents(documents.parse_documents(texts(spark, a=one, b=two)))
    manifest = spark.createDataFrame([("src/a.py", 10)], "file string, weight int")
    model = spark.createDataFrame([(1, "SR-1", "src/a.py", 10, "CWE-1", "HIGH", "t", "d"), (2, "SR-2", "src/a.py", None, "CWE-2", "LOW", "t", "d"), (3, "SR-3", "src/a.py", 5, None, "LOW", "t", "d")],
                                  "ordinal int, rule_id string, file string, line int, cwe string, severity string, title string, description string")
    out = review(documents.flatten_results(good), documents.flatten_rules(good), manifest, model, root="/repo")
    got = {r.rule_id: (r.level, r.cwe, r.priority, r.band, r.confidence_label) for r in out.findings.collect()}
    assert got == {"O1": ("error", "CWE-89", 1.0, "URGENT", "confirmed"), "B6": ("error", "CWE-22", 0.7, "URGENT", "sast_only"),
                   "SR-2": ("note", "CWE-2", 0.3, "MODERATE", "confirmed")}
    assert out.dropped_outside_manifest.first().n == 1 and out.model_without_cwe.first().n == 1
    assert out.counts.first().urgent == 2


def test_documents_split_a_run_and_keep_every_row(spark, tmp_path):
    rows = [(f"r{i % 2}", i, f"R{i % 7}", "error", f"m{i}", "a.py", i, None, "CWE-22" if i % 3 else None, None, "bandit", None, None) for i in range(500)]
    cols = "run_id string, ordinal int, rule_id string, level string, message string, file string, line int, end_line int, cwe string, tags array<string>, tool string, issue_severity string, verdict string"
    results = spark.createDataFrame(rows, cols)
    rules = spark.createDataFrame([(r, f"R{i}", "t", None, ["CWE-79"]) for r in ("r0", "r1") for i in range(9)], "run_id string, rule_id string, title string, default_level string, tags array<string>")
    path = str(tmp_path / "docs")
    documents.write_documents(documents.documents(results, rules, ["ordinal"], max_results=50), path)
    lines = documents.read_document_lines(spark, path)
    assert lines.count() > 6
    good = documents.good_documents(documents.parse_documents(lines))
    back = documents.flatten_results(good).select(F.col("ordinal_parts")[0].cast("int").alias("o"), "message", "cwe").collect()
    assert sorted((r.o, r.message, r.cwe) for r in back) == [(i, f"m{i}", "22" if i % 3 else None) for i in range(500)]
    assert {r.rule_id for r in documents.flatten_rules(good).select("rule_id").distinct().collect()} == {f"R{i}" for i in range(9)}
    taxa = json.loads(lines.filter(F.col("value").contains("R1")).first().value)["runs"][0]["taxonomies"][0]["taxa"]
    assert [t["id"] for t in taxa] == ["22", "79"]


def test_written_documents_take_less_disk_than_their_json(spark, tmp_path):
    results = spark.range(3000).selectExpr("'r0' AS run_id", "id AS ordinal", "concat('R', id % 7) AS rule_id", "'error' AS level", "concat('m', id) AS message", "'a.py' AS file", "CAST(id AS INT) AS line", "CAST(NULL AS INT) AS end_line",
                                           "'CWE-22' AS cwe", "CAST(NULL AS ARRAY<STRING>) AS tags", "'bandit' AS tool", "CAST(NULL AS STRING) AS issue_severity", "CAST(NULL AS STRING) AS verdict")
    rules = spark.createDataFrame([("r0", "R1", "t", None, ["CWE-79"]), ("r1", "R9", "t", None, None)], "run_id string, rule_id string, title string, default_level string, tags array<string>")
    docs, path = documents.documents(results, rules, ["ordinal"], max_results=500), tmp_path / "docs"
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan  # nested results are not sent a second time to meet their rules
    documents.write_documents(docs, str(path))
    lines = documents.read_document_lines(spark, str(path))
    assert sum(f.stat().st_size for f in path.rglob("part-*")) * 4 < lines.agg(F.sum(F.octet_length("value"))).first()[0]
    good = documents.good_documents(documents.parse_documents(lines))
    assert documents.flatten_results(good).count() == 3000
    assert {r.rule_id for r in documents.flatten_rules(good).select("rule_id").distinct().collect()} == {"R1", "R9"}


def test_scanner_outputs(spark):
    audit = {"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "X", "fix_versions": ["2", "3"]}]}, {"name": "b"}]}
    row = scanners.dependency_audit(texts(spark, **{"in/audit.json": json.dumps(audit)})).collect()
    assert [(r.rule_id, r.file, r.message) for r in row] == [("SCA-X", "audit.json", "a==1 has known vulnerability X. Fix: upgrade to 2, 3")]
    lint = {"results": [{"test_id": "B101", "filename": "tests/a.py"}, {"test_id": "B101", "filename": "a.py", "issue_severity": "HIGH"}], "metrics": {"a.py": {"loc": 50}, "_totals": {"loc": 150}}}
    m = scanners.linter_metrics(texts(spark, d=json.dumps(lint))).first()
    assert (m.total_findings, m.high_severity, m.total_loc, m.weighted_per_kloc) == (1, 1, 200, 15.0)
    cc = {"a.py": [{"name": "f", "complexity": 12, "rank": "C", "lineno": 3}, {"complexity": 1, "rank": "A"}], "bad.py": {"error": "x"}}
    rows = scanners.complexity_rows(texts(spark, d=json.dumps(cc)))
    assert [(r.rule_id, r.severity, r.line) for r in scanners.complexity_findings(rows).collect()] == [("CC:C", "MEDIUM", 3)]
    assert scanners.complexity_metrics(rows).first().p90_complexity == 12


def test_call_records(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"caller": "a", "callee": "b", "file": "f", "line": 1, "isVirtual": True, "isExtension": True}, {"caller": "a", "callee": "c", "file": "f", "line": 2}]))
    got = {(r.callee, r.kind, r.confidence) for r in scanners.read_call_edges(spark, str(tmp_path)).collect()}
    assert got == {("b", "extension", 0.7), ("c", "direct", 0.9)}


def test_tree_to_manifest(spark, tmp_path):
    for name, body in {"src/auth.py": "eval(x)", "obj/a.py": "x", "src/big.py": "y" * 100, "README": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    tree = files.read_tree(spark, str(tmp_path), 50).withColumn("text", files.text_content())
    got = {r.path: (r.language, r.weight, r.tokens) for r in files.inventory(tree, max_bytes=50).collect()}
    assert got == {"src/auth.py": ("python", 6, 1), "README": ("other", 0, 1)}
    assert {tuple(r) for r in files.inventory_losses(tree, max_bytes=50).collect()} == {("src/big.py", 100, "too_large"), ("obj/a.py", 1, "excluded")}
    assert {r.path: r.content for r in files.read_tree(spark, str(tmp_path), 50).collect()}["src/big.py"] is None
    assert {r.path: bytes(r.content) for r in files.read_tree(spark, str(tmp_path), None).collect()}["src/big.py"] == b"y" * 100


def test_specs(spark):
    rows = truth.specs(texts(spark, a='cwe: "693"\nexpect: found\n', b="cwe: 693\nexpect: found\n", c='cwe: "1"\nexpect: found\nextra: 1\n', d=": :"))
    assert [(r.cwe, r.evidence_contains) for r in truth.valid_specs(rows).collect()] == [("693", [])]
    assert rows.filter("error IS NOT NULL").count() == 3


def test_ledger_lines(spark):
    row = ledger.parse_events(spark.createDataFrame([('{"ts": "2024-01-01T00:00:00", "kind": "x", "n": 3}',)], "value string")).first()
    assert row.kind == "x" and row.fields == {"n": "3"} and row.ts.year == 2024


def test_project_plan(spark):
    src = {"src/a/x.py": "from a import y\n\ndef f(v: Item) -> int:\n    return v\n", "src/a/y.py": "import a.x\n\nclass Item:\n    pass\n", "tests/test_x.py": "def test_f():\n    pass\n"}
    scores, index = project.score_files(spark.createDataFrame(list(src.items()), "path string, text string"))
    got = {r.dim: r.score for r in scores.collect()}
    assert set(got) == {"maintainability", "security", "modularity", "testability", "robustness", "elegance", "reusability"}
    assert got["security"] == pytest.approx(100.0) and got["robustness"] == pytest.approx(100.0)
    refs = {(r.source, r.target) for r in project.reference_edges(__import__("glintmark.operators.analyzers", fromlist=["x"]).file_metrics(
        spark.createDataFrame(list(src.items()), "path string, text string"))).collect()}
    assert refs == {("a.x", "a"), ("a.y", "a.x"), ("a.x.f", "a.y.Item")}
    assert 0 < index.first().composite <= 100


def test_names_resolve_inside_their_project(spark):
    files = [("a", "src/m.py", "class Item:\n    pass\n"), ("a", "src/n.py", "import m\ndef f(x: Item) -> Thing:\n    return x\n"),
             ("b", "src/m.py", "class Thing:\n    pass\n"), ("b", "src/n.py", "def f(x: Item):\n    return x\n")]
    analyzers = __import__("glintmark.operators.analyzers", fromlist=["x"])
    metrics = analyzers.file_metrics(spark.createDataFrame(files, "project string, path string, text string"), ["project"])
    refs = {(r.project, r.source.rsplit(".", 1)[-1], r.target.rsplit(".", 1)[-1]) for r in project.reference_edges(metrics, ["project"]).collect()}
    assert refs == {("a", "n", "m"), ("a", "f", "Item")}
