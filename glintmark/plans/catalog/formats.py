"""Queries that write scanner formats and exports out of the tables and read them back."""

from pyspark.sql import functions as F

from glintmark.operators import reports, scoring
from glintmark.plans.catalog.findings import _FLAT, _SHOWN, _scored
from glintmark.plans.catalog.registry import ORD, ORDER, RANK_SQL, query, scored_sql
from glintmark.plans.catalog.runs import _CALLS, _PRICED, _priced
from glintmark.plans.review import review
from glintmark.plans.views import sql_with, table, view
from glintmark.session import settle, shared_path
from glintmark.sources import dimensions, documents, scanners, truth

_F = sql_with("findings")


def _results(spark, sf):
    f = _scored(spark, sf).withColumn("run_id", F.concat(F.lit("run"), F.col("run_no").cast("string")))
    return f.withColumns({
        "tags": F.when(F.col("cwe").isNotNull(), F.array(F.lit("security"))), "end_line": F.col("line") + 2, "snippet": F.when(F.col("line") % 5 > 0, F.concat(F.lit("text of "), "rule_id")),
        "issue_severity": F.when(F.col("line") % 2 == 0, F.lit("HIGH")),
        "file": F.when(F.col("ordinal2") % 9 == 0, F.lit(None)).otherwise(F.col("file"))})


def _rules(results):
    return results.select("run_id", "rule_id").distinct().withColumns({
        "title": F.concat(F.lit("Rule "), "rule_id"), "default_level": F.when(F.col("rule_id").endswith("1"), F.lit("note")),
        "tags": F.array(F.lit("security"), F.concat(F.lit("CWE-"), F.regexp_extract("rule_id", r"\d+", 0)))})


def _written(spark, sf, max_results=500):
    """Documents written to the shared folder and read back as parsed lines."""
    results = _results(spark, sf)
    path = shared_path(spark, "documents")
    documents.write_documents(documents.documents(results, _rules(results), ORDER, max_results=max_results), path)
    return documents.parse_documents(documents.read_document_lines(spark, path))


@query(f"""{sql_with('findings', 'manifest')}, {scored_sql('findings')} SELECT {ORD}, priority, band, CASE WHEN cwe IS NOT NULL THEN 'security' END AS tags, CASE WHEN ordinal2 % 9 <> 0 THEN line + 2 END AS end_line,
 CASE WHEN ordinal2 % 9 <> 0 AND line % 5 > 0 THEN 'text of ' || rule_id END AS snippet, rule_id, level, message, CASE WHEN ordinal2 % 9 = 0 THEN '' ELSE file END AS file, CASE WHEN ordinal2 % 9 = 0 THEN 0 ELSE line END AS line,
 regexp_replace(cwe, 'CWE-', '') AS cwe, verdict, tool AS stamped_tool, CASE WHEN line % 2 = 0 THEN 'HIGH' END AS issue_severity, ordinal2 % 9 = 0 AS location_unresolved FROM scored""")
def sarif_roundtrip(spark, sf):
    rows = documents.flatten_results(documents.good_documents(_written(spark, sf)))
    part = F.col("ordinal_parts")
    return rows.select(
        part[0].cast("bigint").alias("ordinal"), part[1].cast("bigint").alias("ordinal2"), part[2].cast("double").alias("ordinal3"),
        F.col("stamped_priority").alias("priority"), F.col("stamped_band").alias("band"), F.array_join("tags", ",").alias("tags"), "end_line", "snippet", "rule_id", "level", "message", "file", "line", "cwe", "verdict", "stamped_tool", "issue_severity", "location_unresolved")


@query(f"""{_F} SELECT DISTINCT rule_id, 'Rule ' || rule_id AS title, CASE WHEN rule_id LIKE '%1' THEN 'note' END AS default_level, 'security,external/cwe/cwe-' || format('{{:03d}}', CAST(rule_id[2:] AS INT)) AS tags FROM findings""")
def rules_roundtrip(spark, sf):
    rows = documents.flatten_rules(documents.good_documents(_written(spark, sf)))
    return rows.select("rule_id", "title", "default_level", F.array_join("tags", ",").alias("tags")).distinct()


@query("""SELECT 'd' || doc_id AS doc, CASE doc_id % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'version 2.0.0' WHEN 3 THEN 'version missing' ELSE 'runs is not an array' END AS reason FROM documents WHERE doc_id % 5 <> 0""")
def quarantine(spark, sf):
    m = F.col("doc_id") % 5
    value = (
        F.when(m == 0, '{"version": "2.1.0", "runs": []}').when(m == 1, F.concat(F.lit("{"), "source"))
        .when(m == 2, '{"version": "2.0.0", "runs": []}').when(m == 3, '{"runs": []}').otherwise('{"version": "2.1.0"}')
    )
    texts = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), value.alias("value"))
    return documents.quarantined_documents(documents.parse_documents(texts))


@query(f"""{_F} SELECT 'o' || (ordinal // 8000000) AS doc, rule_id, level, message, file, line, 'Roslyn' AS tool, regexp_replace(cwe, 'CWE-', '') AS cwe FROM findings""")
def legacy_convert(spark, sf):
    f = view(spark, sf, "findings")
    tag = F.concat(F.lit("external/cwe/cwe-0"), F.regexp_extract("cwe", r"\d+", 0))
    row = F.struct(
        F.col("rule_id").alias("ruleId"), F.when(F.col("level") != "warning", F.col("level")).alias("level"), "message",
        F.array(F.struct(F.struct(F.col("file").alias("uri"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("resultFile"))).alias("locations"),
        F.struct(F.when(F.col("cwe").isNotNull(), F.array(tag)).alias("tags")).alias("properties"))
    docs = f.groupBy(F.floor(F.col("ordinal") / 8000000).alias("_o")).agg(F.collect_list(row).alias("results"))
    run = F.struct(F.struct(F.lit("Roslyn").alias("name")).alias("tool"), "results")
    texts = docs.select(F.concat(F.lit("o"), F.col("_o").cast("string")).alias("doc"), F.to_json(F.struct(F.array(run, run).alias("runs"))).alias("value"))
    return documents.legacy_results(texts).select("doc", "rule_id", "level", "message", "file", "line", "tool", "cwe")


@query("""SELECT l_orderkey || '.json' AS file, 'SCA-PYSEC-' || l_partkey AS rule_id, 'warning' AS level, 'pkg' || l_suppkey || '==1.' || l_linenumber || ' has known vulnerability PYSEC-' || l_partkey || '.' ||
 CASE WHEN l_partkey % 2 = 0 THEN ' Fix: upgrade to 2.' || l_linenumber || ', 3.0' ELSE '' END AS message, 'Vulnerable dependency: pkg' || l_suppkey AS rule_title FROM lineitem WHERE l_partkey % 3 <> 0""")
def dependency_audit(spark, sf):
    li = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    vuln = F.struct(
        F.concat(F.lit("PYSEC-"), text("l_partkey")).alias("id"),
        F.when(F.col("l_partkey") % 2 == 0, F.array(F.concat(F.lit("2."), text("l_linenumber")), F.lit("3.0"))).alias("fix_versions"))
    dep = F.struct(F.concat(F.lit("pkg"), text("l_suppkey")).alias("name"), F.concat(F.lit("1."), text("l_linenumber")).alias("version"),
                   F.when(F.col("l_partkey") % 3 != 0, F.array(vuln)).alias("vulns"))
    docs = li.groupBy("l_orderkey").agg(F.collect_list(dep).alias("dependencies")).select(
        F.concat(F.lit("/audit/"), F.col("l_orderkey").cast("string"), F.lit(".json")).alias("doc"), F.to_json(F.struct("dependencies")).alias("value"))
    return scanners.dependency_audit(docs).select("file", "rule_id", "level", "message", "rule_title")


@query("""SELECT 'p' || l_orderkey || '.csproj' AS file, 'SCA-NUGET-Lib' || l_partkey AS rule_id, CASE l_linenumber % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'note' ELSE 'warning' END AS level,
 'Lib' || l_partkey || '@unknown has a ' || CASE l_linenumber % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'low' ELSE 'Odd' END || ' vulnerability. See http' || l_suppkey AS message FROM lineitem""")
def package_advisories(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 5
    sev = F.when(n == 0, "Critical").when(n == 1, "HIGH").when(n == 2, "Moderate").when(n == 3, "low").otherwise("Odd")
    pkg = F.struct(F.concat(F.lit("Lib"), F.col("l_partkey").cast("string")).alias("id"),
                   F.array(F.struct(sev.alias("severity"), F.concat(F.lit("http"), F.col("l_suppkey").cast("string")).alias("advisoryurl"))).alias("vulnerabilities"))
    top = F.col("l_linenumber") <= 2
    docs = li.groupBy("l_orderkey").agg(F.collect_list(F.when(top, pkg)).alias("topLevelPackages"), F.collect_list(F.when(~top, pkg)).alias("_t"))
    frame = F.struct(F.lit("net8.0").alias("framework"), "topLevelPackages", F.when(F.size("_t") > 0, F.col("_t")).alias("transitivePackages"))
    proj = F.array(F.struct(F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit(".csproj")).alias("path"), F.array(frame).alias("frameworks")))
    texts = docs.select(F.col("l_orderkey").cast("string").alias("doc"), F.to_json(F.struct(proj.alias("projects"))).alias("value"))
    return scanners.package_advisories(texts).select("file", "rule_id", "level", "message")


@query(f"""{sql_with('call_edges')} SELECT caller, callee, 'f.cs' AS file, CAST(length(caller) AS INT) AS line, CASE WHEN confidence > 0.8 THEN 0.9::DOUBLE ELSE 0.7 END AS confidence, CASE WHEN confidence > 0.8 THEN 'direct' WHEN confidence > 0.5 THEN 'virtual' ELSE 'extension' END AS kind FROM call_edges""")
def edge_json(spark, sf):
    c = F.col("confidence")
    records = view(spark, sf, "call_edges").select(
        "caller", "callee", F.lit("f.cs").alias("file"), F.length("caller").alias("line"), (c < 0.8).alias("isVirtual"), (c < 0.5).alias("isExtension"))
    path = shared_path(spark, "edges")
    records.write.json(path)
    return scanners.read_call_edges(spark, path, array_files=False)


@query(f"""{_F}, u AS (SELECT DISTINCT run_no, regexp_replace(cwe, 'CWE-', '') AS cwe_id FROM findings WHERE cwe IS NOT NULL UNION SELECT DISTINCT run_no, CAST(CAST(rule_id[2:] AS INT) AS VARCHAR) FROM findings)
SELECT 'run' || run_no AS run_id, cwe_id, name FROM u JOIN (VALUES {", ".join("('%s', '%s')" % (i, n.replace("'", "''")) for i, n, *_ in dimensions.K.CWE_REGISTRY)}) r(id, name) ON r.id = cwe_id""")
def taxonomy_used(spark, sf):
    from glintmark.functions.tags import normal_tags

    results = _results(spark, sf)
    return documents.used_cwes(results, _rules(results).withColumn("tags", normal_tags(F.col("tags"))))


_HAD = """h AS (SELECT *, CASE WHEN tool = 'tool_a' THEN 'Hadolint' ELSE tool END AS t, CASE rule_id WHEN 'R1' THEN 'DL3002' WHEN 'R2' THEN 'DL3006' WHEN 'R3' THEN 'DL3007' ELSE rule_id END AS r FROM findings)"""


def _mapped(spark, sf):
    f = view(spark, sf, "findings")
    rule = F.when(F.col("rule_id") == "R1", "DL3002").when(F.col("rule_id") == "R2", "DL3006").when(F.col("rule_id") == "R3", "DL3007").otherwise(F.col("rule_id"))
    results = f.withColumns({"tool": F.when(F.col("tool") == "tool_a", "Hadolint").otherwise(F.col("tool")), "rule_id": rule,
                             "tags": F.lit(None).cast("array<string>")})
    rules = results.filter("rule_id IN ('DL3002', 'R5')").select("run_no", "tool", "rule_id").distinct().withColumn("tags", F.array(F.lit("docker")))
    return scoring.map_rules(results, rules, dimensions.rule_cwe_map(spark), dimensions.cwe_registry(spark), ["run_no"])


@query(f"""{_F}, {_HAD} SELECT {ORD}, CASE WHEN t = 'Hadolint' THEN CASE r WHEN 'DL3002' THEN 'external/cwe/cwe-250' WHEN 'DL3006' THEN 'external/cwe/cwe-829' WHEN 'DL3007' THEN 'external/cwe/cwe-829' END END AS tags FROM h""")
def rule_map_results(spark, sf):
    return _mapped(spark, sf)[0].select(*ORDER, F.array_join("tags", ",").alias("tags"))


@query(f"""{_F}, {_HAD} SELECT DISTINCT run_no, t AS tool, r AS rule_id, CASE WHEN r = 'R5' THEN 'docker' WHEN r = 'DL3002' THEN CASE WHEN t = 'Hadolint' THEN 'docker,external/cwe/cwe-250' ELSE 'docker' END
 ELSE 'security,external/cwe/cwe-829' END AS tags FROM h WHERE r IN ('DL3002', 'R5') OR (t = 'Hadolint' AND r LIKE 'DL%')""")
def rule_map_rules(spark, sf):
    return _mapped(spark, sf)[1].select("run_no", "tool", "rule_id", F.array_join("tags", ",").alias("tags"))


@query(f"""{sql_with('findings', 'manifest')}, {scored_sql('findings')} SELECT printf('%.3f', priority) AS priority, band AS priority_band, {_SHOWN} AS severity, rule_id, file, CAST(line AS VARCHAR) AS line, {_FLAT} AS message FROM scored""")
def csv_export(spark, sf):
    path = shared_path(spark, "csv")
    reports.write_csv(_scored(spark, sf), ORDER, path)
    names = [c for c in reports.export_rows(_scored(spark, sf)).columns]
    back = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in names)).csv(path)
    return back.select("priority", "priority_band", "severity", "rule_id", "file", "line", "message")


@query(f"""{sql_with('findings', 'manifest')}, {scored_sql('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY priority DESC, {ORD}) AS position FROM scored),
c AS (SELECT run_no, cwe, count(*) AS n, min(({ORD})) AS first FROM scored WHERE cwe IS NOT NULL GROUP BY run_no, cwe),
t AS (SELECT run_no, string_agg(cwe || '=' || n, ',' ORDER BY cwe) AS cwes FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY n DESC, first) AS rn FROM c) WHERE rn <= 10 GROUP BY run_no),
h AS (SELECT run_no, count(*) AS total, count(*) FILTER (band = 'URGENT') AS urgent, count(*) FILTER (verdict = 'CONFIRMED') AS confirmed, 'target' || run_no AS target, run_no * 1.5::DOUBLE AS cost_usd FROM scored GROUP BY run_no)
SELECT run_no, CAST((position - 1) // 1000 AS INT) AS part, position, priority, band, rule_id, file, line, {_FLAT} AS message, total, urgent, confirmed, target, cost_usd, cwes FROM r JOIN h USING (run_no) LEFT JOIN t USING (run_no)""")
def json_export(spark, sf):
    """Reports of 1000 findings a part, in priority order, read back finding by finding with their head."""
    scored = _scored(spark, sf)
    run = F.col("run_no")
    about = scored.select("run_no").distinct().select(
        "run_no", F.concat(F.lit("target"), run.cast("string")).alias("target"), F.lit("full").alias("mode"), F.lit("a:b").alias("provider"),
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"), (run * 1.5).alias("cost_usd"))
    docs = reports.json_reports(scored, reports.report_counts(scored, ["run_no"]), reports.top_cwes(scored, ORDER, 10, ["run_no"]), "run_no", ORDER, 1000, about)
    kind = ("struct<metadata:struct<total_findings:bigint,target:string,cost_usd:double>,summary:struct<priority:struct<urgent:bigint>>,"
            "findings:array<struct<position:bigint,priority:double,priority_band:string,rule_id:string,file:string,line:int,message:string>>,"
            "triage:struct<confirmed:bigint>,cwes:map<string,bigint>>")
    d = docs.select("run_no", "part", F.explode(F.array(F.from_json("value", kind))).alias("d"))
    cwes = F.array_join(F.array_sort(F.transform(F.map_entries("d.cwes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    # The head of a part is read once, before its findings become rows.
    heads = d.select(
        "run_no", "part", F.col("d.findings").alias("findings"), F.col("d.metadata.total_findings").alias("total"), F.col("d.summary.priority.urgent").alias("urgent"),
        F.col("d.triage.confirmed").alias("confirmed"), "d.metadata.target", "d.metadata.cost_usd", cwes.alias("cwes"))
    rows = heads.select("*", F.posexplode("findings").alias("at", "f"))
    return rows.select(
        "run_no", "part", (F.col("part").cast("bigint") * 1000 + F.col("at") + 1).alias("position"), "f.priority", F.col("f.priority_band").alias("band"), "f.rule_id", "f.file", "f.line", "f.message",
        "total", "urgent", "confirmed", "target", "cost_usd", "cwes")


@query("""SELECT 'd' || doc_id AS doc, CASE WHEN doc_id % 6 <> 5 THEN CAST(20 + doc_id % 12 AS VARCHAR) END AS cwe, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN quality = 0 THEN 'found' ELSE 'not_found' END AS expect,
 CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 'rate limit,toxic ' || toxic END AS words, doc_id % 6 = 5 AS invalid FROM labels""")
def bench_specs(spark, sf):
    lb = table(spark, sf, "labels")
    value = F.concat(
        F.lit('cwe: "'), (20 + F.col("doc_id") % 12).cast("string"), F.lit('"\nexpect: '),
        F.when(F.col("quality") == 0, "found").otherwise("not_found"), F.lit('\nevidence_contains:\n  - "rate limit"\n  - "toxic '),
        F.col("toxic").cast("string"), F.lit('"\n'), F.when(F.col("doc_id") % 6 == 5, F.lit("surprise: 1\n")).otherwise(F.lit("")))
    rows = truth.specs(lb.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), value.alias("value")))
    return rows.select("doc", "cwe", "expect", F.when(F.col("evidence_contains").isNotNull(), F.array_join("evidence_contains", ",")).alias("words"),
                       F.col("error").isNotNull().alias("invalid"))


@query("""SELECT 'd' || doc_id AS doc, '345' AS cwe, 'f' || unnest([1, 2]) || '.cs' AS file, CAST(doc_id % 50 + 1 AS INT) AS line, 'CWE-345' AS cwe_id, CASE WHEN quality = 0 THEN 'true_positive' ELSE 'false_positive' END AS label FROM labels""")
def truth_labels(spark, sf):
    lb = table(spark, sf, "labels")
    place = lambda n: F.concat(F.lit(f'  - file: "f{n}.cs"\n    line: '), (F.col("doc_id") % 50 + 1).cast("string"), F.lit("\n    label: "),
                               F.when(F.col("quality") == 0, "true_positive").otherwise("false_positive"), F.lit("\n"))
    value = F.concat(F.lit('cwe: "345"\nlanguage: csharp\nfindings:\n'), place(1), place(2))
    rows = truth.labels(lb.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), value.alias("value")))
    return rows.select("doc", "cwe", "file", "line", "cwe_id", "label")


@query("""SELECT 'd' || doc_id AS doc, '863' AS cwe, CAST(doc_id % 4 AS INT) AS min_findings, 'src/c' || (doc_id % 9) || '.cs' AS file, quality = 1 AS golden_pass FROM labels""")
def baseline_manifest(spark, sf):
    lb = table(spark, sf, "labels")
    value = F.concat(
        F.lit('cwes:\n  "863":\n    name: "Check"\n    min_findings: '), (F.col("doc_id") % 4).cast("string"), F.lit('\n    expected:\n      - file: "src/c'),
        (F.col("doc_id") % 9).cast("string"), F.lit('.cs"\n        evidence_contains: ["x"]\n    golden:\n      "openai:gpt": { pass: '),
        F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(", findings: 3 }\n"))
    rows = truth.baselines(lb.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), value.alias("value")))
    return rows.select("doc", "cwe", "min_findings", "file", F.col("golden")["openai:gpt"]["pass"].alias("golden_pass"))


@query(f"""{sql_with('findings', 'manifest', 'model_findings')}, kept AS (SELECT * FROM findings WHERE ordinal2 % 9 <> 0 AND file IN (SELECT file FROM manifest)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(cwe, rule_id), file, line ORDER BY {RANK_SQL} DESC, {ORD}) AS rn FROM kept) WHERE rn = 1),
mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, coalesce(line, 0) ORDER BY {ORD}) AS rn FROM model_findings m
  WHERE cwe IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dd WHERE dd.file = m.file AND dd.line = m.line)) WHERE rn = 1),
merged AS (SELECT file, CASE level WHEN 'none' THEN 'note' ELSE level END AS level, verdict, rule_id FROM dd
  UNION ALL SELECT file, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END, 'NEEDS_CONTEXT', rule_id FROM mm), {scored_sql('merged')}
SELECT count(*) AS total, count(*) FILTER (band = 'URGENT') AS urgent, count(*) FILTER (band = 'ELEVATED') AS elevated, count(*) FILTER (band = 'MODERATE') AS moderate, count(*) FILTER (band = 'LOW') AS low,
 count(*) FILTER (level = 'error') AS critical, count(*) FILTER (level = 'warning') AS medium, count(*) FILTER (level = 'note') AS low_severity, count(*) FILTER (verdict = 'CONFIRMED') AS triage_confirmed,
 count(*) FILTER (verdict = 'FALSE_POSITIVE') AS triage_false_positive, count(*) FILTER (verdict = 'NEEDS_CONTEXT') AS triage_needs_context, true AS has_triage FROM scored""")
def full_review(spark, sf):
    """Documents to report counts through the whole findings plan, model findings included."""
    docs = documents.good_documents(_written(spark, sf))
    part = F.col("ordinal_parts")
    results = documents.flatten_results(docs).withColumns({
        "ordinal": part[0].cast("bigint"), "ordinal2": part[1].cast("bigint"), "ordinal3": part[2].cast("double")})
    # The order is in columns of its own now; where a result stood in its document decides nothing.
    results = results.drop("ordinal_parts", "doc", "run_pos", "result_pos", "stamped_tool", "stamped_priority", "stamped_band")
    done = review(results, documents.flatten_rules(docs), settle(view(spark, sf, "manifest"), "manifest"), view(spark, sf, "model_findings"),
                  order=ORDER, model_order=ORDER, verification=True)
    return done.counts


@query(f"""{sql_with('llm_calls', 'findings', 'manifest')}, {_PRICED}, fr AS (SELECT *, 'run' || run_no AS run_id FROM findings)
SELECT run_id, 'cost' AS fact, agent AS subject, model AS detail, count(*) AS n, sum(cost_usd)::DOUBLE AS amount FROM priced GROUP BY run_id, agent, model
UNION ALL SELECT run_id, 'loss:outside_manifest', 'scan', tool, count(*), NULL FROM fr WHERE file NOT IN (SELECT file FROM manifest) GROUP BY run_id, tool
UNION ALL SELECT 'run' || (user_id % 5), CASE WHEN user_id % 10 = 0 THEN 'fatal' ELSE 'failure' END, 'verify', CASE WHEN user_id % 2 = 0 THEN 'TimeoutError' ELSE 'ValueError' END, count(*), NULL FROM events WHERE event_type = 'error' GROUP BY ALL
UNION ALL SELECT run_id, 'selection', coalesce(cwe, 'none'), CASE WHEN weight >= 5 THEN 'keyword' ELSE 'graph' END, count(DISTINCT file), NULL FROM fr JOIN manifest USING (file) GROUP BY ALL
UNION ALL SELECT run_id, 'triage', verdict, NULL, count(*), NULL FROM fr WHERE verdict IS NOT NULL GROUP BY run_id, verdict""")
def audit_facts(spark, sf):
    """Costs, losses, failures, selection and triage of every run, written a folder per run and read back."""
    f = view(spark, sf, "findings").withColumn("run_id", F.concat(F.lit("run"), F.col("run_no").cast("string")))
    manifest = view(spark, sf, "manifest")
    lost = f.join(manifest, "file", "left_anti").select("run_id", F.lit("scan").alias("pass"), F.lit("outside_manifest").alias("kind"), F.col("tool").alias("subject"), F.lit(1).alias("count"))
    user = F.col("user_id")
    failed = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("run"), (user % 5).cast("string")).alias("run_id"), F.lit("verify").alias("pass"),
        F.when(user % 2 == 0, "TimeoutError").otherwise("ValueError").alias("error_type"), (user % 10 == 0).alias("fatal"))
    chosen = f.join(manifest, "file").select("run_id", F.coalesce("cwe", F.lit("none")).alias("check"), "file", F.when(F.col("weight") >= 5, "keyword").otherwise("graph").alias("via")).distinct()
    facts = reports.audit_facts(_priced(spark, sf), lost, failed, chosen, f.filter("verdict IS NOT NULL"))
    path = shared_path(spark, "facts")
    reports.write_facts(facts, path)
    back = spark.read.schema(facts.schema).parquet(path)
    return back.select("run_id", "fact", "subject", "detail", "n", F.col("amount").cast("double").alias("amount"))


@query(f"""{_CALLS}, {_PRICED} SELECT run_id, count(*) AS n_calls, sum(cost_usd)::DOUBLE AS cost_usd, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens FROM priced GROUP BY run_id""")
def audit_log(spark, sf):
    """Costs written as an audit fact table, one run written twice, and totalled from there."""
    path = shared_path(spark, "audit")
    costs = _priced(spark, sf).select("run_id", "seq", "agent", "model", "model_resolved", "tokens_in", "tokens_out", "cost_usd")
    reports.write_facts(costs, path)
    reports.write_facts(costs.filter("run_id = 'run1'"), path)
    return spark.read.parquet(path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))
