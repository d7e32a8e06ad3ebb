"""Queries over files, texts and answers."""

from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions import paths as P
from glintmark.functions import responses as R
from glintmark.functions import text as X
from glintmark.operators import analyzers, matching, reports, rules
from glintmark.plans.catalog.registry import ORDER, query
from glintmark.plans.views import sql_with, table, view
from glintmark.sources import dimensions
from glintmark.sources import files as S

_T = sql_with("tree")
_L = "lower(split_part(path, '/', -1))"


def _tree(spark, sf):
    return view(spark, sf, "tree")


@query(f"""{_T} SELECT doc_id, sha256('CWE-' || (doc_id % 30) || '||' || path || '|' || regexp_replace(regexp_replace(regexp_replace(text, '#[^\\n]*', '', 'g'), '//[^\\n]*', '', 'g'), '\\s+', '', 'g'))[:16] AS fingerprint FROM tree""")
def fingerprints(spark, sf):
    cwe = F.concat(F.lit("CWE-"), (F.col("doc_id") % 30).cast("string"))
    return _tree(spark, sf).select("doc_id", X.fingerprint(cwe, F.lit(""), F.col("path"), F.col("text")).alias("fingerprint"))


_REDACT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(api[_-]?key|token|password|secret|credential|auth)(["\\s:=])(?:["\\s:=]*)["'']?([a-zA-Z0-9_\\-./+=]{8,})["'']?', '\\1\\2***REDACTED***', 'gi'),
 'AKIA[0-9A-Z]{16}', '***REDACTED***', 'g'), 'gh[pousr]_[A-Za-z0-9_]{36,}', '***REDACTED***', 'g'),
 '(key|secret|password)(?:(\\s)\\s*[=:]|([=:]))\\s*["'']?([A-Za-z0-9+/]{32,}={0,2})["'']?', '\\1\\2\\3***REDACTED***', 'gi')"""


@query(f"""{_T} SELECT doc_id, {_REDACT} AS text FROM tree""")
def redact_text(spark, sf):
    return _tree(spark, sf).select("doc_id", X.redact(F.col("text")).alias("text"))


_EDGE = "(^|[^\\p{L}\\p{N}_])"
_LINES = "ln AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM tree)"
_RULE_SQL = [
    ("001.2", "error", "Direct logging import", "path LIKE 'src/%' AND path NOT LIKE '%logging.py' AND regexp_matches(line, '^import logging\\s*$')"),
    ("001.4", "error", "Subprocess outside the runner", "path LIKE 'src/%' AND NOT contains(path, '/cli/') AND path NOT LIKE '%tools/runner.py' AND trim(line) NOT LIKE '#%' AND regexp_matches(line, 'create_subprocess_(exec|shell)|subprocess\\.(run|call|Popen|check_output)')"),
    ("003.7", "error", "Hardcoded model", "path LIKE 'src/%' AND trim(line) NOT LIKE '#%' AND NOT contains(line, 'help=') AND NOT contains(line, 'examples.add(') AND regexp_matches(line, 'gpt-[0-9]|claude-|o[0-9]-mini')"),
    ("004.4", "error", "Separator of the system in a path", "path LIKE 'src/%' AND NOT contains(line, 'replace(') AND regexp_matches(line, 'os\\.(path\\.)?sep')"),
    ("001.1", "error", "Relative import", "path LIKE 'src/%' AND regexp_matches(line, '^\\s*from\\s+\\.')"),
    ("001.5", "error", "Shell call", "path LIKE 'src/%' AND regexp_matches(line, 'shell\\s*=\\s*True') AND trim(line) NOT LIKE '#%'"),
    ("002.2", "warning", "Bare except", "regexp_matches(line, '^\\s*except\\s*:')"),
    ("002.3", "warning", "Stale-work marker", f"path LIKE 'src/%' AND regexp_matches(line, '{_EDGE}(TODO|FIXME|HACK)([^\\p{{L}}\\p{{N}}_]|$)')"),
    ("002.4", "error", "Hardcoded address", "path LIKE 'src/%' AND trim(line) NOT LIKE '#%' AND regexp_matches(line, '(localhost|127\\.0\\.0\\.1|:5432|:6379|:8080)')"),
    ("002.5", "error", "Untyped kwargs", "path LIKE 'src/%' AND NOT contains(path, 'test_') AND regexp_matches(line, 'def [a-z]\\w+\\(.*\\*\\*kwargs')"),
    ("002.6", "warning", "Blocking call", "path LIKE 'src/%' AND trim(line) NOT LIKE '#%' AND regexp_matches(line, 'time\\.sleep|requests\\.(get|post)|urllib\\.request')"),
    ("003.1", "error", "Hardcoded secret", "NOT contains(path, 'tests/') AND regexp_matches(line, '(?i)(api_key|password|token|secret)\\s*=\\s*[\"''][^\"'']{10,}[\"'']') AND NOT regexp_matches(line, 'os\\.getenv|\\.env|Field\\(|test_|conftest')"),
    ("003.5", "error", "Fallback value", "path LIKE 'src/%' AND NOT contains(path, 'test_') AND regexp_matches(line, 'os\\.(getenv|environ\\.get)\\s*\\(.+,\\s*[\"'']')"),
    ("003.6", "error", "Fixed price", "path LIKE 'src/%' AND trim(line) NOT LIKE '#%' AND regexp_matches(line, '(per_token|cost_per|price_per)\\s*[:=]\\s*[0-9]|\\$[0-9]+\\.[0-9]+')"),
]


@query(f"""{_T}, {_LINES} """ + " UNION ALL ".join(
    f"SELECT path, CAST(no AS INT) AS line, '{c}' AS rule, '{s}' AS severity, '{m}' AS message FROM ln WHERE {w}" for c, s, m, w in _RULE_SQL))
def line_rules(spark, sf):
    return rules.line_rules(_tree(spark, sf))


@query(f"""{_T}, n AS (SELECT path, CAST(len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INT) AS n_lines FROM tree WHERE path LIKE 'src/%')
SELECT path, 1 AS line, '002.1' AS rule, 'error' AS severity, n_lines FROM n WHERE n_lines > 20""")
def large_texts(spark, sf):
    return rules.large_files(_tree(spark, sf), ("002.1", "error", "src/", 20))


@query(f"""{_T}, c AS (SELECT path, unnest(regexp_extract_all(text, 'CWE-(\\d+)', 1)) AS code FROM tree)
SELECT code, min(path) AS first_path FROM c WHERE code NOT IN ({", ".join(f"'{c[0]}'" for c in K.CWE_REGISTRY)}) GROUP BY code""")
def unknown_codes(spark, sf):
    return rules.unknown_codes(_tree(spark, sf), dimensions.cwe_registry(spark))


@query("""WITH p AS (SELECT 'rules/r' || (doc_id // 2) || CASE doc_id % 4 WHEN 0 THEN '.yaml' WHEN 1 THEN '.py' WHEN 2 THEN '.yaml' ELSE '.md' END AS path FROM documents)
SELECT path FROM p WHERE path LIKE '%.yaml' AND replace(path, '.yaml', '.py') NOT IN (SELECT path FROM p)""")
def untested_rules(spark, sf):
    m = F.col("doc_id") % 4
    end = F.when(m == 0, ".yaml").when(m == 1, ".py").when(m == 2, ".yaml").otherwise(".md")
    p = table(spark, sf, "documents").select(
        F.concat(F.lit("rules/r"), F.floor(F.col("doc_id") / 2).cast("string"), end).alias("path"))
    return rules.rules_without_tests(p)


_LANG_SQL = f"""CASE WHEN {_L} LIKE 'dockerfile%' THEN 'config' WHEN regexp_matches({_L}, '\\.(py)$') THEN 'python' WHEN regexp_matches({_L}, '\\.(cs|razor|csproj|sln)$') THEN 'csharp'
 WHEN regexp_matches({_L}, '.\\.(json|yaml|yml|toml|xml|props|editorconfig|dockerfile|env|bicep|bicepparam|tf|tfvars)$') THEN 'config' ELSE 'other' END"""
# Stated here once more, so that the twin does not share the list it checks.
_POINTS = [
    ("(?i)controller", 3), ("def (post|put|patch|delete)\\b", 2), ("app\\.Map(Get|Post|Put|Delete|Patch)", 3), ("@app\\.route", 2),
    ("@router\\.(get|post|put|delete|patch)", 2), ("Process\\.Start", 3), ("eval\\(", 3), ("pickle\\.(load|dump)", 3), ("BinaryFormatter", 4),
    ("NetDataContractSerializer", 4), ("subprocess\\.(call|run|Popen)", 2), ("os\\.(system|popen)", 2), ("Sql(Command|Connection)", 2), ("cursor\\.execute", 2),
    ("\\[Authorize\\]", 2), ("@login_required", 2), ("Depends\\(", 2), ("(?i)(password|secret|api_key|token)\\s*=", 2), ("(?i)middleware", 2), ("(?i)auth", 1),
    ("(?i)crypto", 2), ("(?i)secretstr|pydantic_settings|basesettings", 3), ("(?i)getenv|environ|\\.env", 2), ("(?i)connection_string|database_url|redis_url", 2),
    ("(?i)session_|cookie_|csrf_|cors_", 2), ("(?i)upload|multipart|form_data", 2), ("(?i)open\\(|shutil\\.(copy|move)|write_text", 1),
]
_NAME_POINTS = [
    (["controller"], 3), (["auth", "login", "oauth"], 2), (["middleware"], 2), (["startup", "program"], 1), (["config", "settings"], 2), (["secret", "credential", "key"], 3),
    ([".env"], 3), (["route", "endpoint", "view"], 2), (["upload", "file_handler"], 2), (["docker"], 1),
]
_WEIGHT_SQL = "1 " + " ".join(
    "+ CASE WHEN " + " OR ".join(f"contains({_L}, '{w}')" for w in ws) + f" THEN {b} ELSE 0 END" for ws, b in _NAME_POINTS
) + " " + " ".join(f"+ CASE WHEN regexp_matches(text[:4096], '{p}') THEN {b} ELSE 0 END" for p, b in _POINTS)


@query(f"""{_T} SELECT path, {_LANG_SQL} AS language, CAST(CASE WHEN {_LANG_SQL} = 'other' THEN 0 ELSE least(10, {_WEIGHT_SQL}) END AS INT) AS weight FROM tree""")
def security_weight(spark, sf):
    t = _tree(spark, sf).withColumn("language", P.language(F.col("path")))
    return P.with_security_weight(t, chars=4096).select("path", "language", "weight")


def _inventory(spark, sf):
    return S.inventory(_tree(spark, sf).withColumn("size_bytes", F.octet_length("text").cast("bigint")), ["deploy/*", "*_9?.py"])


_KEPT = f"""kept AS (SELECT *, {_LANG_SQL} AS language, CAST(strlen(text) AS BIGINT) AS size_bytes FROM tree WHERE path NOT LIKE '%node_modules/%' AND path NOT LIKE '%.min.js'
 AND path NOT LIKE 'deploy/%' AND NOT regexp_matches(path, '_9.\\.py$') AND strlen(text) <= 1048576)"""


@query(f"""{_T}, {_KEPT} SELECT language, count(*) AS n_files, CAST(sum(greatest(1, size_bytes // 4)) AS BIGINT) AS n_tokens FROM kept GROUP BY language""")
def inventory_totals(spark, sf):
    return S.manifest_totals(_inventory(spark, sf))


@query(f"""{_T}, {_KEPT} SELECT path, language, size_bytes, greatest(1, size_bytes // 4) AS tokens FROM kept""")
def inventory_files(spark, sf):
    return S.by_weight(_inventory(spark, sf)).select("path", "language", "size_bytes", "tokens")


@query(f"""{_T} SELECT path, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN path LIKE '%node_modules/%' OR path LIKE '%.min.js' OR path LIKE 'deploy/%' OR regexp_matches(path, '_9.\\.py$') THEN 'excluded'
 ELSE 'too_large' END AS reason FROM tree WHERE path LIKE '%node_modules/%' OR path LIKE '%.min.js' OR path LIKE 'deploy/%' OR regexp_matches(path, '_9.\\.py$') OR strlen(text) > 4000""")
def inventory_losses(spark, sf):
    files = _tree(spark, sf).withColumn("size_bytes", F.octet_length("text").cast("bigint"))
    out = S.inventory_losses(files, ["deploy/*", "*_9?.py"], max_bytes=4000)
    return out.withColumn("reason", F.when(F.col("reason") == "filtered", "excluded").otherwise(F.col("reason")))


@query(f"""{_T} SELECT path, 'sensitive_file_omitted' AS reason FROM tree WHERE (regexp_matches({_L}, '\\.env$') OR {_L} LIKE '.env.%') AND NOT regexp_matches({_L}, '\\.(example|sample|template|dist)$')""")
def withheld_files(spark, sf):
    return S.without_sensitive(_tree(spark, sf))[1]


@query(f"""{_T} SELECT path, path NOT LIKE 'tests/%' AND NOT regexp_matches(path, '_1.\\.py$') AND (path LIKE 'src/%' OR path LIKE '%.yml') AS kept,
 regexp_matches(path, '\\.(py|cs)$') AND path NOT LIKE 'web%' AND path NOT LIKE '%program_%' AS collected, path LIKE 'src/api/%' OR path LIKE '%/auth/%' AS in_scope FROM tree""")
def path_filters(spark, sf):
    path = F.col("path")
    return _tree(spark, sf).select(
        "path", P.passes_filters(path, ["tests/*", "*_1?.py"], ["src/*", "*.yml"]).alias("kept"),
        P.collected(path, ["web/", "program_*", "nothing"]).alias("collected"),
        P.in_scope(path, ["src/api", "*/auth/*"]).alias("in_scope"))


@query(f"""{_T} SELECT path, {" OR ".join(f"contains({_L}, '{p}')" for p in K.CONFIG_NAME_PARTS)} OR regexp_matches({_L}, '({"|".join(e.replace(".", "\\.") for e in K.CONFIG_EXTENSIONS)})$')
 OR contains(lower(path), '.github/') AS is_config, (regexp_matches({_L}, '\\.env$') OR {_L} LIKE '.env.%') AND NOT regexp_matches({_L}, '\\.(example|sample|template|dist)$') AS is_sensitive FROM tree""")
def config_files(spark, sf):
    path = F.col("path")
    return _tree(spark, sf).select("path", P.is_config_file(path).alias("is_config"), P.is_sensitive_env(path).alias("is_sensitive"))


@query(f"""{_T} SELECT path, regexp_matches(path, '(^|/)(tests|test)(/|$)') OR regexp_matches(path, '(^|/)test_') AS analysed_as_test,
 regexp_matches(path, '(^|/)(tests/|test_)') AS scored_as_test, CASE WHEN path LIKE '%/%/%' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS layer,
 regexp_replace(regexp_replace(replace(path, '/', '.'), '\\.(py|cs)$', ''), '^src\\.', '') AS module FROM tree""")
def test_files(spark, sf):
    path = F.col("path")
    return _tree(spark, sf).select(
        "path", P.is_test_path(path).alias("analysed_as_test"), P.is_scored_test_path(path).alias("scored_as_test"),
        P.layer(path).alias("layer"), P.module_name(path).alias("module"))


_TOOL_SQL = f"""tools AS (SELECT path, {_LANG_SQL} AS language, unnest(['betterleaks'] || CASE WHEN path LIKE '%.py' THEN ['bandit', 'opengrep'] WHEN path LIKE '%.cs' THEN ['opengrep'] ELSE [] END
 || CASE WHEN split_part(path, '/', -1) LIKE 'Dockerfile.%' THEN ['hadolint', 'opengrep'] ELSE [] END) AS tool FROM tree)"""


def _available(spark, sf):
    """Tools that reported in the log: names spread over the suppliers."""
    m = F.col("s_suppkey") % 4
    return table(spark, sf, "supplier").select(F.when(m == 0, "bandit").when(m == 1, "betterleaks").otherwise("trivy").alias("tool")).distinct()


def _manifest(spark, sf):
    return _tree(spark, sf).select(F.col("path").alias("file"), P.language(F.col("path")).alias("language"))


@query(f"""{_T}, {_TOOL_SQL}, n AS (SELECT {_LANG_SQL} AS language, count(*) AS n_files FROM tree GROUP BY 1), t AS (SELECT language, list_sort(list(DISTINCT tool)) AS tools FROM tools WHERE tool IN ('bandit', 'betterleaks') GROUP BY 1)
SELECT language, n_files, array_to_string(tools, ',') AS tools, CASE language WHEN 'other' THEN 'weak' ELSE 'strong' END AS level,
 array_to_string(tools, ' + ') || CASE language WHEN 'other' THEN ' only' WHEN 'config' THEN ' + LLM Config Review' ELSE ' + LLM Holistic' END AS label FROM n JOIN t USING (language)""")
def coverage_levels(spark, sf):
    out = reports.coverage(_manifest(spark, sf), _available(spark, sf))
    return out.select("language", "n_files", F.array_join("tools", ",").alias("tools"), "level", "label")


@query(f"""{_T}, {_TOOL_SQL} SELECT DISTINCT 'sast' AS pass, 'tool_missing' AS kind, tool AS subject FROM tools WHERE tool NOT IN ('bandit', 'betterleaks')""")
def missing_tools(spark, sf):
    return matching.missing_scanners(_manifest(spark, sf), _available(spark, sf))


_WORDS = sorted({w for ts in K.FILE_TYPE_WORDS.values() for w in ts})
_CHECKS = [(c[0], w) for c in K.CWE_REGISTRY if c[2] in K.MODEL_DETECTIONS for w in sorted({w for t in c[3] for w in K.FILE_TYPE_WORDS[t]})]
_KW = f"""kw(cwe_id, word) AS (VALUES {", ".join(f"('{c}', '{w}')" for c, w in _CHECKS)}),
m1 AS (SELECT DISTINCT cwe_id, file FROM tree_manifest JOIN kw ON contains(lower(file), word)),
sel AS (SELECT * FROM m1 UNION ALL SELECT k.cwe_id, t.file FROM (SELECT DISTINCT cwe_id FROM kw WHERE cwe_id NOT IN (SELECT cwe_id FROM m1)) k CROSS JOIN tree_manifest t WHERE t.weight >= 3)"""


@query(f"""{sql_with('tree_manifest')}, {_KW} SELECT cwe_id, file FROM sel""")
def keyword_files(spark, sf):
    return matching.files_by_words(view(spark, sf, "tree_manifest"))


@query(f"""{sql_with('tree_manifest')}, {_KW} SELECT cwe_id, count(*) AS n_files, (SELECT count(DISTINCT file) FROM sel) AS n_files_all FROM sel GROUP BY cwe_id""")
def work_list(spark, sf):
    return reports.work_list(matching.files_by_words(view(spark, sf, "tree_manifest")))


@query(f"""{sql_with('tree_manifest')}, {_KW} SELECT DISTINCT file FROM sel WHERE CAST(cwe_id AS INT) % 3 <> 0 AND length(file) % 5 <> 0""")
def files_reviewed(spark, sf):
    sel = matching.files_by_words(view(spark, sf, "tree_manifest"))
    included = sel.withColumn("packed", F.when(F.length("file") % 5 == 0, "omitted").otherwise("included"))
    checks = sel.select("cwe_id").distinct().withColumn(
        "outcome", F.when(F.col("cwe_id").cast("int") % 3 == 0, "retry").otherwise("completed"))
    return reports.files_reviewed(checks, included)


_ECHO = "echo AS (SELECT DISTINCT l_suppkey % 5 AS grp, CASE l_orderkey % 6 WHEN 0 THEN './a/b' || (l_partkey % 40) || '/f.py' WHEN 1 THEN 'b' || (l_partkey % 40) || '/f.py' WHEN 2 THEN 'x/y/a/b' || (l_partkey % 40) || '/f.py' WHEN 3 THEN 'q/g' || (l_partkey % 40) || '.py' WHEN 4 THEN 'unknown' ELSE 'f.py' END AS raw FROM lineitem)"
_INCL = "incl AS (SELECT DISTINCT l_suppkey % 5 AS grp, CASE l_linenumber % 3 WHEN 0 THEN 'a/b' || (l_partkey % 25) || '/f.py' WHEN 1 THEN 'z/b' || (l_partkey % 33) || '/f.py' ELSE 'k/g' || (l_partkey % 60) || '.py' END AS file FROM lineitem)"


_RESOLVED = f"""WITH {_ECHO}, {_INCL}, c AS (SELECT grp, raw, ltrim(raw, './') AS cand FROM echo),
ex AS (SELECT c.grp, c.raw, min(i.file) AS hit FROM c JOIN incl i ON i.grp = c.grp AND i.file = cand GROUP BY ALL),
su AS (SELECT c.grp, c.raw, min(i.file) AS hit, count(*) AS n FROM c JOIN incl i ON i.grp = c.grp AND (i.file LIKE '%/' || cand OR cand LIKE '%/' || i.file) GROUP BY ALL),
ba AS (SELECT c.grp, c.raw, min(i.file) AS hit, count(*) AS n FROM c JOIN incl i ON i.grp = c.grp AND split_part(i.file, '/', -1) = split_part(cand, '/', -1) GROUP BY ALL)
SELECT c.grp, c.raw, CASE WHEN c.raw = 'unknown' THEN 'unknown' WHEN ex.hit IS NOT NULL THEN ex.hit WHEN su.n = 1 THEN su.hit WHEN ba.n = 1 THEN ba.hit ELSE 'unknown' END AS file
FROM c LEFT JOIN ex USING (grp, raw) LEFT JOIN su USING (grp, raw) LEFT JOIN ba USING (grp, raw)"""


@query(_RESOLVED)
def path_resolve(spark, sf):
    li = table(spark, sf, "lineitem")
    part = lambda n: (F.col("l_partkey") % n).cast("string")
    o, n = F.col("l_orderkey") % 6, F.col("l_linenumber") % 3
    raw = (
        F.when(o == 0, F.concat(F.lit("./a/b"), part(40), F.lit("/f.py"))).when(o == 1, F.concat(F.lit("b"), part(40), F.lit("/f.py")))
        .when(o == 2, F.concat(F.lit("x/y/a/b"), part(40), F.lit("/f.py"))).when(o == 3, F.concat(F.lit("q/g"), part(40), F.lit(".py")))
        .when(o == 4, F.lit("unknown")).otherwise(F.lit("f.py"))
    )
    file = (
        F.when(n == 0, F.concat(F.lit("a/b"), part(25), F.lit("/f.py"))).when(n == 1, F.concat(F.lit("z/b"), part(33), F.lit("/f.py")))
        .otherwise(F.concat(F.lit("k/g"), part(60), F.lit(".py")))
    )
    grp = (F.col("l_suppkey") % 5).alias("grp")
    return matching.resolve_paths(li.select(grp, raw.alias("raw")).distinct(),
                                  li.select(grp, file.alias("file")).distinct(), ["grp"])


@query(f"""WITH r AS ({_RESOLVED}) SELECT grp, count(*) FILTER (file = 'unknown') AS n_unresolved FROM r GROUP BY grp""")
def unresolved_paths(spark, sf):
    """Echoed paths of each group that no file answers to."""
    return reports.unresolved_places(path_resolve(spark, sf), ["grp"])


@query(f"""{_T} SELECT path FROM tree WHERE (path LIKE 'src/%' OR regexp_matches(path, '^tests/.*_1')) AND regexp_matches(path, '\\.(py|cs)$') AND path NOT LIKE 'src/models/%' AND NOT regexp_matches(path, 'auth_[^/]*$')""")
def collected_sources(spark, sf):
    """Files that code analysis reads: two scopes, a folder and a name left out."""
    return S.collect_sources(_tree(spark, sf), ["src", "tests/*_1*"], ["src/models/", "auth_*"]).select("path")


@query("""WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' in a long name of a weakness that goes on (and on)' WHEN p_partkey % 3 = 1 THEN ' (short)' ELSE '' END AS name FROM part),
b AS (SELECT *, CASE WHEN contains(name, '(') THEN trim(split_part(name, '(', 1)) ELSE name END AS base FROM n)
SELECT p_partkey, 'CWE-' || p_partkey || ' ' || CASE WHEN length(base) > 50 THEN base[:47] || '...' ELSE base END AS short_name, 'CWE-' || p_partkey || ' ' || base AS whole_name FROM b""")
def short_names(spark, sf):
    m = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(m == 0, " in a long name of a weakness that goes on (and on)").when(m == 1, " (short)").otherwise(""))
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select("p_partkey", X.short_cwe_name(key, name).alias("short_name"), X.short_cwe_name(key, name, None).alias("whole_name"))


@query(f"""{sql_with('findings', 'manifest')} SELECT file, weight, rule_id, tool, line, level, message FROM findings JOIN manifest USING (file)""")
def file_findings(spark, sf):
    return matching.file_findings(view(spark, sf, "manifest"), view(spark, sf, "findings"))


_WIN = "f AS (SELECT ordinal, ordinal2, ordinal3, ordinal2 AS doc_id, line FROM findings)"


@query(f"""{sql_with('findings')}, {_WIN}, d AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents),
w AS (SELECT f.*, ls, greatest(0, line - 4) AS s, least(len(ls), line + 3) AS e FROM f JOIN d USING (doc_id))
SELECT ordinal, ordinal2, ordinal3, array_to_string(list_transform(range(s + 1, e + 1), lambda i: CASE WHEN i = line THEN '>>> ' ELSE '    ' END || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || ls[i]), chr(10)) AS context FROM w""")
def context_windows(spark, sf):
    f = view(spark, sf, "findings").select(
        *ORDER, F.col("ordinal2").alias("file"), "line")
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    return matching.windows_around(f, files, 3).select(*ORDER, "context")


_UP = "upper(text)"


@query(f"""{sql_with('verdict_answers')}, a AS (SELECT *, CASE WHEN contains(text, '```json') THEN trim(regexp_extract(text, '```json\\s*([\\s\\S]*?)```', 1), ' ' || chr(10)) ELSE regexp_extract(text, '(?s)\\{{.*\\}}') END AS js FROM verdict_answers),
b AS (SELECT *, CASE WHEN json_valid(js) THEN coalesce(json_extract(js, '$.findings[0]'), js::JSON) END AS j FROM a),
c AS (SELECT *, j->>'verdict' AS jv, CASE WHEN contains(j->>'confidence', '%') THEN replace(j->>'confidence', '%', '')::DOUBLE / 100 ELSE (j->>'confidence')::DOUBLE END AS jc, trim(j->>'rationale') AS jr FROM b),
d AS (SELECT *, coalesce(jv IN ('CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_CONTEXT') AND jc BETWEEN 0 AND 1 AND jr <> '', false) AS ok,
 CASE WHEN contains({_UP}, 'CONFIRMED') THEN 'CONFIRMED' WHEN regexp_matches({_UP}, 'FALSE[_ ]POSITIVE') THEN 'FALSE_POSITIVE' WHEN regexp_matches({_UP}, 'NEEDS[_ ]CONTEXT') THEN 'NEEDS_CONTEXT' END AS word,
 CASE WHEN regexp_matches(text, '[Cc]onfidence[*:\\s]*[0-9.]+') THEN regexp_extract(text, '[Cc]onfidence[*:\\s]*([0-9.]+)', 1)::DOUBLE END AS stated,
 CASE WHEN regexp_matches(text, '[Rr]ationale') THEN trim(regexp_extract(text, '(?s)[Rr]ationale[:\\s*]*\\n?(.*)', 1), ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END AS reason FROM c)
SELECT conv_id, turn, CASE WHEN ok THEN jv ELSE word END AS verdict, round(CASE WHEN ok THEN jc WHEN word IS NOT NULL THEN coalesce(CASE WHEN stated > 1 THEN stated / 100 ELSE stated END, 0.5) END, 6) AS confidence,
 CASE WHEN ok THEN jr WHEN word IS NOT NULL THEN trim(reason[:500], ' ' || chr(10)) END AS rationale, CASE WHEN ok THEN jr WHEN word IS NOT NULL THEN reason END AS whole_rationale, CASE WHEN ok THEN 'json' WHEN word IS NOT NULL THEN 'text' END AS parsed_as FROM d""")
def verdict_parse(spark, sf):
    out = R.parse_verdicts(view(spark, sf, "verdict_answers"))
    return out.select("conv_id", "turn", "verdict", F.round("confidence", 6).alias("confidence"), "rationale", "whole_rationale", "parsed_as")


_ANS = """k AS (SELECT *, (conv_id * 5 + turn) % 6 AS k FROM finding_answers)"""
# The section of each finding, from the last sign of its heading to the next one.
_SECTIONS = """s AS (SELECT *, trim(CASE k WHEN 0 THEN CASE n WHEN 0 THEN split_part(text[8:], '### SR-CRED', 1) ELSE '### SR-CRED' || split_part(text, '### SR-CRED', 2) END ELSE text END, ' ' || chr(10)) AS section, regexp_replace(section, '^##', '') AS whole FROM k JOIN f USING (conv_id, turn))"""


@query(f"""{sql_with('finding_answers')}, {_ANS}, f AS (
 SELECT conv_id, turn, 0 AS n, 'SR-AUTH-' || format('{{:03d}}', turn) AS rule_id, 'Missing check' AS title, 'HIGH' AS severity, 'src/a' || (conv_id % 7) || '.py' AS file, 'CWE-862' AS cwe FROM k WHERE k = 0
 UNION ALL SELECT conv_id, turn, 1, 'SR-CRED-002', 'Clear text', 'LOW', 'src/b/c.cs', 'CWE-312' FROM k WHERE k = 0
 UNION ALL SELECT conv_id, turn, 0, 'SR-XSS-' || format('{{:03d}}', conv_id % 30), 'SR-XSS-' || (conv_id % 30), 'CRITICAL', 'unknown', NULL FROM k WHERE k = 3
 UNION ALL SELECT conv_id, turn, 0, 'SR-SQL-007', 'File | app/db/q.py', 'MEDIUM', 'app/db/q.py', NULL FROM k WHERE k = 4),
{_SECTIONS}
SELECT conv_id, turn, CAST(n AS INT) AS pos, rule_id, title, severity, file, cwe, whole AS whole_description, CASE k WHEN 3 THEN 'x = 1' ELSE whole END AS whole_evidence FROM s""")
def finding_text_parse(spark, sf):
    rows = R.finding_rows(R.parse_responses(view(spark, sf, "finding_answers")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "pos", "rule_id", "title", "severity", "file", "cwe", "whole_description", "whole_evidence")


@query(f"""{sql_with('finding_answers')}, {_ANS} SELECT conv_id, turn, CASE k WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END::INT AS n_findings, CASE WHEN k = 5 THEN NULL ELSE 'text' END AS parsed_as, k IN (2, 5) AS parse_failed FROM k""")
def answer_state(spark, sf):
    out = R.parse_responses(view(spark, sf, "finding_answers"))
    return out.select("conv_id", "turn", F.size("findings").alias("n_findings"), "parsed_as", "parse_failed")


@query("""WITH e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Maximum context exceeded' WHEN 1 THEN 'model NOT available' WHEN 2 THEN 'timeout' WHEN 3 THEN 'x' END AS error,
 CASE WHEN event_id % 8 = 3 THEN 'AuthenticationError' WHEN event_id % 8 < 3 THEN 'RuntimeError' END AS kind, CASE WHEN event_id % 8 IN (4, 5, 6) THEN event_id % 3 END AS n, event_id % 2 = 0 AS failed, event_id % 9 AS files FROM events),
o AS (SELECT *, CASE WHEN error IS NOT NULL AND (kind = 'AuthenticationError' OR lower(error) LIKE '%not available%') THEN 'fatal' WHEN lower(error) LIKE '%maximum context%' THEN 'overflow'
 WHEN error IS NOT NULL OR n IS NULL THEN 'retry' WHEN n > 0 THEN 'completed' WHEN failed THEN 'retry' ELSE 'completed' END AS outcome FROM e)
SELECT event_id, outcome, CASE outcome WHEN 'retry' THEN files WHEN 'overflow' THEN least(greatest(1, files // 2), files) END AS retry_files FROM o""")
def outcome_class(spark, sf):
    m = F.col("event_id") % 8
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(m == 0, "Maximum context exceeded").when(m == 1, "model NOT available").when(m == 2, "timeout").when(m == 3, "x").alias("error"),
        F.when(m == 3, "AuthenticationError").when(m < 3, "RuntimeError").alias("kind"),
        F.when(m.isin(4, 5, 6), F.col("event_id") % 3).alias("n"), (F.col("event_id") % 2 == 0).alias("failed"), (F.col("event_id") % 9).alias("files"))
    out = e.withColumn("outcome", R.outcome(F.col("error"), F.col("kind"), F.col("n"), F.col("failed")))
    return out.select("event_id", "outcome", R.retry_file_count(F.col("outcome"), F.col("files")).alias("retry_files"))


@query("""SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_type || ':' || length(props) END AS score, CASE WHEN event_id % 17 = 0 THEN 'no answer' END AS error, CASE WHEN event_id % 17 = 0 THEN 'ValueError' END AS error_type FROM events""")
def bulk_score(spark, sf):
    def scorer(row):
        if row["event_id"] % 17 == 0:
            raise ValueError("no answer")
        return f"{row['event_type']}:{len(row['props'])}"

    items = table(spark, sf, "events").select("event_id", "event_type", "props")
    return analyzers.bulk_score(items, scorer, "score").select("event_id", "score", "error", "error_type")


_SRC_SQL = """src AS (SELECT *, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM python_sources WHERE doc_id % 50 <> 49)"""


@query(f"""{sql_with('python_sources')}, {_SRC_SQL} SELECT path, CAST(lines AS INT) AS lines, 2 AS functions, 1 AS classes, 3 AS total_callables, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS documented_callables,
 4 AS total_params, 2 AS annotated_params, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS annotated_returns, 1 AS exception_handlers, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS bare_excepts,
 CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS broad_excepts, 2 AS max_nesting, 1 AS naming_violations, 2 AS n_unsafe, 3 AS n_symbols FROM src""")
def source_metrics(spark, sf):
    m = analyzers.file_metrics(view(spark, sf, "python_sources"))
    return m.select("path", "lines", "functions", "classes", "total_callables", "documented_callables", "total_params", "annotated_params",
                    "annotated_returns", "exception_handlers", "bare_excepts", "broad_excepts", "max_nesting", "naming_violations",
                    F.size("unsafe_calls").alias("n_unsafe"), F.size("symbols").alias("n_symbols"))
