"""Queries over the code graph."""

from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.operators import graph as G
from glintmark.operators import history, matching
from glintmark.plans.catalog.registry import query
from glintmark.plans.catalog.texts import _KW
from glintmark.plans.views import sql_with, table, view
from glintmark.session import settle
from glintmark.sources import dimensions

_E = sql_with("call_edges")
# Nodes as files, entry points and sinks: the view's nodes are n and a number; ten neighbours share a file.
_FILES = "nf AS (SELECT DISTINCT node AS qname, 'src/g' || (CAST(node[2:] AS INT) // 10) || '.py' AS file FROM (SELECT caller AS node FROM call_edges UNION SELECT callee FROM call_edges))"


def _edges(spark, sf):
    return view(spark, sf, "call_edges")


def _number(node):
    return F.substring(node, 2, 18).cast("bigint")


def _file_of(node):
    return F.concat(F.lit("src/g"), F.floor(_number(node) / 10).cast("string"), F.lit(".py"))


def _graph(spark, sf):
    """Edges and the files of their nodes, each written once and read by every step that follows."""
    e = settle(_edges(spark, sf), "edges")
    nodes = e.select(F.col("caller").alias("qname")).union(e.select("callee")).distinct()
    return e, settle(nodes.withColumn("file", _file_of("qname")), "node_files")


def _entries(files):
    return files.filter(_number("qname") % 499 == 0).select("qname")


def _entry_seeds(files):
    return _entries(files).select(F.lit("entry").alias("tag"), F.col("qname").alias("node"))


def _back_sql(hops: int, least: float) -> str:
    return f"""bw(tag, node, depth) AS (SELECT DISTINCT cwe_id, caller, 0 FROM hits WHERE cwe_id IS NOT NULL
 UNION SELECT bw.tag, e.caller, bw.depth + 1 FROM bw JOIN named e ON e.callee = bw.node AND e.confidence >= {least} WHERE bw.depth < {hops})"""


def _forward_sql(hops: int, least: float) -> str:
    return f"""fw(node, depth) AS (SELECT qname, 0 FROM nf WHERE CAST(qname[2:] AS BIGINT) % 499 = 0
 UNION SELECT e.callee, fw.depth + 1 FROM fw JOIN call_edges e ON e.caller = fw.node AND e.confidence >= {least} WHERE fw.depth < {hops})"""


# Callees with a number of this kind stand for known sinks, local names that only look like one, and others.
_SINK_NAMES = "CASE CAST(callee[2:] AS INT) % 2000 WHEN 0 THEN 'cursor.execute' WHEN 1 THEN 'os.system' WHEN 2 THEN 'pickle.loads' WHEN 3 THEN 'a.b.Open' WHEN 4 THEN 'execute' WHEN 5 THEN 'x.y.raw' WHEN 6 THEN 'shutil.copy' ELSE callee END"
_NAMED = f"named AS (SELECT caller, {_SINK_NAMES} AS callee, 'src/g' || (CAST(caller[2:] AS INT) // 10) || '.py' AS file, confidence FROM call_edges)"
_HITS = """hits AS (SELECT *, CASE WHEN callee IN ('cursor.execute', 'x.y.raw') THEN '89' WHEN callee = 'os.system' THEN '78' WHEN callee = 'pickle.loads' THEN '502' WHEN callee = 'shutil.copy' THEN '22' END AS cwe_id FROM named)"""


def _named(edges):
    n = _number("callee") % 2000
    names = {0: "cursor.execute", 1: "os.system", 2: "pickle.loads", 3: "a.b.Open", 4: "execute", 5: "x.y.raw", 6: "shutil.copy"}
    callee = F.col("callee")
    for k, v in names.items():
        callee = F.when(n == k, F.lit(v)).otherwise(callee)
    return edges.select("caller", callee.alias("callee"), _file_of("caller").alias("file"), "confidence")


@query(f"""{_E}, {_NAMED}, {_HITS}, {_back_sql(2, 0.3)} SELECT tag, node, CAST(min(depth) AS INT) AS depth FROM bw GROUP BY tag, node""")
def reach_backward(spark, sf):
    """From the callers of known sinks, which patterns find, two hops back."""
    e = _named(settle(_edges(spark, sf), "edges"))
    return G.reach(G.sink_seeds(e), e, 2, "backward")


@query(f"""{_E}, {_FILES}, {_forward_sql(2, 0.3)} SELECT node, CAST(min(depth) AS INT) AS depth FROM fw GROUP BY node""")
def reach_forward(spark, sf):
    edges, files = _graph(spark, sf)
    return G.reach(_entry_seeds(files), edges, 2, "forward").select("node", "depth")


@query(f"""{_E}, {_FILES}, {_NAMED}, {_HITS}, {_back_sql(4, 0.3)}, {_forward_sql(4, 0.3)}, b AS (SELECT DISTINCT tag, file FROM bw JOIN nf ON nf.qname = bw.node), f AS (SELECT DISTINCT file FROM fw JOIN nf ON nf.qname = fw.node),
x AS (SELECT tag, file FROM b WHERE file IN (SELECT file FROM f)) SELECT tag, file, 'both' AS via FROM x
 UNION ALL SELECT tag, file, 'backward' FROM b WHERE tag NOT IN (SELECT tag FROM x) UNION ALL SELECT '79', file, 'forward' FROM f""")
def reach_both(spark, sf):
    """Files between entry points and sinks: four hops either way over calls of a confidence of 0.3 or more."""
    edges, files = _graph(spark, sf)
    e = _named(edges)
    back = G.reached_files(G.reach(G.sink_seeds(e), e, 4, "backward"), files)
    ahead = G.reached_files(G.reach(_entry_seeds(files), edges, 4, "forward"), files)
    return G.both_ways(back, ahead, ["22", "78", "79", "89", "502"])


_BLAST = """bl(node, depth) AS (SELECT qname, 0 FROM nf WHERE file IN ('src/g11.py', 'src/g31.py')
 UNION SELECT x.dst, bl.depth + 1 FROM bl JOIN (SELECT caller AS src, callee AS dst FROM call_edges UNION SELECT callee, caller FROM call_edges) x ON x.src = bl.node WHERE bl.depth < 1),
blast AS (SELECT DISTINCT file FROM bl JOIN nf ON nf.qname = bl.node UNION SELECT 'src/g11.py' UNION SELECT 'src/g31.py')"""


def _changed(files):
    return files.filter("file IN ('src/g11.py', 'src/g31.py')").select("file").distinct()


@query(f"""{_E}, {_FILES}, {_BLAST} SELECT file FROM blast""")
def blast_radius(spark, sf):
    edges, files = _graph(spark, sf)
    return G.blast_radius(edges, files, _changed(files), 1)


@query(f"""{_E}, {_NAMED}, {_HITS} SELECT DISTINCT caller, callee, file, confidence, cwe_id FROM hits WHERE cwe_id IS NOT NULL""")
def pattern_hits(spark, sf):
    return matching.sink_calls(_named(_edges(spark, sf)))


_SYM = "sym AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'app.db.Repo.execute' WHEN 1 THEN 'app.shell.os.system' WHEN 2 THEN 'os.system' WHEN 3 THEN 'app.views.index' WHEN 4 THEN 'Process.Start' ELSE 'app.io.copy' END || '' AS q, p_brand FROM part)"


@query(f"""WITH {_SYM} SELECT DISTINCT q AS qname, CASE WHEN q = 'app.db.Repo.execute' THEN '89' WHEN q LIKE '%os.system' THEN '78' WHEN q = 'app.io.copy' THEN '22' END AS cwe_id FROM sym WHERE q NOT IN ('app.views.index', 'Process.Start')""")
def sink_symbols(spark, sf):
    n = F.col("p_partkey") % 6
    names = ["app.db.Repo.execute", "app.shell.os.system", "os.system", "app.views.index", "Process.Start", "app.io.copy"]
    q = F.lit(names[-1])
    for i, v in enumerate(names[:-1]):
        q = F.when(n == i, F.lit(v)).otherwise(q)
    s = table(spark, sf, "part").select(q.alias("qname")).distinct()
    return matching.sink_symbols(s.select("qname", matching.last_name(F.col("qname")).alias("name"), F.lit("python").alias("language")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 IN (0, 1) ELSE p_partkey % 5 IN (2, 3) OR p_partkey % 7 = 0 END AS entry FROM part""")
def entry_points(spark, sf):
    k = F.col("p_partkey")
    m = k % 5
    dec = F.array(F.when(m == 0, "app.route").when(m == 1, "router.post").when(m == 2, "HttpGet").when(m == 3, "Route").otherwise("route"))
    base = F.array(F.when(k % 7 == 0, "x.ControllerBase").otherwise("Base"))
    lang = F.when(k % 2 == 0, "python").otherwise("csharp")
    return table(spark, sf, "part").select("p_partkey", matching.is_entry_point(lang, dec, base).alias("entry"))


@query(f"""{_E}, {_NAMED}, s AS (SELECT DISTINCT 'n' || (p_partkey * 6) AS qname FROM part)
SELECT qname, 'def/' || qname || '.py' AS file FROM s UNION ALL SELECT caller, min(file) FROM named WHERE caller NOT IN (SELECT qname FROM s) GROUP BY caller""")
def symbol_files(spark, sf):
    s = table(spark, sf, "part").select(
        F.concat(F.lit("n"), (F.col("p_partkey") * 6).cast("string")).alias("qname"), F.col("p_partkey").alias("ordinal"))
    s = s.withColumn("file", F.concat(F.lit("def/"), "qname", F.lit(".py")))
    return matching.first_symbol_files(s, _named(_edges(spark, sf)).withColumn("ordinal", F.lit(0)))


_MODS = "mods AS (SELECT DISTINCT 'm' || (l_suppkey % 17) || '.f' || (l_orderkey % 101) AS module FROM lineitem)"
_IMPS = """imps AS (SELECT DISTINCT 'm' || (l_suppkey % 17) || '.f' || (l_orderkey % 101) AS module, CASE l_linenumber WHEN 1 THEN 'm' || (l_partkey % 20) || '.f' || (l_partkey % 130)
 WHEN 2 THEN 'm' || (l_partkey % 20) || '.f' || (l_partkey % 130) || '.Type' || (l_partkey % 9) WHEN 3 THEN 'm' || (l_partkey % 20) ELSE 'ext.lib' || (l_partkey % 5) END AS imported FROM lineitem)"""
_RES = """known AS (SELECT module AS k FROM mods UNION SELECT split_part(module, '.', 1) FROM mods),
res AS (SELECT module, imported, CASE WHEN imported IN (SELECT k FROM known) THEN imported WHEN contains(imported, '.') AND regexp_replace(imported, '\\.[^.]*$', '') IN (SELECT k FROM known) THEN regexp_replace(imported, '\\.[^.]*$', '') END AS target FROM imps)"""


def _modules(spark, sf):
    text = lambda c, n: (F.col(c) % n).cast("string")
    li = table(spark, sf, "lineitem")
    mod = F.concat(F.lit("m"), text("l_suppkey", 17), F.lit(".f"), text("l_orderkey", 101))
    p = F.concat(F.lit("m"), text("l_partkey", 20))
    pf = F.concat(p, F.lit(".f"), text("l_partkey", 130))
    n = F.col("l_linenumber")
    imported = F.when(n == 1, pf).when(n == 2, F.concat(pf, F.lit(".Type"), text("l_partkey", 9))).when(n == 3, p).otherwise(
        F.concat(F.lit("ext.lib"), text("l_partkey", 5)))
    return li.select(mod.alias("module")).distinct(), li.select(mod.alias("module"), imported.alias("imported")).distinct()


@query(f"""WITH {_MODS}, {_IMPS}, {_RES} SELECT module, imported, target FROM res WHERE target IS NOT NULL""")
def resolved_imports(spark, sf):
    mods, imps = _modules(spark, sf)
    return matching.resolve_imports(imps, mods)


@query(f"""WITH {_MODS}, {_IMPS}, {_RES}, alias AS (SELECT module, regexp_extract(imported, '[^.]*$') AS a, arg_max(target, imported) AS target FROM res WHERE target IS NOT NULL GROUP BY 1, 2),
syms AS (SELECT DISTINCT 'm' || (l_suppkey % 17) || '.f' || (l_orderkey % 30) || '.' || CASE l_linenumber % 2 WHEN 0 THEN 'Item' ELSE 'Type' END || (l_partkey % 12) AS qname FROM lineitem),
uses AS (SELECT DISTINCT 'm' || (l_suppkey % 17) || '.f' || (l_orderkey % 101) || '.run' AS source, 'm' || (l_suppkey % 17) || '.f' || (l_orderkey % 101) AS module,
 CASE l_linenumber WHEN 1 THEN 'Type' || (l_partkey % 14) WHEN 2 THEN 'Item' || (l_partkey % 14) WHEN 3 THEN 'f3.Item' || (l_partkey % 12) ELSE 'int' END AS type_name FROM lineitem),
r AS (SELECT u.source, u.type_name, coalesce(a.target, (SELECT min(qname) FROM syms s WHERE s.qname LIKE '%.' || u.type_name)) AS target FROM uses u LEFT JOIN alias a ON a.module = u.module AND a.a = u.type_name WHERE NOT regexp_matches(u.type_name, '^[a-z]'))
SELECT source, type_name, target FROM r WHERE target IS NOT NULL""")
def resolved_refs(spark, sf):
    mods, imps = _modules(spark, sf)
    text = lambda c, n: (F.col(c) % n).cast("string")
    n = F.col("l_linenumber")
    li = table(spark, sf, "lineitem")
    mod = F.concat(F.lit("m"), text("l_suppkey", 17), F.lit(".f"), text("l_orderkey", 101))
    syms = li.select(
        F.concat(F.lit("m"), text("l_suppkey", 17), F.lit(".f"), text("l_orderkey", 30), F.when(n % 2 == 0, ".Item").otherwise(".Type"), text("l_partkey", 12)).alias("qname")).distinct()
    name = F.when(n == 1, F.concat(F.lit("Type"), text("l_partkey", 14))).when(n == 2, F.concat(F.lit("Item"), text("l_partkey", 14))).when(
        n == 3, F.concat(F.lit("f3.Item"), text("l_partkey", 12))).otherwise(F.lit("int"))
    uses = li.select(
        F.concat(mod, F.lit(".run")).alias("source"), mod.alias("module"), name.alias("type_name")).distinct()
    return matching.resolve_type_names(uses, matching.resolve_imports(imps, mods), syms)


@query(f"""{_E}, ends AS (SELECT caller AS node, 1 AS o, 0 AS i FROM call_edges UNION ALL SELECT callee, 0, 1 FROM call_edges) SELECT node, CAST(sum(o) AS BIGINT) AS ce, CAST(sum(i) AS BIGINT) AS ca FROM ends GROUP BY node""")
def coupling(spark, sf):
    return G.coupling(_edges(spark, sf), [], "caller", "callee")


@query("""WITH a AS (SELECT 'n' || (l_partkey % 300) AS caller, 'n' || (l_suppkey % 200) AS callee, CAST(l_linenumber AS INT) AS line FROM lineitem),
e AS (SELECT DISTINCT caller, callee, line FROM a) SELECT node, count(line) AS n_out FROM (SELECT DISTINCT 'n' || (p_partkey % 310) AS node FROM part UNION SELECT caller FROM e) LEFT JOIN e ON e.caller = node GROUP BY node""")
def graph_build(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("n"), (F.col("l_partkey") % 300).cast("string")).alias("caller"),
        F.concat(F.lit("n"), (F.col("l_suppkey") % 200).cast("string")).alias("callee"), F.col("l_linenumber").alias("line"))
    symbols = table(spark, sf, "part").select(F.concat(F.lit("n"), (F.col("p_partkey") % 310).cast("string")).alias("qname"))
    nodes, edges = G.build_graph(symbols, [li.filter("line % 2 = 0"), li.filter("line % 2 = 1"), li.filter("line = 1")])
    return nodes.join(edges, F.col("node") == F.col("caller"), "left").groupBy("node").agg(F.count("line").alias("n_out"))


def _rank_graph(spark, sf):
    """Nodes and edges, each written once: part to supplier-made nodes; those of the seventh lines have no way out."""
    li = table(spark, sf, "lineitem")
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    dst = F.when(n == 7, F.concat(F.lit("q"), s.cast("string"))).otherwise(F.concat(F.lit("p"), (s * 7 + n).cast("string")))
    e = settle(li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), dst.alias("dst")).distinct(), "rank_edges")
    return settle(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "rank_nodes"), e


_RG = """g AS (SELECT DISTINCT 'p' || l_partkey AS src, CASE WHEN l_linenumber = 7 THEN 'q' || l_suppkey ELSE 'p' || (l_suppkey * 7 + l_linenumber) END AS dst FROM lineitem)"""


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH {_RG}", "nd AS MATERIALIZED (SELECT src AS node FROM g UNION SELECT dst FROM g)",
             "ge AS MATERIALIZED (SELECT src, dst FROM g WHERE src <> dst)", "od AS MATERIALIZED (SELECT src, count(*) AS n_out FROM ge GROUP BY src)",
             "sh AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / n_out AS share FROM ge JOIN od USING (src))",
             "it0 AS MATERIALIZED (SELECT node, n_out IS NULL AS dang, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank, 1e9::DOUBLE AS delta FROM nd LEFT JOIN od ON od.src = node)"]
    for k in range(1, rounds + 1):
        p = f"it{k - 1}"
        parts.append(f"""st{k} AS MATERIALIZED (SELECT p.node, p.dang, p.rank AS old, p.delta AS d0, 0.15::DOUBLE / (SELECT count(*) FROM nd) + 0.85::DOUBLE * coalesce((SELECT sum(rank) FROM {p} WHERE dang), 0) / (SELECT count(*) FROM nd) + 0.85::DOUBLE * coalesce(gain, 0) AS new
          FROM {p} p LEFT JOIN (SELECT dst, sum(rank * share) AS gain FROM sh JOIN {p} ON {p}.node = sh.src GROUP BY dst) q ON q.dst = p.node)""")
        parts.append(f"it{k} AS MATERIALIZED (SELECT node, dang, CASE WHEN d0 < 1e-6 THEN old ELSE new END AS rank, CASE WHEN d0 < 1e-6 THEN d0 ELSE (SELECT sum(abs(new - old)) FROM st{k}) END AS delta FROM st{k})")
    return ", ".join(parts)


@query(f"""{_pagerank_sql(30)} SELECT node, round(rank / (SELECT max(rank) FROM it30), 6) AS rank FROM it30""")
def pagerank(spark, sf):
    nodes, e = _rank_graph(spark, sf)
    return G.pagerank(nodes, e).select("node", F.round("rank", 6).alias("rank"))


@query(f"""{_pagerank_sql(30)}, r AS (SELECT node, rank / (SELECT max(rank) FROM it30) AS rank FROM it30) SELECT 'src/g' || (CAST(node[2:] AS INT) % 50) || '.py' AS file, round(sum(rank), 5) AS file_rank FROM r GROUP BY 1""")
def files_by_rank(spark, sf):
    nodes, e = _rank_graph(spark, sf)
    ranks = G.call_graph_rank(nodes, e.select(F.col("src").alias("caller"), F.col("dst").alias("callee")))
    files = nodes.select(F.col("node").alias("qname"), F.concat(F.lit("src/g"), (F.substring("node", 2, 10).cast("int") % 50).cast("string"), F.lit(".py")).alias("file"))
    out = G.files_by_rank(files.select("file").distinct(), files, ranks, [])
    return out.select("file", F.round("file_rank", 5).alias("file_rank"))


_CYC = """ce AS (SELECT DISTINCT 'p' || (l_partkey % 211) AS src, 'p' || ((l_partkey % 211 * 3 + l_suppkey % 2 * 7) % 223) AS dst FROM lineitem)"""


def _cycle_graph(spark, sf):
    li = table(spark, sf, "lineitem")
    a = F.col("l_partkey") % 211
    return li.select(F.concat(F.lit("p"), a.cast("string")).alias("src"),
                     F.concat(F.lit("p"), ((a * 3 + F.col("l_suppkey") % 2 * 7) % 223).cast("string")).alias("dst")).distinct()


@query(f"""WITH RECURSIVE {_CYC}, tc(a, b) AS (SELECT src, dst FROM ce UNION SELECT tc.a, ce.dst FROM tc JOIN ce ON ce.src = tc.b)
SELECT x.a AS node, max(greatest(x.a, x.b)) AS component FROM tc x WHERE EXISTS (SELECT 1 FROM tc y WHERE y.a = x.b AND y.b = x.a) GROUP BY x.a""")
def cyclic_nodes(spark, sf):
    return G.cyclic_components(_cycle_graph(spark, sf))


@query(f"""WITH {_CYC} SELECT DISTINCT least(x.src, x.dst) AS a, greatest(x.src, x.dst) AS b FROM ce x JOIN ce y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst""")
def two_cycles(spark, sf):
    return G.two_cycles(_cycle_graph(spark, sf))


_GRAPH_FILES = "gf AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN '89' WHEN 1 THEN '22' WHEN 2 THEN '862' ELSE '502' END AS cwe_id, file FROM tree_manifest)"
_SEL = """both_sides AS (SELECT cwe_id, file, bool_or(g) AS by_graph, bool_or(w) AS by_words FROM (SELECT cwe_id, file, true AS g, false AS w FROM gf UNION ALL SELECT cwe_id, file, false, true FROM sel) GROUP BY cwe_id, file)"""


def _graph_files(spark, sf):
    m = F.col("doc_id") % 4
    cwe = F.when(m == 0, "89").when(m == 1, "22").when(m == 2, "862").otherwise("502")
    return view(spark, sf, "tree_manifest").select(cwe.alias("cwe_id"), "file").distinct()


@query(f"""{sql_with('tree_manifest')}, {_KW}, {_GRAPH_FILES}, {_SEL} SELECT cwe_id, file, by_graph, by_words FROM both_sides""")
def selection_union(spark, sf):
    return G.select_files(view(spark, sf, "tree_manifest"), _graph_files(spark, sf))


@query(f"""{sql_with('tree_manifest')}, {_KW}, {_GRAPH_FILES}, {_SEL} SELECT cwe_id, CASE WHEN count(*) FILTER (by_graph) > 0 THEN 'graph' ELSE 'keyword' END AS method, count(*) FILTER (by_graph) AS graph_files,
 count(*) FILTER (by_words) AS word_files, count(*) AS selected FROM both_sides GROUP BY cwe_id""")
def selection_counts(spark, sf):
    g = _graph_files(spark, sf)
    return G.selection_counts(G.select_files(view(spark, sf, "tree_manifest"), g), g)


@query(f"""{sql_with('tree_manifest')}, {_KW}, {_GRAPH_FILES} SELECT coalesce(g.cwe_id, s.cwe_id) AS cwe_id, coalesce(g.file, s.file) AS file, CASE WHEN s.file IS NULL THEN 'only_a' WHEN g.file IS NULL THEN 'only_b' ELSE 'common' END AS side
FROM gf g FULL JOIN sel s ON g.cwe_id = s.cwe_id AND g.file = s.file""")
def selection_diff(spark, sf):
    return history.key_diff(_graph_files(spark, sf), matching.files_by_words(view(spark, sf, "tree_manifest")), ["cwe_id", "file"])


_DIRS = {c[0]: c[4] for c in K.CWE_REGISTRY if c[2] in K.MODEL_DETECTIONS}


@query(f"""{_E}, {_FILES}, {_NAMED}, {_HITS}, {_BLAST}, ck(cwe_id, dir) AS (VALUES {", ".join(f"('{c}', {repr(d) if d else 'NULL'})" for c, d in _DIRS.items())}),
kw(cwe_id, word) AS (VALUES {", ".join(f"('{c[0]}', '{w}')" for c in K.CWE_REGISTRY if c[2] in K.MODEL_DETECTIONS for w in sorted({w for t in c[3] for w in K.FILE_TYPE_WORDS[t]}))}),
j AS (SELECT cwe_id, CASE WHEN dir = 'forward' THEN EXISTS (SELECT 1 FROM nf WHERE CAST(qname[2:] AS BIGINT) % 499 = 0 AND file IN (SELECT file FROM blast))
 WHEN dir IS NOT NULL THEN EXISTS (SELECT 1 FROM hits h WHERE h.cwe_id = ck.cwe_id AND h.file IN (SELECT file FROM blast))
 ELSE EXISTS (SELECT 1 FROM blast JOIN kw ON kw.cwe_id = ck.cwe_id AND contains(file, word)) END AS hit FROM ck)
SELECT cwe_id, hit AS narrowed FROM j WHERE hit OR NOT (SELECT bool_or(hit) FROM j)""")
def affected_checks(spark, sf):
    edges, files = _graph(spark, sf)
    blast = G.blast_radius(edges, files, _changed(files), 1)
    return G.affected_checks(dimensions.cwe_checks(spark), blast, _named(edges), files, _entries(files))


@query("""WITH m AS (SELECT source AS project, doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents),
s AS (SELECT source AS project, doc_id % 5 < 2 AS c FROM documents)
SELECT project, n_files, n_lines, n_classes, n_functions FROM (SELECT project, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS n_lines FROM m GROUP BY project)
 JOIN (SELECT project, count(*) FILTER (c) AS n_classes, count(*) FILTER (NOT c) AS n_functions FROM s GROUP BY project) USING (project)""")
def code_map_stats(spark, sf):
    d = table(spark, sf, "documents")
    symbols = d.select(F.col("source").alias("project"), F.when(F.col("doc_id") % 5 < 2, "class").otherwise("function").alias("kind"))
    return G.code_map_totals(view(spark, sf, "file_metrics"), symbols, ["project"])


@query(f"""{sql_with('tree')}, {_pagerank_sql(30)[5:]}, r AS (SELECT node, rank / (SELECT max(rank) FROM it30) AS rank FROM it30),
t AS (SELECT 'p' || doc_id AS node, CASE WHEN path LIKE '%/%/%' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS layer FROM tree)
SELECT layer, count(*) AS n_files, round(sum(coalesce(rank, 0)), 5) AS layer_rank FROM t LEFT JOIN r USING (node) GROUP BY layer""")
def layer_ranks(spark, sf):
    from glintmark.functions.paths import module_name

    nodes, e = _rank_graph(spark, sf)
    ranks = G.pagerank(nodes, e)
    tree = view(spark, sf, "tree")
    names = tree.select(module_name(F.col("path")).alias("name"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("node"))
    by_name = ranks.join(names, "node").select(F.col("name").alias("node"), "rank")
    return G.layer_ranks(tree.select(F.col("path").alias("file")), by_name).select("layer", "n_files", F.round("layer_rank", 5).alias("layer_rank"))


@query(f"""{sql_with('tree')}, {_pagerank_sql(30)[5:]}, r AS (SELECT node, rank / (SELECT max(rank) FROM it30) AS rank FROM it30),
t AS (SELECT 'p' || doc_id AS node, path AS file, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(doc_id % 4 AS INT) AS classes, CAST(doc_id % 9 AS INT) AS functions FROM tree)
SELECT file, lines, classes, functions, round(rank, 5) AS rank FROM (SELECT t.*, coalesce(rank, 0) AS rank FROM t LEFT JOIN r USING (node)) ORDER BY rank DESC, file LIMIT 10""")
def top_modules(spark, sf):
    """The ten modules of highest page rank."""
    from glintmark.functions.paths import module_name

    nodes, e = _rank_graph(spark, sf)
    ranks = G.pagerank(nodes, e)
    tree = view(spark, sf, "tree")
    names = tree.select(module_name(F.col("path")).alias("name"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("node"))
    modules = tree.select(F.col("path").alias("file"), F.size(F.split("text", "\n")).alias("lines"), (F.col("doc_id") % 4).cast("int").alias("classes"), (F.col("doc_id") % 9).cast("int").alias("functions"))
    return G.top_modules(modules, ranks.join(names, "node").select(F.col("name").alias("node"), "rank")).withColumn("rank", F.round("rank", 5))


@query(f"""WITH {_MODS}, {_IMPS} SELECT DISTINCT module, imported FROM imps WHERE imported IN (SELECT module FROM mods) OR regexp_replace(imported, '\\.[^.]*$', '') IN (SELECT module FROM mods)""")
def import_pairs(spark, sf):
    mods, imps = _modules(spark, sf)
    return G.import_pairs(imps, mods)
