"""Queries over runs: tracking, cost, budget, packing, votes, ledger, incremental rebuild."""

from pyspark.sql import functions as F

from glintmark.functions.levels import lookup
from glintmark.functions.text import fingerprint
from glintmark.operators import evaluation, history, matching, packing, reports, retries
from glintmark.operators.prefix import numbered
from glintmark.plans.catalog.registry import ORD, ORDER, query
from glintmark.plans.views import sql_with, table, view
from glintmark.functions import constants as K
from glintmark.sources import files as S
from glintmark.sources import ledger

_F = sql_with("findings")
_CALLS = sql_with("llm_calls")
# Rows of a call log are numbered, so one slice of this width holds at most that many calls. The width gives the
# smallest tables several slices; a real log would take a larger one.
_SLICE = 1 << 8


# Fixed values, written out here so that the twins do not share them with the code under test.
_PRICED = """named AS (SELECT *, coalesce(CASE split_part(model, ':', 2) WHEN 'claude-sonnet' THEN 'claude-sonnet-4.6' WHEN 'claude-opus' THEN 'claude-opus-4.6' WHEN 'claude-haiku' THEN 'claude-haiku-4.5' WHEN 'gpt' THEN 'gpt-5.5' WHEN 'gpt-mini' THEN 'gpt-5.4-mini' WHEN 'o3' THEN 'o3' END,
 split_part(model, ':', 2)) AS canonical FROM llm_calls),
keyed AS (SELECT *, split_part(model, ':', 1) || ':' || coalesce(CASE split_part(model, ':', 1) || ':' || canonical WHEN 'anthropic:claude-sonnet-4.6' THEN 'claude-sonnet-4-6'
 WHEN 'anthropic:claude-opus-4.6' THEN 'claude-opus-4-6'
 WHEN 'anthropic:claude-haiku-4.5' THEN 'claude-haiku-4-5'
 WHEN 'claude:claude-sonnet-4.6' THEN 'claude-sonnet-4-6'
 WHEN 'claude:claude-opus-4.6' THEN 'claude-opus-4-6'
 WHEN 'claude:claude-haiku-4.5' THEN 'claude-haiku-4-5'
 WHEN 'foundry:gpt-5.5' THEN 'gpt-5.4'
 WHEN 'foundry:gpt-5.4-mini' THEN 'gpt-5-mini' END, canonical) AS model_resolved FROM named),
prices(price_key, price_in, price_out) AS (VALUES ('copilot:claude-opus-4.6', 0.000005000::DECIMAL(10,9), 0.000025000::DECIMAL(10,9)),
 ('copilot:claude-sonnet-4.6', 0.000003000::DECIMAL(10,9), 0.000015000::DECIMAL(10,9)),
 ('copilot:claude-haiku-4.5', 0.000001000::DECIMAL(10,9), 0.000005000::DECIMAL(10,9)),
 ('copilot:gpt-5.5', 0.000002000::DECIMAL(10,9), 0.000010000::DECIMAL(10,9)),
 ('claude:claude-opus-4-6', 0.000005000::DECIMAL(10,9), 0.000025000::DECIMAL(10,9)),
 ('claude:claude-sonnet-4-6', 0.000003000::DECIMAL(10,9), 0.000015000::DECIMAL(10,9)),
 ('claude:claude-haiku-4-5', 0.000001000::DECIMAL(10,9), 0.000005000::DECIMAL(10,9)),
 ('codex:gpt-5.5', 0.000002000::DECIMAL(10,9), 0.000010000::DECIMAL(10,9)),
 ('openai:gpt-5.5', 0.000002000::DECIMAL(10,9), 0.000010000::DECIMAL(10,9)),
 ('openai:gpt-5.4-mini', 0.000000400::DECIMAL(10,9), 0.000001600::DECIMAL(10,9)),
 ('openai:o3', 0.000002000::DECIMAL(10,9), 0.000008000::DECIMAL(10,9)),
 ('anthropic:claude-opus-4-6', 0.000005000::DECIMAL(10,9), 0.000025000::DECIMAL(10,9)),
 ('anthropic:claude-sonnet-4-6', 0.000003000::DECIMAL(10,9), 0.000015000::DECIMAL(10,9)),
 ('anthropic:claude-haiku-4-5', 0.000001000::DECIMAL(10,9), 0.000005000::DECIMAL(10,9)),
 ('foundry:gpt-5.4', 0.000002750::DECIMAL(10,9), 0.000016500::DECIMAL(10,9)),
 ('foundry:gpt-5-mini', 0.000000275::DECIMAL(10,9), 0.000002200::DECIMAL(10,9)),
 ('foundry:gpt-5-nano', 0.000000055::DECIMAL(10,9), 0.000000440::DECIMAL(10,9))),
priced AS (SELECT k.*, tokens_in * price_in + tokens_out * price_out AS cost_usd FROM keyed k JOIN prices p ON k.model_resolved = p.price_key)"""


def _priced(spark, sf):
    return matching.priced(view(spark, sf, "llm_calls"))


@query(f"""{_CALLS}, {_PRICED} SELECT seq, model_resolved, cost_usd::DOUBLE AS cost_usd FROM priced""")
def priced_calls(spark, sf):
    return _priced(spark, sf).select("seq", "model_resolved", F.col("cost_usd").cast("double").alias("cost_usd"))


@query(f"""{_CALLS}, {_PRICED} SELECT run_id, agent, count(*) AS n_calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 sum(cost_usd)::DOUBLE AS cost_usd, sum(cost_usd) >= 1.0 AS exceeded FROM priced GROUP BY run_id, agent""")
def cost_totals(spark, sf):
    return history.cost_totals(_priced(spark, sf), ["run_id", "agent"], 1.0).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query(f"""{_CALLS}, {_PRICED}, listed AS (
 SELECT provider, alias, provider || ':' || coalesce(wire, canonical) AS price_key FROM (SELECT p.provider, a.alias, a.canonical, w.wire
  FROM (VALUES ('anthropic'), ('claude'), ('copilot'), ('openai'), ('codex'), ('foundry')) p(provider) CROSS JOIN (VALUES ('claude-sonnet', 'claude-sonnet-4.6'), ('claude-opus', 'claude-opus-4.6'), ('claude-haiku', 'claude-haiku-4.5'), ('gpt', 'gpt-5.5'), ('gpt-mini', 'gpt-5.4-mini'), ('o3', 'o3')) a(alias, canonical)
  LEFT JOIN (VALUES ('anthropic', 'claude-sonnet-4.6', 'claude-sonnet-4-6'), ('anthropic', 'claude-opus-4.6', 'claude-opus-4-6'), ('anthropic', 'claude-haiku-4.5', 'claude-haiku-4-5'), ('claude', 'claude-sonnet-4.6', 'claude-sonnet-4-6'), ('claude', 'claude-opus-4.6', 'claude-opus-4-6'), ('claude', 'claude-haiku-4.5', 'claude-haiku-4-5'), ('foundry', 'gpt-5.5', 'gpt-5.4'), ('foundry', 'gpt-5.4-mini', 'gpt-5-mini')) w(provider, model, wire) ON w.provider = p.provider AND w.model = a.canonical)),
rows AS (SELECT l.provider, l.alias, l.price_key, p.price_in::DOUBLE AS price_in, p.price_out::DOUBLE AS price_out FROM listed l LEFT JOIN prices p USING (price_key)
 UNION ALL SELECT split_part(price_key, ':', 1), NULL, price_key, price_in::DOUBLE, price_out::DOUBLE FROM prices WHERE price_key NOT IN (SELECT price_key FROM listed)),
used AS (SELECT model_resolved AS price_key, count(*) AS n FROM priced GROUP BY 1)
SELECT r.*, coalesce(n, 0) AS n_calls FROM rows r LEFT JOIN used USING (price_key)""")
def model_listing(spark, sf):
    used = _priced(spark, sf).groupBy(F.col("model_resolved").alias("price_key")).agg(F.count(F.lit(1)).alias("_n"))
    return matching.price_list(spark).join(used, "price_key", "left").select(
        "provider", "alias", "price_key", "price_in", "price_out", F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_calls"))


@query(f"""{_CALLS}, {_PRICED} SELECT price_key, price_in::DOUBLE AS price_in, price_out::DOUBLE AS price_out FROM prices WHERE price_key NOT IN (SELECT model_resolved FROM priced)""")
def unreachable_prices(spark, sf):
    from glintmark.sources.dimensions import prices

    used = _priced(spark, sf).select(F.col("model_resolved").alias("price_key")).distinct()
    return prices(spark).join(used, "price_key", "left_anti")


@query(f"""{_CALLS}, {_PRICED} SELECT run_id, seq, (sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::DOUBLE AS cumulative_usd FROM priced""")
def running_cost(spark, sf):
    out = history.running_cost(_priced(spark, sf), ["run_id"], ["seq"], F.floor(F.col("seq") / _SLICE))
    return out.select("run_id", "seq", F.col("cumulative_usd").cast("double").alias("cumulative_usd"))


@query(f"""{_CALLS}, {_PRICED}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS n,
  coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM priced),
b AS (SELECT *, CAST(n // 4 AS BIGINT) AS batch_no, first_value(c) OVER (PARTITION BY run_id, n // 4 ORDER BY seq) AS cost_before FROM n)
SELECT run_id, seq, batch_no, cost_before::DOUBLE AS cost_before, cost_before < 2.0 AS ran FROM b""")
def budget_cutoff(spark, sf):
    out = history.budget_cutoff(_priced(spark, sf), ["run_id"], ["seq"], 4, 2.0, F.floor(F.col("seq") / _SLICE))
    return out.select("run_id", "seq", "batch_no", F.col("cost_before").cast("double").alias("cost_before"), "ran")


@query(f"""{_F}, t AS (SELECT sha256(coalesce(cwe, '') || '||' || file || '|' || CAST(line AS VARCHAR))[:16] AS fingerprint, run_no, {ORD} FROM findings)
SELECT {ORD}, fingerprint, first_value('run' || run_no) OVER w AS first_seen_run, CASE WHEN row_number() OVER w = 1 THEN 'new' ELSE 'recurring' END AS status
FROM t WINDOW w AS (PARTITION BY fingerprint ORDER BY run_no, {ORD})""")
def first_seen(spark, sf):
    f = view(spark, sf, "findings").select(
        *ORDER, "run_no", F.concat(F.lit("run"), F.col("run_no").cast("string")).alias("run_id"),
        fingerprint(F.col("cwe"), F.lit(""), F.col("file"), F.col("line").cast("string")).alias("fingerprint"))
    return history.first_seen(f, ["run_no", *ORDER]).select(*ORDER, "fingerprint", "first_seen_run", "status")


@query(f"""{sql_with('votes')}, f AS (SELECT DISTINCT l_suppkey AS finding_id, CASE WHEN l_suppkey % 3 = 0 THEN 1 WHEN l_suppkey % 3 = 1 THEN 3 ELSE 200 END AS samples FROM lineitem),
v AS (SELECT finding_id, count(*) AS n_votes, count(*) FILTER (vote = 'CONFIRMED') AS c, bool_or(vote = 'FALSE_POSITIVE') AS fp, arg_min(vote, sample_id) AS first_vote
 FROM votes WHERE NOT failed GROUP BY finding_id)
SELECT finding_id, coalesce(n_votes, 0) AS n_votes, CASE WHEN n_votes IS NULL THEN 'NEEDS_CONTEXT' WHEN samples = 1 THEN first_vote WHEN c * 2 > samples THEN 'CONFIRMED'
 WHEN fp THEN 'FALSE_POSITIVE' ELSE 'NEEDS_CONTEXT' END AS verdict, n_votes IS NULL AS unresolved FROM f LEFT JOIN v USING (finding_id)""")
def vote_verdict(spark, sf):
    m = F.col("l_suppkey") % 3
    f = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("finding_id"), F.when(m == 0, 1).when(m == 1, 3).otherwise(200).alias("samples")).distinct()
    return evaluation.vote_verdicts(f, view(spark, sf, "votes"), F.col("samples")).drop("samples")


_PACK = """p AS (SELECT source, doc_id, CASE WHEN doc_id % 40 = 7 THEN NULL ELSE length(text) // 4 END AS tokens FROM documents),
c AS (SELECT *, row_number() OVER w AS n, coalesce(sum(coalesce(tokens, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
o AS (SELECT *, min(CASE WHEN c + coalesce(tokens, 0) > 7000 THEN n END) OVER (PARTITION BY source) AS o FROM c),
packed AS (SELECT *, CASE WHEN tokens IS NULL OR o IS NULL OR n < o THEN 'included' WHEN n = o AND c < 7000 THEN 'truncated' WHEN n > o AND tokens = 0 THEN 'included' ELSE 'omitted' END AS packed FROM o)"""


def _packed(spark, sf):
    d = table(spark, sf, "documents").select(
        "source", "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"),
        F.when(F.col("doc_id") % 40 != 7, F.floor(F.length("text") / K.CHARS_PER_TOKEN)).alias("tokens"))
    return packing.pack_files(d, ["source"], ["doc_id"], 10000, 3000, slice_by=F.floor(F.col("doc_id") / _SLICE))


@query(f"""WITH {_PACK} SELECT source, doc_id, packed, CAST(CASE WHEN packed = 'truncated' THEN (7000 - c) * 4 END AS BIGINT) AS keep_chars FROM packed""")
def token_packing(spark, sf):
    return _packed(spark, sf).select("source", "doc_id", "packed", "keep_chars")


@query(f"""WITH {_PACK}, s AS (SELECT source, count(*) AS a, count(*) FILTER (packed = 'omitted') AS n,
 list_sort(list((doc_id)) FILTER (packed = 'omitted'))[:5] AS first FROM packed GROUP BY source)
SELECT source, 'holistic' AS pass, 'files_omitted' AS kind, n || ' of ' || a || ' selected files did not fit the token budget and were NOT reviewed: '
 || array_to_string(list_transform(first, lambda x: 'd' || x), ', ') || CASE WHEN n > 5 THEN '…' ELSE '' END AS detail, n AS count FROM s WHERE n > 0""")
def omitted_files(spark, sf):
    return reports.omitted_losses(_packed(spark, sf), ["source"], "holistic", ["doc_id"])


@query("""WITH s AS (SELECT p_brand, p_partkey, p_retailprice AS rank, CAST(length(p_name) AS BIGINT) AS tokens FROM part),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY p_brand ORDER BY rank DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS c FROM s)
SELECT p_brand, p_partkey FROM c WHERE c <= 800""")
def trim_prefix(spark, sf):
    s = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("rank"),
                                        F.length("p_name").cast("bigint").alias("tokens"))
    return packing.trim_by_rank(s, ["p_brand"], [F.desc("rank"), "p_partkey"], 800).select("p_brand", "p_partkey")


_MAP = """items AS (SELECT l_suppkey % 24 AS project, 'm' || (l_partkey % 12) AS module, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name,
 CASE l_linenumber WHEN 1 THEN 'symbol' WHEN 2 THEN 'symbol' WHEN 3 THEN 'private_method' WHEN 4 THEN 'constant' WHEN 5 THEN 'import' ELSE 'module' END AS kind,
 l_extendedprice AS rank, CAST(l_quantity AS BIGINT) AS tokens, 5 + (l_partkey % 12) * 3 AS module_lines, CAST((l_partkey % 12) * 7 % 12 AS DOUBLE) AS module_rank FROM lineitem)"""


@query(f"""WITH {_MAP}, s AS (SELECT *, CASE kind WHEN 'symbol' THEN 1 WHEN 'private_method' THEN 2 WHEN 'constant' THEN 3 WHEN 'import' THEN 4 ELSE CASE WHEN module_lines < 20 THEN 5 ELSE 6 END END AS stage FROM items),
k AS (SELECT *, CASE stage WHEN 1 THEN rank WHEN 6 THEN module_rank ELSE 0 END AS r, CASE WHEN stage IN (1, 6) THEN module ELSE '' END AS m, CASE stage WHEN 1 THEN name ELSE '' END AS u FROM s),
units AS (SELECT project, stage, r, m, u, sum(tokens) AS t FROM k GROUP BY ALL),
sums AS (SELECT *, sum(t) OVER (PARTITION BY project) AS total, coalesce(sum(t) OVER (PARTITION BY project ORDER BY stage, r, m, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units)
SELECT project, name, kind, tokens, CAST(k.stage AS INT) AS stage, before >= total - CAST(total AS BIGINT) * (project % 8) // 8 AS kept FROM k JOIN sums USING (project, stage, r, m, u)""")
def trim_stages(spark, sf):
    """Code maps cut to shares of their size, so that every stage decides for some project."""
    li = table(spark, sf, "lineitem")
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    items = li.select(
        (F.col("l_suppkey") % 24).alias("project"), F.concat(F.lit("m"), (part % 12).cast("string")).alias("module"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), n.cast("string"), part.cast("string")).alias("name"),
        F.when(n <= 2, "symbol").when(n == 3, "private_method").when(n == 4, "constant").when(n == 5, "import").otherwise("module").alias("kind"),
        F.col("l_extendedprice").alias("rank"), F.col("l_quantity").cast("bigint").alias("tokens"), (5 + (part % 12) * 3).alias("module_lines"),
        ((part % 12) * 7 % 12).cast("double").alias("module_rank"))
    budgets = items.groupBy("project").agg(F.floor(F.sum("tokens") * (F.col("project") % 8) / 8).alias("max_tokens"))
    return packing.trim_in_stages(items, budgets, ["project"]).select("project", "name", "kind", "tokens", "stage", "kept")


def _round_sql(k: int) -> str:
    kept = "" if k == 1 else f" WHERE outcome = 'retry' OR (outcome = 'overflow' AND pos < greatest(1, n_files // 2))"
    return f"""q{k} AS (SELECT item, pos, file, count(*) OVER (PARTITION BY item) AS n_files FROM {'w' if k == 1 else f'a{k - 1}'}{kept}),
a{k} AS (SELECT *, {k} AS attempt, CASE WHEN item % 31 = 0 THEN 'fatal' WHEN n_files > 20 THEN 'overflow' WHEN item % 7 = 0 AND {k} = 1 THEN 'retry' WHEN item % 3 > 0 THEN 'completed' WHEN item % 5 = 0 THEN 'retry' ELSE 'completed' END AS outcome FROM q{k})"""


_ROUNDS = "w AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'f' || event_id AS file FROM events), " + ", ".join(map(_round_sql, (1, 2, 3)))
_ATTEMPTS = " UNION ALL ".join(f"SELECT * FROM a{k}" for k in (1, 2, 3))


def _attempts(spark, sf):
    """Items of a user's events as files; large ones overflow, some time out at first, some never answer."""
    events = table(spark, sf, "events")
    work = numbered(events.select(F.col("user_id").alias("item"), "event_id"), ["item"], ["event_id"], "no").select(
        "item", (F.col("no") - 1).alias("pos"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"))

    def attempt(items, k):
        i = F.col("item")
        error = F.when(i % 31 == 0, "model not available").when(F.col("n_files") > 20, "maximum context length exceeded").when((i % 7 == 0) & F.lit(k == 1), "timeout")
        return items.select("*", error.alias("error"), F.when(error.isNotNull(), "RuntimeError").alias("error_type"), (i % 3).alias("n_findings"), (i % 5 == 0).alias("parse_failed"))

    return retries.attempt_rounds(work, attempt, 3)


@query(f"""WITH {_ROUNDS} SELECT item, CAST(attempt AS INT) AS attempt, pos, file, n_files, outcome FROM ({_ATTEMPTS})""")
def retry_rounds(spark, sf):
    """The files of every attempt, halved after an overflow."""
    return _attempts(spark, sf)


@query(f"""WITH {_ROUNDS}, p AS (SELECT DISTINCT item, attempt, outcome, n_files AS n FROM ({_ATTEMPTS}))
SELECT item, CAST(attempt AS INT) AS attempt, 'files_omitted' AS kind, n - greatest(1, n // 2) AS n FROM p WHERE outcome = 'overflow' AND attempt < 3 AND n > greatest(1, n // 2)
UNION ALL SELECT item, CAST(attempt AS INT), 'check_failed', n FROM p WHERE outcome = 'fatal' OR (attempt = 3 AND outcome IN ('retry', 'overflow'))""")
def retry_losses(spark, sf):
    return retries.omitted_files(_attempts(spark, sf), 3)


@query("""WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0)
SELECT 'd' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'modified' ELSE 'unchanged' END AS state
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def incremental_diff(spark, sf):
    return history.file_changes(*_snapshots(spark, sf))


def _snapshots(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    sha = F.sha2(F.col("text"), 256).alias("sha256")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return d.filter("doc_id % 10 <> 0").select("path", sha), d.filter("doc_id % 9 <> 0").select(
        "path", F.sha2(changed, 256).alias("sha256"))


@query("""WITH s AS (SELECT doc_id, doc_id % 10 <> 0 AS o, doc_id % 9 <> 0 AS n, doc_id % 7 = 0 AS m FROM documents)
SELECT 'd' || doc_id AS file, CASE WHEN o AND n AND NOT m THEN 'old' ELSE 'fresh' END AS snapshot FROM s WHERE n""")
def incremental_rebuild(spark, sf):
    old, new = _snapshots(spark, sf)
    rows = lambda df, label: df.select(F.col("path").alias("file"), F.lit(label).alias("snapshot"))
    return history.replace_changed(rows(old, "old"), rows(new, "fresh"), history.file_changes(old, new))


@query("""SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_runs FROM events GROUP BY event_type""")
def event_kinds(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(ledger.event_line(F.col("ts"), F.col("event_type"), run_id=F.col("user_id").cast("string"),
                                       value=F.col("value")).alias("value"))
    return ledger.parse_events(lines).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("n_runs"))


@query(f"""{_F}, runs AS (SELECT DISTINCT 'run' || user_id AS run_id, 't' || (user_id % 4) AS target FROM events),
tot AS (SELECT 'run' || ordinal2 AS run_id, count(*) AS total, count(*) FILTER (rule_id IN ('R1', 'R2')) AS authz FROM findings GROUP BY 1),
ab AS (SELECT DISTINCT 'run' || user_id AS run_id FROM events WHERE event_type = 'error' AND event_id % 9 = 0)
SELECT r.run_id, r.run_id AS started, r.target, total, authz, CASE WHEN total IS NULL THEN 'incomplete' WHEN ab.run_id IS NOT NULL THEN 'salvaged' ELSE 'complete' END AS state
FROM runs r LEFT JOIN tot USING (run_id) LEFT JOIN ab ON ab.run_id = r.run_id WHERE target LIKE '%t1%' OR target LIKE '%t2%' OR target LIKE '%t0%' OR target LIKE '%t3%'""")
def run_catalogue(spark, sf):
    e = table(spark, sf, "events")
    rid = F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id")
    runs = e.select(rid, F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("target")).distinct().withColumn(
        "started", F.col("run_id"))
    cwe = lookup({"R1": "CWE-862", "R2": "CWE-863"}, F.col("rule_id"))
    found = view(spark, sf, "findings").select(
        F.concat(F.lit("run"), F.col("ordinal2").cast("string")).alias("run_id"), cwe.alias("cwe"))
    losses = e.filter("event_type = 'error' AND event_id % 9 = 0").select(rid, F.lit("run_aborted").alias("kind"))
    return ledger.run_catalogue(runs, found, losses, target="T")


@query("""SELECT 'd' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes, source FROM documents""")
def evidence_hashes(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), "source")
    return S.require_unique_paths(S.evidence(d, F.col("source")))
