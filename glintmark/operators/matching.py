"""Joins on paths, names, patterns, places and words, each turned into an equi join or an expression."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.levels import lookup
from glintmark.functions.paths import base_name
from glintmark.functions.text import context_window, glob_regex, lines_of
from glintmark.sources.dimensions import sink_patterns

# Prices of a token have nine decimals, and so have all sums of them: no order of adding changes a total.
PRICE, MONEY = "decimal(10,9)", "decimal(28,9)"


def _hits(pairs: list[tuple[Column, str]]) -> Column:
    """Labels whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def last_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def sink_calls(edges: DataFrame) -> DataFrame:
    """Edges whose callee matches a sink pattern, with the CWE (one row per edge and CWE).

    A pattern ends in a plain name, so callees meet their patterns on the last name first.
    """
    patterns = F.broadcast(sink_patterns(edges.sparkSession).select("cwe_id", "regex", "last").distinct())
    return (
        edges.withColumn("_last", last_name(F.col("callee")))
        .join(patterns, (F.col("_last") == F.col("last")) & F.expr("callee RLIKE regex"))
        .select(*edges.columns, "cwe_id")
        .distinct()
    )


def sink_symbols(symbols: DataFrame) -> DataFrame:
    """Local symbols tagged as sinks: the whole name matches, or the name equals a pattern's last name."""
    patterns = F.broadcast(sink_patterns(symbols.sparkSession).select("language", "cwe_id", "regex", "last"))
    same = symbols.alias("s").join(
        patterns.alias("p"),
        (F.col("s.language") == F.col("p.language")) & (F.col("s.name") == F.col("p.last")),
    )
    whole = symbols.alias("s").join(
        patterns.alias("p"),
        (F.col("s.language") == F.col("p.language"))
        & (last_name(F.col("s.qname")) == F.col("p.last"))
        & F.expr("s.qname RLIKE p.regex"),
    )
    return same.select("s.qname", "p.cwe_id").unionAll(whole.select("s.qname", "p.cwe_id")).distinct()


def is_entry_point(language: Column, decorators: Column, bases: Column) -> Column:
    """Entry point by decorator pattern (Python) or by decorator name or base class (C#)."""
    pattern = "|".join(f"(?:{glob_regex(p)})" for p in K.ENTRY_DECORATOR_PATTERNS)
    python = F.exists(decorators, lambda d: d.rlike(pattern))
    base_end = r"(^|\.)(" + "|".join(re.escape(b) for b in K.ENTRY_BASES) + r")\z"
    csharp = F.exists(decorators, lambda d: d.isin(K.ENTRY_DECORATOR_NAMES)) | F.exists(bases, lambda b: b.rlike(base_end))
    return F.coalesce(F.when(language == "csharp", csharp).when(language == "python", python), F.lit(False))


def _check_conditions(path: Column) -> list[tuple[Column, str]]:
    lower = F.lower(path)
    out = []
    for cwe, _, detection, types, _, _ in K.CWE_REGISTRY:
        if detection in K.MODEL_DETECTIONS:
            words = sorted({w for t in types for w in K.FILE_TYPE_WORDS.get(t, [t])})
            out.append((lower.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(True), cwe))
    return out


def checks_of_path(path: Column) -> Column:
    """Checks one of whose words occurs in the lowered path, as an array."""
    return _hits(_check_conditions(path))


def files_by_words(manifest: DataFrame) -> DataFrame:
    """(cwe_id, file) by path words; a check no file matches takes the files of weight 3 or more."""
    source = manifest.filter(F.col("language").isin(K.SOURCE_LANGUAGES)).select(
        "file", "weight", checks_of_path(F.col("file")).alias("hit")
    )
    matched = source.select(F.explode("hit").alias("cwe_id")).agg(F.collect_set("cwe_id")).scalar()
    every = F.array(*[F.lit(c) for _, c in _check_conditions(F.lit(""))])
    fallback = F.when(F.col("weight") >= K.FALLBACK_WEIGHT, F.array_except(every, matched))
    return source.select("file", F.explode(F.concat("hit", F.coalesce(fallback, F.array().cast("array<string>"))))
                         .alias("cwe_id")).select("cwe_id", "file")


def scanners_of_file(path: Column) -> Column:
    """Scanners that read a file of this name, as an array."""
    name = base_name(path)
    return _hits([
        (name.rlike("|".join(f"(?:{glob_regex(p)})" for p in ps)) if ps else F.lit(True), tool)
        for tool, ps, _ in K.SCANNERS
    ])


def applicable_scanners(manifest: DataFrame) -> DataFrame:
    """Scanners with at least one file to read."""
    return manifest.select(F.explode(scanners_of_file(F.col("file"))).alias("tool")).distinct()


def missing_scanners(manifest: DataFrame, available: DataFrame) -> DataFrame:
    """Loss rows for applicable scanners that are not available."""
    return applicable_scanners(manifest).join(available.select("tool"), "tool", "left_anti").select(
        F.lit("sast").alias("pass"), F.lit("tool_missing").alias("kind"), F.col("tool").alias("subject")
    )


def _suffixes(path: Column, mark: str) -> Column:
    """Proper suffixes of a path that start after ``mark``."""
    parts = F.split(path, re.escape(mark))
    return F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), mark),
    )


def resolve_paths(echoed: DataFrame, included: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Resolve an echoed path against the files given: same path, else unique suffix, else unique name.

    Every lookup is an equi join against one row per key: paths are expanded into their suffixes and
    counted, so files that share a name never meet the findings pair by pair.
    """
    given = included.select(*[F.col(b).alias(f"_i_{b}") for b in by], F.col("file").alias("_p")).distinct()
    same_group = [F.col(b).eqNullSafe(F.col(f"_i_{b}")) for b in by]
    group = [f"_i_{b}" for b in by]
    row = F.col("_row")
    rows = echoed.withColumn("_row", F.struct(*by, raw))
    cand = F.ltrim(F.col(raw), F.lit("./"))
    wanted = rows.select("_row", *by, cand.alias("_c"), base_name(cand).alias("_b")).filter(
        (F.coalesce(F.col(raw), F.lit("")) != "") & (F.col(raw) != "unknown")
    ).distinct()

    def lookup_by(key: Column, table: DataFrame, name: str) -> DataFrame:
        return wanted.join(table, same_group + [key == F.col("_key")]).select(
            row, F.col("_hit").alias(name), F.col("_n").alias(f"{name}_n"))

    exact = lookup_by(F.col("_c"), given.select(*group, F.col("_p").alias("_key"), F.col("_p").alias("_hit"),
                                                F.lit(1).alias("_n")), "exact")
    longer = (
        given.filter(F.contains("_p", F.lit("/")))
        .select(*group, "_p", F.explode(_suffixes(F.col("_p"), "/")).alias("_key"))
        .groupBy(*group, "_key").agg(F.min("_p").alias("_hit"), F.count(F.lit(1)).alias("_n"))
    )
    shorter = (
        wanted.filter(F.contains("_c", F.lit("/")))
        .select("_row", *by, F.explode(_suffixes(F.col("_c"), "/")).alias("_s"))
        .join(given, same_group + [F.col("_s") == F.col("_p")])
        .select("_row", F.col("_p").alias("suffix"), F.lit(1).cast("bigint").alias("suffix_n"))
    )
    suffix = (
        lookup_by(F.col("_c"), longer, "suffix").unionAll(shorter)
        .groupBy("_row").agg(F.min("suffix").alias("suffix"), F.sum("suffix_n").alias("suffix_n"))
    )
    names = given.groupBy(*group, base_name(F.col("_p")).alias("_key")).agg(
        F.min("_p").alias("_hit"), F.count(F.lit(1)).alias("_n"))
    name = lookup_by(F.col("_b"), names, "name")
    return (
        rows.join(exact, "_row", "left").join(suffix, "_row", "left").join(name, "_row", "left")
        .select(
            *echoed.columns,
            F.coalesce(
                "exact",
                F.when(F.col("suffix_n") == 1, F.col("suffix")),
                F.when(F.col("name_n") == 1, F.col("name")),
                F.lit("unknown"),
            ).alias("file"),
        )
    )


def file_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the given files, one row each, in the columns a check reads."""
    return files.join(findings, "file").select(
        *files.columns, "rule_id", "tool", "line", F.coalesce("level", F.lit("warning")).alias("level"), "message",
    )


def windows_around(findings: DataFrame, files: DataFrame, radius: int = 30) -> DataFrame:
    """Add the numbered lines around each finding. ``files`` has (file, text)."""
    lined = files.select("file", lines_of(F.col("text")).alias("_lines"))
    return findings.join(lined, "file").select(
        *findings.columns, context_window(F.col("_lines"), F.col("line"), radius).alias("context")
    )


def first_symbol_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(qname, file): symbols with their file, plus callers that no symbol defines with their edge's file."""
    own = symbols.groupBy("qname").agg(F.max_by("file", "ordinal").alias("file"))
    callers = edges.groupBy(F.col("caller").alias("qname")).agg(F.min_by("file", F.struct("ordinal", "file")).alias("file"))
    return own.unionByName(callers.join(own.select("qname"), "qname", "left_anti"))


def resolve_imports(imports: DataFrame, modules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, module, imported, target): the import itself or its parent, when known; parents of modules are known.

    ``by`` keeps projects apart: a name resolves inside its own project only.
    """
    by = by or []
    names = F.split("module", r"\.")
    known = modules.select(
        *by, F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), ".")))
        .alias("imported")
    ).distinct()
    asked = imports.withColumn("_parent", F.when(F.contains("imported", F.lit(".")), F.regexp_replace("imported", r"\.[^.]*$", "")))
    return (
        asked.join(known.withColumn("_known", F.col("imported")), [*by, "imported"], "left")
        .join(known.select(*by, F.col("imported").alias("_parent")).withColumn("_known_parent", F.col("_parent")), [*by, "_parent"], "left")
        .select(*by, "module", "imported", F.coalesce("_known", "_known_parent").alias("target"))
        .filter(F.col("target").isNotNull())
    )


def resolve_type_names(uses: DataFrame, imported: DataFrame, symbols: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, source, type_name, target): the module's import of that name, else the first symbol that ends so.

    A name in lower case never resolves. The symbol is the first in name order, so the result does not
    depend on the order of the files. ``uses`` has (by, source, module, type_name) with bare type names.
    """
    by = by or []
    alias = imported.groupBy(*by, "module", last_name(F.col("imported")).alias("type_name")).agg(
        F.max_by("target", "imported").alias("_by_import"))
    ends = (
        symbols.filter(F.contains("qname", F.lit(".")))
        .select(*by, "qname", F.explode(_suffixes(F.col("qname"), ".")).alias("type_name"))
        .groupBy(*by, "type_name").agg(F.min("qname").alias("_by_end"))
    )
    first = F.substring("type_name", 1, 1)
    usable = uses.filter((F.col("type_name") != "") & ~((first == F.lower(first)) & (first != F.upper(first))))
    return (
        usable.join(alias, [*by, "module", "type_name"], "left").join(ends, [*by, "type_name"], "left")
        .select(*by, "source", "type_name", F.coalesce("_by_import", "_by_end").alias("target"))
        .filter(F.col("target").isNotNull())
    )


def price_key(model: Column) -> Column:
    """Price key of ``provider:name``: alias, then the provider's own name for the model."""
    provider = F.substring_index(model, ":", 1)
    name = F.when(F.contains(model, F.lit(":")), F.regexp_replace(model, r"^[^:]*:", "")).otherwise(F.lit(""))
    canonical = F.coalesce(lookup(K.MODEL_ALIASES, name), name)
    own = {f"{p}:{m}": w for p, m, w in K.PROVIDER_MODELS}
    return F.concat(provider, F.lit(":"),
                    F.coalesce(lookup(own, F.concat(provider, F.lit(":"), canonical)), canonical))


def priced(calls: DataFrame, model: str = "model") -> DataFrame:
    """Add the resolved model and the cost of each call, an exact decimal; a call without a price fails the job."""
    key = price_key(F.col(model))
    no_price = F.raise_error(F.concat(F.lit("no price for "), F.col("model_resolved"))).cast(PRICE)
    rate = lambda i: F.coalesce(lookup({p[0]: Decimal(f"{p[i]:.9f}") for p in K.PRICES}, F.col("model_resolved")).cast(PRICE), no_price)
    cost = lambda n, i: F.col(n).cast("decimal(18,0)") * rate(i)
    return calls.withColumn("model_resolved", key).withColumn("cost_usd", (cost("tokens_in", 1) + cost("tokens_out", 2)).cast(MONEY))


def price_list(spark) -> DataFrame:
    """Every alias of every provider with its price key, and priced models no alias reaches."""
    from glintmark.sources import dimensions as D

    by_alias = (
        D.providers(spark).select("provider", F.explode(F.array(*[F.lit(a) for a in K.MODEL_ALIASES])).alias("alias"))
        .withColumn("price_key", price_key(F.concat("provider", F.lit(":"), "alias")))
    )
    routed = by_alias.join(F.broadcast(D.prices(spark)), "price_key", "left")
    direct = (
        D.prices(spark).join(by_alias.select("price_key"), "price_key", "left_anti")
        .select("price_key", F.substring_index("price_key", ":", 1).alias("provider"),
                F.lit(None).cast("string").alias("alias"), "price_in", "price_out")
    )
    return routed.select("provider", "alias", "price_key", "price_in", "price_out").unionByName(direct)
