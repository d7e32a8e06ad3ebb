"""Rules over lines of text, file size and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.needed import needed_words
from glintmark.functions.text import fold_case, has_word, lines_of, strip

_STRING_START = r"""(?iu)^(f|r|b|rb|br|fr|rf)?['"]"""


def _violation(rule: tuple, path: Column, line: Column, lower: Column) -> Column:
    """Violation of one rule or null. Cheap tests come first: the path, a word the pattern needs."""
    code, severity, prefix, pattern, exception, skip_comment, skip_string, message = rule
    hit = path.startswith(prefix) if prefix else F.lit(True)
    words = needed_words(pattern)
    if words:
        hit = hit & has_word(lower, words)
    hit = hit & line.rlike(pattern)
    for part in K.LINE_RULE_EXEMPT_PARTS.get(code, []):
        hit = hit & ~path.contains(part)
    for ending in K.LINE_RULE_EXEMPT_ENDINGS.get(code, []):
        hit = hit & ~path.endswith(ending)
    if exception:
        hit = hit & ~line.rlike(exception)
    if skip_comment:
        hit = hit & ~strip(line).startswith("#")
    if skip_string:
        hit = hit & ~strip(line).rlike(_STRING_START)
    return F.when(hit, F.struct(F.lit(code).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def line_rules(files: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(path, line, rule, severity, message) of every line that breaks a rule; one pass over the lines."""
    lines = files.select("path", F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))
    lines = lines.withColumn("lower", fold_case(F.col("text")))
    found = F.array_compact(F.array(*[
        _violation(r, F.col("path"), F.col("text"), F.col("lower")) for r in rules or K.LINE_RULES]))
    return lines.select("path", (F.col("pos") + 1).alias("line"), F.explode(found).alias("v")).select(
        "path", "line", "v.rule", "v.severity", "v.message"
    )


def large_files(files: DataFrame, rule: tuple = K.FILE_SIZE_RULE) -> DataFrame:
    """Files with more lines than allowed."""
    code, severity, prefix, limit = rule
    n = F.size(lines_of(F.col("text")))
    return files.filter(F.col("path").startswith(prefix)).select(
        "path", F.lit(1).alias("line"), F.lit(code).alias("rule"), F.lit(severity).alias("severity"), n.alias("n_lines")
    ).filter(F.col("n_lines") > limit)


def unknown_codes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """CWE numbers mentioned in the files but absent from the registry, each with its first file."""
    codes = files.select(
        "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"CWE-(\d+)"), F.lit(1)))).alias("code")
    )
    return (
        codes.join(registry.select(F.col("cwe_id").alias("code")), "code", "left_anti")
        .groupBy("code").agg(F.min("path").alias("first_path"))
    )


def rules_without_tests(paths: DataFrame, suffixes: list[str] = [".py", ".cs", ".dockerfile"]) -> DataFrame:
    """Rule files (.yaml) without a file of the same stem and a test suffix."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    is_test = F.lit(False)
    for s in suffixes:
        is_test = is_test | F.col("path").endswith(s)
    tests = paths.filter(is_test).select(stem.alias("_stem")).distinct()
    return paths.filter(F.col("path").endswith(".yaml")).withColumn("_stem", stem).join(
        tests, "_stem", "left_anti").select("path")

