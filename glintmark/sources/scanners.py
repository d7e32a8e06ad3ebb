"""JSON outputs of scanners that do not write findings documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.levels import advisory_level
from glintmark.functions.paths import is_linter_test_path
from glintmark.functions.tags import CWE_TAG
from glintmark.operators.prefix import index_percentile

# Fields of the scanner outputs.
_AUDIT = (
    "struct<dependencies:array<struct<name:string,version:string,"
    "vulns:array<struct<id:string,fix_versions:array<string>,description:string>>>>>"
)
_PACKAGE = (
    "array<struct<id:string,resolvedVersion:string,"
    "vulnerabilities:array<struct<severity:string,advisoryurl:string>>>>"
)
_NUGET = (
    "struct<projects:array<struct<path:string,frameworks:array<struct<framework:string,"
    f"topLevelPackages:{_PACKAGE},transitivePackages:{_PACKAGE}>>>>>"
)
_LINTER = (
    "struct<results:array<struct<test_id:string,issue_severity:string,issue_confidence:string,"
    "issue_text:string,filename:string,line_number:int>>,metrics:map<string,struct<loc:bigint>>>"
)
_FUNCTIONS = "array<struct<type:string,name:string,complexity:int,rank:string,lineno:int>>"
_BY_FILE = "map<string,string>"
EDGE_SCHEMA = "caller string, callee string, file string, line int, isVirtual boolean, isExtension boolean"
_TEST_NOISE = ["B101"]
_DEPENDENCY_TAGS = ["security", "sca", CWE_TAG + K.DEPENDENCY_CWE]


def dependency_audit(texts: DataFrame) -> DataFrame:
    """Python dependency audit (doc, value) to findings; the file is the name of the input."""
    d = texts.select("doc", F.explode(F.from_json("value", _AUDIT)["dependencies"]).alias("d"))
    v = d.select(
        "doc", F.coalesce("d.name", F.lit("unknown")).alias("package"),
        F.coalesce("d.version", F.lit("unknown")).alias("version"), F.explode("d.vulns").alias("v"),
    )
    vuln = F.coalesce("v.id", F.lit("UNKNOWN"))
    fixes = F.array_join("v.fix_versions", ", ")
    fix = F.when(F.size("v.fix_versions") > 0, F.concat(F.lit(" Fix: upgrade to "), fixes)).otherwise(F.lit(""))
    return v.select(
        "doc", F.lit("pip-audit").alias("tool"), F.concat(F.lit("SCA-"), vuln).alias("rule_id"),
        F.lit("warning").alias("level"),
        F.concat("package", F.lit("=="), "version", F.lit(" has known vulnerability "), vuln, F.lit("."), fix)
        .alias("message"),
        F.substring_index("doc", "/", -1).alias("file"), F.lit(1).alias("line"),
        F.concat(F.lit("Vulnerable dependency: "), "package").alias("rule_title"),
        F.array(*[F.lit(t) for t in _DEPENDENCY_TAGS]).alias("rule_tags"),
    )


def package_advisories(texts: DataFrame) -> DataFrame:
    """NuGet advisories (doc, value) to findings."""
    none = F.array().cast(_PACKAGE)
    p = texts.select("doc", F.explode(F.from_json("value", _NUGET)["projects"]).alias("p"))
    f = p.select("doc", F.coalesce("p.path", F.lit("unknown.csproj")).alias("file"),
                 F.explode("p.frameworks").alias("f"))
    k = f.select("doc", "file", F.explode(F.concat(F.coalesce("f.topLevelPackages", none),
                                                   F.coalesce("f.transitivePackages", none))).alias("k"))
    v = k.select("doc", "file", F.coalesce("k.id", F.lit("unknown")).alias("package"),
                 F.coalesce("k.resolvedVersion", F.lit("unknown")).alias("version"),
                 F.explode("k.vulnerabilities").alias("v"))
    severity = F.coalesce("v.severity", F.lit("Unknown"))
    url = F.coalesce("v.advisoryurl", F.lit(""))
    return v.select(
        "doc", F.lit("dotnet-vuln").alias("tool"), F.concat(F.lit("SCA-NUGET-"), "package").alias("rule_id"),
        advisory_level(severity).alias("level"),
        F.concat("package", F.lit("@"), "version", F.lit(" has a "), severity, F.lit(" vulnerability. See "), url)
        .alias("message"),
        "file", F.lit(1).alias("line"),
        F.concat(F.lit("Vulnerable NuGet package: "), "package").alias("rule_title"),
        F.array(*[F.lit(t) for t in _DEPENDENCY_TAGS]).alias("rule_tags"),
    )


def linter_findings(texts: DataFrame) -> DataFrame:
    """Linter results (doc, value) without the assert rule in test files."""
    r = texts.select("doc", F.explode(F.from_json("value", _LINTER)["results"]).alias("r"))
    rows = r.select(
        "doc", F.coalesce("r.test_id", F.lit("")).alias("rule_id"),
        F.coalesce("r.issue_severity", F.lit("LOW")).alias("severity"),
        F.coalesce("r.issue_confidence", F.lit("LOW")).alias("confidence"),
        F.coalesce("r.issue_text", F.lit("")).alias("message"),
        F.coalesce("r.filename", F.lit("")).alias("file"), F.coalesce("r.line_number", F.lit(0)).alias("line"),
    )
    return rows.filter(~(F.col("rule_id").isin(_TEST_NOISE) & is_linter_test_path(F.col("file"))))


def linter_metrics(texts: DataFrame, key: str = "doc") -> DataFrame:
    """Severity counts and their weighted density per 1000 lines (at least 0.1)."""
    loc = texts.select(
        key,
        F.aggregate(F.map_values(F.from_json("value", _LINTER)["metrics"]), F.lit(0).cast("bigint"),
                    lambda a, m: a + F.coalesce(m["loc"], F.lit(0))).alias("loc"),
    ).groupBy(key).agg(F.sum(F.coalesce("loc", F.lit(0))).alias("total_loc"))
    named = lambda s: F.count_if(F.col("severity") == s)
    found = linter_findings(texts).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), named("HIGH").alias("h"), named("MEDIUM").alias("m"), named("LOW").alias("l")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    weighted = zero("h") * 3 + zero("m") * 2 + zero("l")
    return loc.join(found, key, "left").select(
        key, zero("n").alias("total_findings"), zero("h").alias("high_severity"),
        zero("m").alias("medium_severity"), zero("l").alias("low_severity"), weighted.alias("weighted_findings"),
        (weighted / F.greatest(F.col("total_loc") / 1000.0, F.lit(0.1))).alias("weighted_per_kloc"), "total_loc",
    )


def complexity_rows(texts: DataFrame) -> DataFrame:
    """One row per function of a complexity report (doc, value)."""
    files = texts.select("doc", F.explode(F.from_json("value", _BY_FILE)).alias("file", "functions"))
    f = files.select("doc", "file", F.explode(F.from_json("functions", _FUNCTIONS)).alias("f"))
    return f.select(
        "doc", "file", F.coalesce("f.name", F.lit("?")).alias("name"),
        F.coalesce("f.type", F.lit("function")).alias("type"),
        F.coalesce("f.complexity", F.lit(0)).alias("complexity"), F.coalesce("f.rank", F.lit("A")).alias("rank"),
        F.coalesce("f.lineno", F.lit(0)).alias("line"),
    )


def complexity_findings(rows: DataFrame) -> DataFrame:
    """Findings for functions ranked C or worse."""
    return rows.filter(~F.col("rank").isin("A", "B")).select(
        "doc", F.concat(F.lit("CC:"), "rank").alias("rule_id"),
        F.when(F.col("rank").isin("E", "F"), F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.concat("type", F.lit(" '"), "name", F.lit("' has CC "), F.col("complexity").cast("string"),
                 F.lit(" (rank "), "rank", F.lit(")")).alias("message"),
        "file", "line",
    )


def complexity_metrics(rows: DataFrame, key: str = "doc") -> DataFrame:
    """Average, maximum and 90th element of complexity, rank counts, share of simple functions."""
    ranks = [F.count_if(F.col("rank") == r).alias(f"rank_{r}") for r in "ABCDEF"]
    p90 = index_percentile(rows, [key], "complexity", 0.9, "p90_complexity")
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("total_functions"), F.avg("complexity").alias("avg_complexity"),
             F.max("complexity").alias("max_complexity"), *ranks)
        .join(p90, key)
        .withColumn("simple_ratio", (F.col("rank_A") + F.col("rank_B")) / F.col("total_functions"))
    )


def maintainability_metrics(texts: DataFrame, key: str = "doc") -> DataFrame:
    """Average and minimum maintainability index."""
    rows = texts.select(key, F.explode(F.from_json("value", _BY_FILE)).alias("file", "m"))
    mi = F.coalesce(F.from_json("m", "struct<mi:double>")["mi"], F.lit(0.0))
    return rows.filter(F.col("m").startswith("{")).groupBy(key).agg(F.avg(mi).alias("avg_mi"), F.min(mi).alias("min_mi"))


def call_edges(records: DataFrame) -> DataFrame:
    """Call records to edges with kind and confidence."""
    kind = (
        F.when(F.coalesce("isExtension", F.lit(False)), F.lit("extension"))
        .when(F.coalesce("isVirtual", F.lit(False)), F.lit("virtual"))
        .otherwise(F.lit("direct"))
    )
    return records.withColumn("kind", kind).select(
        "caller", "callee", "file", "line",
        F.when(F.col("kind") == "direct", F.lit(0.9)).otherwise(F.lit(0.7)).alias("confidence"), "kind",
    )


def read_call_edges(spark: SparkSession, path: str, array_files: bool = True) -> DataFrame:
    """Edges from JSON files that hold one array each, or one record per line."""
    return call_edges(spark.read.schema(EDGE_SCHEMA).option("multiLine", array_files).json(path))
