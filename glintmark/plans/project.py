"""The quality plan: source files in, dimension scores and composite out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.functions.paths import bare_type, module_name
from glintmark.operators import analyzers, matching, quality
from glintmark.operators.graph import cyclic_components
from glintmark.session import settle


def reference_edges(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, source, target) references of analysed files: imports, base classes, parameter and return types.

    With ``by``, one job serves many projects and names resolve inside their own project.
    """
    by = by or []
    m = settle(metrics.select(*by, "path", "imports", "symbols").withColumn("module", module_name(F.col("path"))), "modules")
    imports = m.select(*by, "module", F.explode("imports").alias("imported"))
    resolved = matching.resolve_imports(imports, m.select(*by, "module"), by)
    symbols = m.select(*by, "module", F.explode("symbols").alias("s")).select(*by, "module", "s.*")
    types = F.concat(
        F.when(F.col("kind") == "class", F.col("bases")).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("params", lambda p: F.contains(p, F.lit(": "))),
                    lambda p: F.regexp_replace(p, r"(?s)^.*?: ", "")),
        F.when(F.col("return_type") != "", F.array("return_type")).otherwise(F.array().cast("array<string>")),
    )
    uses = symbols.select(*by, F.col("qname").alias("source"), "module", F.explode(types).alias("t")).select(
        *by, "source", "module", bare_type(F.col("t")).alias("type_name"))
    typed = matching.resolve_type_names(uses, resolved, symbols.select(*by, "qname"), by)
    return resolved.select(*by, F.col("module").alias("source"), "target").unionByName(typed.select(*by, "source", "target")).distinct()


def reference_cycles(edges: DataFrame, by: str = "project") -> DataFrame:
    """(by, node, component) of the cycles inside each project, found in one job."""
    name = lambda c: F.concat_ws("\n", by, c)
    found = cyclic_components(edges.select(name("source").alias("source"), name("target").alias("target")), "source", "target")
    part = lambda c, i: F.split(c, "\n")[i]
    return found.select(part("node", 0).alias(by), part("node", 1).alias("node"), part("component", 1).alias("component"))


def score_files(files: DataFrame, linter: DataFrame | None = None, complexity: DataFrame | None = None,
                profile: str = "production", with_graph: bool = True) -> tuple[DataFrame, DataFrame]:
    """(dimension scores, composite) of the files (path, text) of one project, or of each ``project`` if there is such a column."""
    known = "project" in files.columns
    metrics = settle(analyzers.file_metrics(files, ["project"] if known else []), "metrics")
    table = metrics if known else metrics.withColumn("project", F.lit("project"))
    edges = components = None
    if with_graph:
        edges = settle(reference_edges(table, ["project"]), "references")
        components = reference_cycles(edges)
    scores = quality.dimension_scores(quality.project_rollup(table, edges, components), linter, complexity)
    return scores, quality.composite_index(scores, profile=profile)
