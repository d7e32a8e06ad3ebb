"""Source-file metrics from syntax nodes, and bulk scoring by user functions: the only Python that runs per row.

A small user function turns a file into rows, one per syntax node of interest, with names and types as written in the
source; everything that is counted, compared or listed is then a Spark aggregation over these rows. A file that cannot
be read in any way gives one row of kind ``Rejected`` and never ends the job.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# Calls that count as unsafe.
_UNSAFE_CALLS = {
    "eval": "CWE-94: Code injection via eval()",
    "exec": "CWE-94: Code injection via exec()",
    "compile": "CWE-94: compile() with exec mode",
    "__import__": "CWE-94: Dynamic import",
    "os.system": "CWE-78: OS command injection via os.system()",
    "os.popen": "CWE-78: OS command injection via os.popen()",
    "pickle.loads": "CWE-502: Deserialization via pickle.loads()",
    "pickle.load": "CWE-502: Deserialization via pickle.load()",
    "marshal.loads": "CWE-502: Deserialization via marshal.loads()",
    "yaml.load": "CWE-502: yaml.load() without SafeLoader",
    "shelve.open": "CWE-502: shelve.open() uses pickle internally",
    "jsonpickle.decode": "CWE-502: jsonpickle.decode() deserializes arbitrary objects",
}
_SHELL = "CWE-78: subprocess with shell=True"

_NODE = pa.schema([
    ("file", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
    ("line", pa.int32()), ("end_line", pa.int32()), ("blocks", pa.int32()), ("owners", pa.list_(pa.string())), ("scope", pa.list_(pa.string())),
    ("documented", pa.bool_()), ("params", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))), ("returns", pa.string()),
    ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())), ("body", pa.list_(pa.string())), ("keywords", pa.list_(pa.string()))])
_DEFS = ["FunctionDef", "AsyncFunctionDef"]
_BLOCKS = ["If", "For", "While", "With", "Try", "AsyncFor", "AsyncWith"]
_DOTTED = re.compile(r"[^\W\d]\w*(\s*\.\s*[^\W\d]\w*)*")


class _Source:
    """Text of a node as written."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "replace")
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw))]

    def text(self, node: ast.AST | None) -> str:
        if node is None:
            return ""
        begin = self.starts[node.lineno - 1] + node.col_offset
        end = self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.raw[begin:end].decode("utf-8", "replace")

    def dotted(self, node: ast.AST) -> str:
        """A dotted name, of a call the name that is called; empty for any other expression."""
        written = self.text(node.func if isinstance(node, ast.Call) else node)
        return re.sub(r"\s", "", written) if _DOTTED.fullmatch(written) else ""


def python_nodes(text: str) -> Iterator[dict]:
    """The module, definitions, imports, handlers, blocks and calls of a Python file, in source order, without recursion."""
    tree, source = ast.parse(text), _Source(text)
    yield {"kind": "Module", "end_line": text.count("\n") + (not text.endswith("\n") if text else 0)}
    stack = [(node, 0, ["Module"], []) for node in reversed(tree.body)]
    while stack:
        node, blocks, owners, scope = stack.pop()
        kind = type(node).__name__
        row = {"kind": kind, "line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None), "blocks": blocks, "owners": owners, "scope": scope}
        if kind in _DEFS or kind == "ClassDef":
            row |= {"name": node.name, "documented": bool(ast.get_docstring(node)), "decorators": [source.dotted(d) for d in node.decorator_list]}
            if kind == "ClassDef":
                row["bases"] = [source.dotted(b) for b in node.bases]
            else:
                row |= {"params": [{"name": a.arg, "type": source.text(a.annotation)} for a in node.args.args], "returns": source.text(node.returns)}
            yield row
            scope = [*scope, node.name]
        elif kind == "Import":
            yield from ({**row, "name": a.name} for a in node.names)
        elif kind == "ImportFrom":
            yield row | {"name": node.module}
        elif kind == "ExceptHandler":
            yield row | {"name": source.text(node.type), "body": [type(n).__name__ for n in node.body]}
        elif kind == "Call":
            yield row | {"name": source.dotted(node), "keywords": [f"{k.arg}={source.text(k.value)}" for k in node.keywords if k.arg]}
        elif kind in _BLOCKS:
            yield row
        if isinstance(node, ast.stmt):
            owners = [kind, *owners[:1]]
        blocks += kind in _BLOCKS
        stack.extend((child, blocks, owners, scope) for child in reversed(list(ast.iter_child_nodes(node))))


Nodes = Callable[[str], Iterator[dict]]
_READERS: dict[str, tuple[str, Nodes]] = {".py": ("python", python_nodes)}


def register_reader(extension: str, language: str, nodes: Nodes) -> None:
    """Add a function text -> node rows for files with this extension; missing fields are null."""
    _READERS[extension] = (language, nodes)


# Files whose text, and nodes whose rows, exist as Python objects at once.
_FILES, _ROWS = 32, 2048


def _few_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, which may hold thousands of files, as Python objects of a few files at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _FILES):
            yield from batch.slice(at, _FILES).to_pylist()


def syntax_nodes(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Node rows of every file (path, text) with a known extension: ``file`` (number of the input row), ``path``, ``language``, the node, and the text columns ``keep``."""
    from glintmark.functions.paths import extension

    readers, keep = dict(_READERS), keep or []
    schema = pa.schema([*_NODE, *((c, pa.string()) for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in _few_at_once(batches):
            language, nodes = readers[row["ext"]]
            try:
                own = list(nodes(row["text"]))
            except Exception as exc:  # any file may be hostile; what is wrong with it is data
                own = [{"kind": "Rejected", "name": type(exc).__name__}]
            rows += [{"file": row["file"], "path": row["path"], "language": language, "seq": i, **{c: row[c] for c in keep}, **r} for i, r in enumerate(own)]
            if len(rows) > _ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = files.select(F.monotonically_increasing_id().alias("file"), "path", "text", *keep, extension(F.col("path")).alias("ext")).filter(
        F.col("ext").isin(list(readers)) & F.col("text").isNotNull())
    return known.mapInArrow(run, from_arrow_schema(schema))


def rejected_files(files: DataFrame) -> DataFrame:
    """``path`` and ``reason`` of the files that have no metrics because they cannot be read."""
    return syntax_nodes(files).filter("kind = 'Rejected'").select("path", F.col("name").alias("reason"))


def _listed(when: Column, value: Column) -> Column:
    """Values of the rows where ``when`` holds, in source order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col("seq"), value.alias("v"))))), lambda s: s["v"])


def file_metrics(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Metrics and symbols of every file (path, text) that a reader knows and can read; others have no row.

    Text columns named in ``keep``, such as the project, stay with their file.

    All nodes of a file come out of one task, so the aggregation sends one row per file.
    """
    from glintmark.functions.paths import module_name

    c = F.col
    function, klass = c("kind").isin(_DEFS), c("kind") == "ClassDef"
    named = function | klass
    private = c("name").startswith("_") & (klass | ~c("name").startswith("__"))
    odd_name = F.when(klass, c("name").rlike(r"^\p{Ll}")).otherwise(c("name").rlike(r"^.+\p{Lu}") & ~F.contains("name", F.lit("_")))
    typed = F.filter("params", lambda p: p["type"] != "")
    handler = c("kind") == "ExceptHandler"
    known = F.create_map(*[F.lit(x) for pair in _UNSAFE_CALLS.items() for x in pair])
    shell = c("name").rlike(r"^subprocess\.\w+$") & F.array_contains("keywords", "shell=True")
    note = F.when(c("kind") == "Call", F.coalesce(F.try_element_at(known, c("name")), F.when(shell, F.lit(_SHELL))))
    top = F.element_at("owners", 1) == "Module"
    method = function & (F.element_at("owners", 1) == "ClassDef") & (F.element_at("owners", 2) == "Module")
    kept = F.when(method, F.filter("params", lambda p: ~p["name"].isin("self", "cls"))).otherwise(c("params"))
    module = module_name(c("path"))
    parent = F.concat_ws(".", module, "scope")
    symbol = F.struct(
        F.concat_ws(".", parent, "name").alias("qname"), parent.alias("parent_qname"), c("name"),
        F.when(klass, "class").when(method, "method").otherwise("function").alias("kind"), c("line"), c("end_line"),
        F.coalesce(F.transform(kept, lambda p: F.when(p["type"] != "", F.concat_ws(": ", p["name"], p["type"])).otherwise(p["name"])), F.array().cast("array<string>")).alias("params"),
        F.coalesce("returns", F.lit("")).alias("return_type"),
        F.coalesce(F.array_remove("bases", ""), F.array().cast("array<string>")).alias("bases"), F.array_remove("decorators", "").alias("decorators"))

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("int")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("int")

    keep = keep or []
    nodes = syntax_nodes(files, keep).filter("kind <> 'Rejected'")
    out = nodes.groupBy("file", *keep, "path", "language").agg(
        F.max(F.when(c("kind") == "Module", c("end_line"))).alias("lines"), count(function).alias("functions"), count(klass).alias("classes"),
        F.lit(0).alias("methods"), count(named & c("documented")).alias("documented_callables"), count(named).alias("total_callables"),
        total(F.size(typed) * function.cast("int")).alias("annotated_params"), total(F.when(function, F.size("params"))).alias("total_params"),
        count(function & (c("returns") != "")).alias("annotated_returns"), count(function).alias("total_returns"),
        count(handler).alias("exception_handlers"),
        (count(handler & (c("name") == "")) + count(handler & (c("body") == F.array(F.lit("Pass"))))).alias("bare_excepts"),
        count(handler & c("name").isin("Exception", "BaseException")).alias("broad_excepts"),
        F.coalesce(F.max(F.when(c("kind").isin(_BLOCKS), c("blocks") + 1)), F.lit(0)).alias("max_nesting"),
        count(named & odd_name).alias("naming_violations"), count(named & ~private).alias("public_definitions"), count(named & private).alias("private_definitions"),
        F.lit(0).alias("null_forgiving_count"), F.lit(0).alias("sealed_classes"),
        _listed(function, c("end_line") - c("line") + 1).alias("function_lengths"),
        _listed(note.isNotNull(), F.concat(F.lit("line "), c("line").cast("string"), F.lit(": "), note)).alias("unsafe_calls"),
        F.lit(False).alias("nullable_enabled"), _listed(c("kind").isin("Import", "ImportFrom") & top & c("name").isNotNull(), c("name")).alias("imports"),
        _listed(named & (top | method), symbol).alias("symbols"))
    return out.drop("file")


def bulk_score(items: DataFrame, scorer: Callable[[dict], object], value: str, workers: int = 1,
               fatal: Callable[[Exception], bool] = lambda exc: False) -> DataFrame:
    """Call a user function per row, at most ``workers`` calls at a time in each task; a failure fills ``error`` of its own row only.

    Adds ``value`` (text), ``error`` and ``error_type``. An exception ``fatal`` accepts ends the job. The partitions of
    ``items`` are left as they are.
    """
    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema += f", `{value}` string, error string, error_type string"

    def call(row: dict) -> tuple[str | None, str | None, str | None]:
        try:
            got = scorer(row)
        except Exception as exc:
            if fatal(exc):
                raise
            return None, str(exc), type(exc).__name__
        return None if got is None else str(got), None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                out = pd.DataFrame(list(pool.map(call, batch.to_dict("records"))), columns=[value, "error", "error_type"], index=batch.index, dtype=object)
                yield pd.concat([batch[names], out], axis=1)

    return items.mapInPandas(run, schema)
