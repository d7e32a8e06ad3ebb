"""Ground truth: side-car specs, label files, baseline manifests, expected documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of a side-car spec.
_SPEC_KEYS = {"cwe", "expect", "severity", "evidence_contains", "notes"}
SPEC_SCHEMA = (
    "doc string, cwe string, expect string, severity string, evidence_contains array<string>, notes string, "
    "error string"
)
LABEL_SCHEMA = (
    "doc string, cwe string, language string, file string, line int, cwe_id string, label string, "
    "description string"
)
BASELINE_SCHEMA = (
    "doc string, cwe string, name string, min_findings int, pos int, file string, evidence_contains array<string>, "
    "golden map<string,struct<pass:boolean,findings:int>>"
)


def _load(text: str):
    import yaml

    return yaml.safe_load(text)


def _each_text(parse: Callable[[str, str], list[dict]], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for doc, text in zip(batch["doc"], batch["value"]) for row in parse(doc, text)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _columns(schema: str) -> list[str]:
    names, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += ch
    return names


def _spec(doc: str, text: str) -> list[dict]:
    row = dict.fromkeys(_columns(SPEC_SCHEMA))
    row["doc"] = doc
    try:
        raw = _load(text)
        if not isinstance(raw, dict) or set(raw) - _SPEC_KEYS:
            raise ValueError("unknown keys or no mapping")
        if not isinstance(raw.get("cwe"), str) or not raw["cwe"] or raw.get("expect") not in ("found", "not_found"):
            raise ValueError("cwe or expect is invalid")
        words = raw.get("evidence_contains", [])
        if not isinstance(words, list) or not all(isinstance(w, str) for w in words):
            raise ValueError("evidence_contains is no list of texts")
        row.update(cwe=raw["cwe"], expect=raw["expect"], severity=raw.get("severity"), evidence_contains=words,
                   notes=raw.get("notes"))
    except Exception as exc:
        row["error"] = f"{type(exc).__name__}: {exc}"
    return [row]


def specs(texts: DataFrame, cwes: list[str] | None = None) -> DataFrame:
    """(doc, value) of side-car specs to rows; an invalid spec keeps only its ``error``."""
    out = texts.mapInPandas(_each_text(_spec, _columns(SPEC_SCHEMA)), SPEC_SCHEMA)
    return out.filter(F.col("error").isNotNull() | F.col("cwe").isin(cwes)) if cwes else out


def valid_specs(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NULL").drop("error")


def _labels(doc: str, text: str) -> list[dict]:
    raw = _load(text) or {}
    cwe = str(raw.get("cwe", ""))
    return [
        {"doc": doc, "cwe": cwe, "language": raw.get("language", ""), "file": f["file"], "line": f["line"],
         "cwe_id": f.get("cwe_id", f"CWE-{cwe}"), "label": f["label"], "description": f.get("description", "")}
        for f in raw.get("findings", [])
    ]


def labels(texts: DataFrame) -> DataFrame:
    """(doc, value) of label files to one row per labelled place."""
    return texts.mapInPandas(_each_text(_labels, _columns(LABEL_SCHEMA)), LABEL_SCHEMA)


def _baseline(doc: str, text: str) -> list[dict]:
    raw = (_load(text) or {}).get("cwes", {})
    items = raw.items() if isinstance(raw, dict) else [(c["cwe"], c) for c in raw]
    rows = []
    for cwe, entry in items:
        golden = {k: (bool(v.get("pass")), int(v.get("findings", 0))) for k, v in (entry.get("golden") or {}).items()}
        for pos, expected in enumerate(entry.get("expected") or [{}]):
            rows.append({"doc": doc, "cwe": str(cwe), "name": entry.get("name", ""),
                         "min_findings": entry.get("min_findings", 1), "pos": pos, "file": expected.get("file"),
                         "evidence_contains": expected.get("evidence_contains", []), "golden": golden})
    return rows


def baselines(texts: DataFrame) -> DataFrame:
    """(doc, value) of baseline or golden manifests to one row per expected file."""
    return texts.mapInPandas(_each_text(_baseline, _columns(BASELINE_SCHEMA)), BASELINE_SCHEMA)


def expected_locations(results: DataFrame) -> DataFrame:
    """(doc, rule_id, file, line) of the flattened results of expected documents; results with a place only."""
    return results.filter("NOT location_unresolved").select("doc", "rule_id", "file", "line")
