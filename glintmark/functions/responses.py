"""Structure out of model response text: verdicts, findings, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions import tags as T
from glintmark.functions.text import first_chars, strip

_U = "(?U)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def json_part(text: Column) -> Column:
    """JSON candidate of a text: a fenced block, else the outer braces, else the outer brackets."""
    fenced = _found(text, r"```json\s*([\s\S]*?)```")
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return (
        F.when(fenced.isNotNull(), strip(fenced))
        .when(braces != "", braces)
        .when(brackets.contains('"'), brackets)
    )


def _variant(text: Column) -> Column:
    """The text as one JSON value, null when it is not exactly one."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def parse_verdicts(df: DataFrame, text: str = "text", default_confidence: float = 0.5, rationale_chars: int | None = K.ANSWER_CHARS) -> DataFrame:
    """Add ``verdict``, ``confidence``, ``rationale``, ``whole_rationale`` and ``parsed_as`` (json, text or null).

    ``rationale`` of a text answer has its first ``rationale_chars`` characters (None: all).

    A JSON answer counts only when all three fields are valid. The text fallback takes the first verdict
    word in the order confirmed, false positive, needs context, wherever it stands.
    """
    t = F.col(text)
    v = F.col("_json")
    first = "$.findings[0]"
    wrapped = _field(v, first, "variant").isNotNull()

    def pick(name: str) -> Column:
        return F.when(wrapped, _field(v, f"{first}.{name}")).otherwise(_field(v, f"$.{name}"))

    share = T.confidence_share(pick("confidence"))
    json_ok = (
        pick("verdict").isin(K.VERDICTS)
        & share.between(0.0, 1.0)
        & (F.length(strip(pick("rationale"))) > 0)
    )
    upper = F.upper(t)
    word = (
        F.when(upper.contains("CONFIRMED"), F.lit("CONFIRMED"))
        .when(upper.contains("FALSE_POSITIVE") | upper.contains("FALSE POSITIVE"), F.lit("FALSE_POSITIVE"))
        .when(upper.contains("NEEDS_CONTEXT") | upper.contains("NEEDS CONTEXT"), F.lit("NEEDS_CONTEXT"))
    )
    stated = T.confidence_share(F.nullif(F.regexp_extract(t, r"(?U)[Cc]onfidence[*:\s]*([0-9.]+)", 1), F.lit("")))
    whole = strip(F.coalesce(_found(t, r"(?sU)[Rr]ationale[:\s*]*\n?(.*)"), t))

    def reason(said: Column) -> Column:
        stated_or_word = F.when(F.length(said) > 0, said).otherwise(F.concat(F.lit("Verdict: "), word))
        return F.when(F.col("_by_json"), strip(pick("rationale"))).when(word.isNotNull(), stated_or_word)

    by_json = F.coalesce(json_ok, F.lit(False))
    return (
        df.withColumn("_json", _variant(json_part(t)))
        .withColumn("_by_json", by_json)
        .select(
            *df.columns,
            F.when(F.col("_by_json"), pick("verdict")).otherwise(word).alias("verdict"),
            F.when(F.col("_by_json"), share)
            .when(word.isNotNull(), F.coalesce(stated, F.lit(default_confidence)))
            .alias("confidence"),
            reason(strip(first_chars(whole, rationale_chars))).alias("rationale"),
            reason(whole).alias("whole_rationale"),
            F.when(F.col("_by_json"), F.lit("json")).when(word.isNotNull(), F.lit("text")).alias("parsed_as"),
        )
    )


# Headings at which a findings answer is split.
_SECTION = r"(?=#{1,3}\s+SR-|\*\*SR-|#{1,3}\s+Finding\s+\d)"
# Rule id of a section.
_RULE_ID = r"SR-[A-Z0-9]+-\d+"
# File of a section, most specific form first.
_FILE_FORMS = [
    r"(?U)\*?\*?[Ff]ile\*?\*?[*:\s]*`?([^\s`\n*]+\.\w+)`?",
    r"(?U)[Ff]ile[^\n]*?([^\s|`\n*]+/[^\s|`\n*]+\.\w+)",
    r"(?U)`([^\s`]+/[^\s`]+\.\w+)`",
]
# Fields of a finding in a JSON answer.
_JSON_FINDINGS = (
    "array<struct<rule_id:string,title:string,description:string,severity:string,priority:string,"
    "file_path:string,line_number:int,cwe_id:string,remediation:string,confidence:string,"
    "owasp_category:string,end_line:int,evidence:string>>"
)


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _valid(f: Column) -> Column:
    """A finding of a JSON answer has all its required fields."""
    ok = T.normal_severity(f["severity"]).isNotNull()
    for name in ("rule_id", "title", "description", "file_path", "remediation", "evidence"):
        ok = ok & _filled(f[name])
    for name in ("line_number", "end_line"):
        ok = ok & F.coalesce(f[name] >= 1, F.lit(True))
    return ok


def _normal(f: Column, cwe_digits: int | None) -> Column:
    return F.struct(
        T.normal_rule_id(f["rule_id"]).alias("rule_id"),
        f["title"].alias("title"),
        f["description"].alias("description"),
        T.normal_severity(f["severity"]).alias("severity"),
        T.normal_priority(f["priority"]).alias("priority"),
        f["file_path"].alias("file"),
        f["line_number"].alias("line"),
        T.normal_cwe(f["cwe_id"], cwe_digits).alias("cwe"),
        f["remediation"].alias("remediation"),
        T.confidence_word(f["confidence"]).alias("confidence"),
        T.owasp_category(f["owasp_category"]).alias("owasp"),
        f["end_line"].alias("end_line"),
        f["evidence"].alias("evidence"),
        f["description"].alias("whole_description"),
        f["evidence"].alias("whole_evidence"),
    )


def _section_finding(s: Column, cwe_digits: int | None, chars: int | None, loose_chars: int | None) -> Column:
    """Finding of one text section, null when it names no rule; texts are cut at ``chars``, evidence outside a code block at ``loose_chars``."""
    rule = _found(s, f"({_RULE_ID})")
    raw_title = _found(s, _U + _RULE_ID + r"\s*[·:\|—\-]+\s*(.*?)(?:\n|\z)")
    title = F.regexp_replace(raw_title, r"^[ *|—]+|[ *|—]+\z", "")
    title = F.when(_filled(title), title).otherwise(rule)
    severity = (
        F.when(s.rlike(r"(?U)\b(critical|CRITICAL)\b"), F.lit("CRITICAL"))
        .when(s.rlike(r"(?U)\b(high|HIGH)\b"), F.lit("HIGH"))
        .when(s.rlike(r"(?U)\b(low|LOW)\b"), F.lit("LOW"))
        .otherwise(F.lit("MEDIUM"))
    )
    file = F.coalesce(*[_found(s, p) for p in _FILE_FORMS], F.lit("unknown"))
    cwe = F.concat(F.lit("CWE-"), first_chars(_found(s, r"CWE-(\d+)"), cwe_digits))
    block = _found(s, r"(?sU)```\w*\n(.*?)```")
    evidence = F.when(block.isNotNull(), first_chars(strip(block), chars)).otherwise(strip(first_chars(s, loose_chars)))
    description = strip(first_chars(s, chars))
    whole = strip(F.coalesce(block, s))
    null = lambda kind: F.lit(None).cast(kind)
    return F.when(
        rule.isNotNull(),
        F.struct(
            T.normal_rule_id(rule).alias("rule_id"),
            title.alias("title"),
            F.when(_filled(description), description).otherwise(title).alias("description"),
            severity.alias("severity"),
            F.lit("MEDIUM").alias("priority"),
            file.alias("file"),
            null("int").alias("line"),
            cwe.alias("cwe"),
            F.lit("See finding description for remediation guidance.").alias("remediation"),
            F.lit("medium").alias("confidence"),
            null("string").alias("owasp"),
            null("int").alias("end_line"),
            F.when(_filled(evidence), evidence).otherwise(F.lit("See description.")).alias("evidence"),
            F.when(_filled(strip(s)), strip(s)).otherwise(title).alias("whole_description"),
            F.when(_filled(whole), whole).otherwise(F.lit("See description.")).alias("whole_evidence"),
        ),
    )


def parse_responses(df: DataFrame, text: str = "text", json_only: bool = False, cwe_digits: int | None = K.CWE_DIGITS,
                    chars: int | None = K.ANSWER_CHARS, loose_chars: int | None = K.LOOSE_EVIDENCE_CHARS) -> DataFrame:
    """Add ``findings`` (array of structs), ``parsed_as`` and ``parse_failed`` to a table of answers.

    A JSON object is taken when every finding in it is valid; otherwise the text is split at its finding
    headings. ``parse_failed`` marks an answer that holds text but no finding and no statement that there
    are none. ``json_only`` leaves out the text fallback. Description and evidence of a text section have their first
    ``chars`` (``loose_chars`` for evidence outside a code block) characters, a CWE number its first ``cwe_digits``; None
    keeps all. ``whole_description`` and ``whole_evidence`` are never cut.
    """
    t = F.col(text)
    items = F.col("_items")
    is_object = F.col("_json").isNotNull() & F.schema_of_variant(F.col("_json")).startswith("OBJECT")
    no_list = _field(F.col("_json"), "$.findings", "variant").isNull()
    json_ok = F.coalesce(is_object & (no_list | F.forall(items, _valid)), F.lit(False))
    from_json = F.transform(F.coalesce(items, F.array().cast(_JSON_FINDINGS)), lambda f: _normal(f, cwe_digits))
    from_text = F.filter(
        F.transform(F.filter(F.split(t, _SECTION), lambda s: strip(s) != ""), lambda s: _section_finding(s, cwe_digits, chars, loose_chars)),
        lambda f: f.isNotNull(),
    )
    lower = F.lower(t)
    clean = lower.contains("no issues") | lower.contains("no findings")
    out = (
        df.withColumn("_json", _variant(json_part(t)))
        .withColumn("_items", F.try_variant_get(F.col("_json"), "$.findings", _JSON_FINDINGS))
        .withColumn("_ok", json_ok)
    )
    if json_only:
        return out.select(
            *df.columns,
            F.when(F.col("_ok"), from_json).alias("findings"),
            F.when(F.col("_ok"), F.lit("json")).alias("parsed_as"),
            (~F.col("_ok")).alias("parse_failed"),
        )
    out = out.withColumn("findings", F.when(F.col("_ok"), from_json).otherwise(from_text))
    return out.select(
        *df.columns,
        "findings",
        F.when(F.col("_ok"), F.lit("json"))
        .when((F.size("findings") > 0) | clean | (strip(t) != ""), F.lit("text"))
        .alias("parsed_as"),
        (~F.col("_ok") & (F.size("findings") == 0) & ~clean).alias("parse_failed"),
    )


def finding_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding of ``parse_responses`` with its position."""
    return parsed.select(*keys, F.posexplode("findings").alias("pos", "f")).select(*keys, "pos", "f.*")


def _any_word(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def is_overflow(error: Column) -> Column:
    return _any_word(F.lower(error), K.OVERFLOW_WORDS)


def is_fatal(error: Column, error_type: Column) -> Column:
    return F.coalesce(error_type.isin(K.FATAL_TYPES), F.lit(False)) | _any_word(F.lower(error), K.FATAL_WORDS)


def outcome(error: Column, error_type: Column, n_findings: Column, parse_failed: Column) -> Column:
    """completed, retry, overflow or fatal of one work item; no result at all is a retry."""
    return (
        F.when(error.isNotNull() & is_fatal(error, error_type), F.lit("fatal"))
        .when(error.isNotNull() & is_overflow(error), F.lit("overflow"))
        .when(error.isNotNull() | n_findings.isNull(), F.lit("retry"))
        .when(n_findings > 0, F.lit("completed"))
        .when(parse_failed, F.lit("retry"))
        .otherwise(F.lit("completed"))
    )


def retry_file_count(result: Column, n_files: Column) -> Column:
    """Files of the second try: all on a retry, the first half (at least one) on an overflow."""
    half = F.greatest(F.lit(1).cast("bigint"), F.floor(n_files / 2))
    return F.when(result == "retry", n_files).when(result == "overflow", F.least(half, n_files))
