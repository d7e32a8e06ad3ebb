"""CWE tags and the field rules of model-made findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.text import once, strip

CWE_TAG = "external/cwe/cwe-"


def _digits(raw: Column) -> Column:
    """Number of a CWE reference as text, null when there is none."""
    first = lambda text, p: once(F.regexp_extract(text, p, 1), lambda x: F.nullif(x, F.lit("")))
    return once(strip(raw), lambda text: F.coalesce(*[first(text, p) for p in (r"CWE-(\d+)", r"external/cwe/cwe-(\d+)", r"^(\d+)$")]))


def bare_number(digits: Column) -> Column:
    """Digits without leading zeros; all zeros are 0."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def padded(digits: Column) -> Column:
    """At least three digits."""
    return once(bare_number(digits), lambda n: F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))


def cwe_tag(raw: Column) -> Column:
    """``external/cwe/cwe-NNN`` of a CWE reference, null when it is none."""
    return F.concat(F.lit(CWE_TAG), padded(_digits(raw)))


def normal_tags(tags: Column, related: Column | None = None) -> Column:
    """Other tags in their order, then the distinct CWE tags sorted; ``related`` adds CWE ids."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    codes = F.filter(F.transform(tags, cwe_tag), lambda t: t.isNotNull())
    if related is not None:
        more = F.filter(
            F.transform(F.coalesce(related, F.array().cast("array<string>")),
                        lambda r: cwe_tag(F.concat(F.lit("CWE-"), r))),
            lambda t: t.isNotNull(),
        )
        codes = F.concat(codes, more)
    others = F.filter(tags, lambda t: cwe_tag(t).isNull())
    return F.concat(others, F.array_sort(F.array_distinct(codes)))


def tag_number(tag: Column) -> Column:
    """Bare number of a normalised tag."""
    return bare_number(F.substring_index(tag, "-", -1))


def first_tag_number(tags: Column) -> Column:
    """Bare number of the first CWE tag of a list, null when there is none."""
    hits = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith(CWE_TAG))
    return tag_number(F.try_element_at(hits, F.lit(1)))


def normal_severity(value: Column) -> Column:
    """Upper-case severity word, null when it is not one."""
    return once(F.upper(strip(value)), lambda word: F.when(word.isin(list(K.SEVERITY_ORDER)), word))


def normal_priority(value: Column) -> Column:
    return once(F.upper(strip(value)), lambda word: (
        F.when(word == "INFORMATIONAL", F.lit("LOW"))
        .when(word.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), word)
        .otherwise(F.lit("MEDIUM"))
    ))


def normal_cwe(value: Column, digits: int | None = 5) -> Column:
    """``CWE-N`` from any text with a number, of which at most ``digits`` count (None: all); other text is kept, blank is null."""
    pattern = r"(\d+)" if digits is None else rf"(\d{{1,{digits}}})"
    named = lambda text: once(F.regexp_extract(text, pattern, 1), lambda n: F.when(n != "", F.concat(F.lit("CWE-"), n)).otherwise(text))
    return once(strip(value), lambda text: F.when(text != "", named(text)))


def normal_rule_id(value: Column) -> Column:
    """``SR-`` rule id, a trailing number padded to three digits."""
    pattern = r"^(SR-[A-Z]+-?)(\d+)$"
    return once(F.upper(strip(value)), lambda text: once(F.regexp_extract(text, pattern, 1), lambda head: (
        F.when(head != "", F.concat(head, padded(F.regexp_extract(text, pattern, 2))))
        .when(text.startswith("SR-"), text)
        .otherwise(F.concat(F.lit("SR-"), text))
    )))


def normal_config_rule_id(value: Column) -> Column:
    """``SR-CFG-NNN`` rule id; an id without a number is 001."""
    numbered = lambda text: once(
        F.regexp_extract(text, r"(\d+)$", 1), lambda tail: F.when(tail != "", padded(tail)).otherwise(F.lit("001")))
    return once(F.upper(strip(value)), lambda text: once(F.regexp_extract(text, r"^SR-CFG-?(\d+)$", 1), lambda own: (
        F.when(own != "", F.concat(F.lit("SR-CFG-"), padded(own)))
        .when(text.startswith("SR-CFG-"), text)
        .otherwise(F.concat(F.lit("SR-CFG-"), numbered(text)))
    )))


def confidence_share(value: Column) -> Column:
    """Confidence as a share; a number above one is a percentage."""
    return once(F.rtrim(strip(value), F.lit("%")).try_cast("double"), lambda number: F.when(number > 1.0, number / 100.0).otherwise(number))


def confidence_word(value: Column) -> Column:
    """high, medium or low from a word or a number; anything else is medium."""
    graded = lambda word: once(word.try_cast("double"), lambda number: (
        F.when(F.isnan(number), F.lit("low"))
        .when(number >= 0.75, F.lit("high"))
        .when(number >= 0.4, F.lit("medium"))
        .when(number.isNotNull(), F.lit("low"))
        .otherwise(F.lit("medium"))
    ))
    return once(F.lower(strip(value)), lambda word: F.when(word.isin("high", "medium", "low"), word).otherwise(graded(word)))


def owasp_category(value: Column) -> Column:
    """``ANN:YYYY``; the year defaults to 2021, other text is kept, blank is null."""
    pattern = r"^A(\d{1,2})(?::(\d{4}))?"
    year = lambda text: once(F.regexp_extract(text, pattern, 2), lambda y: F.when(y != "", y).otherwise(F.lit("2021")))
    full = lambda text, number: F.concat(F.lit("A"), F.lpad(bare_number(number), 2, "0"), F.lit(":"), year(text))
    dated = lambda text: once(F.regexp_extract(text, pattern, 1), lambda number: F.when(number != "", full(text, number)).otherwise(text))
    return once(strip(value), lambda text: F.when(text != "", dated(text)))
