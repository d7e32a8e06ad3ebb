"""File paths: normal form, language, filters, test and config files, module names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.levels import lookup
from glintmark.functions.needed import needed_words, unicode_pattern
from glintmark.functions.text import fold_case, has_word, matches_glob


def normal_uri(uri: Column, root: Column | str | None = None) -> Column:
    """Path without ``file://`` and without the target root."""
    out = F.regexp_replace(uri, "^file://", "")
    if root is None:
        return out
    prefix = F.concat(F.rtrim(root if isinstance(root, Column) else F.lit(root), F.lit("/")), F.lit("/"))
    has_root = F.length(prefix) > 1
    return F.when(has_root & out.startswith(prefix), F.substr(out, F.length(prefix) + 1)).otherwise(out)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix of the name with its dot; a leading dot does not start a suffix."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of a file from its extension; a Dockerfile is configuration."""
    return F.when(F.lower(base_name(path)).startswith("dockerfile"), F.lit("config")).otherwise(
        F.coalesce(lookup(K.EXTENSION_LANGUAGE, F.lower(extension(path))), F.lit("other"))
    )


def passes_filters(path: Column, exclude: list[str], include: list[str]) -> Column:
    """Exclude globs win; then one include glob must match, if there are any."""
    keep = ~matches_glob(path, exclude)
    return keep & matches_glob(path, include) if include else keep


def inventoried(path: Column, exclude: list[str] | None = None, strip_dots: bool = False) -> Column:
    """Not below an excluded directory and not a generated file.

    ``strip_dots`` tests the user's globs on the path without leading dots and slashes.
    """
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(dirs, lambda d: d.isin(K.INVENTORY_EXCLUDED_DIRS) | d.endswith(".egg-info"))
    for pattern in exclude or []:
        pruned = pruned | F.exists(dirs, lambda d: matches_glob(d, [pattern]))
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(dirs))),
                            lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/"))
        pruned = pruned | F.exists(
            above, lambda d: matches_glob(F.ltrim(d, F.lit("./")) if strip_dots else d, [pattern])
        )
    generated = F.lit(False)
    for pattern in K.INVENTORY_EXCLUDED_NAMES:
        generated = generated | base_name(path).rlike("(?iu)" + pattern)
    return ~pruned & ~generated


def collected(path: Column, exclude: list[str] | None = None, extensions: list[str] | None = None) -> Column:
    """Kept by code analysis: a known extension and no exclusion; directory exclusions are prefixes."""
    keep = extension(path).isin(extensions or K.COLLECT_EXTENSIONS)
    for pattern in K.COLLECT_EXCLUDED if exclude is None else exclude:
        if pattern.endswith("/"):
            keep = keep & ~path.startswith(pattern.rstrip("/"))
        elif re.search(r"[*?\[]", pattern):
            keep = keep & ~matches_glob(path, [pattern]) & ~matches_glob(base_name(path), [pattern])
        else:
            keep = keep & ~path.startswith(pattern)
    return keep


def in_scope(path: Column, scope: list[str]) -> Column:
    """Below, equal to, or matching one of the scope entries."""
    keep = F.lit(False)
    for entry in scope:
        if re.search(r"[*?]", entry):
            keep = keep | matches_glob(path, [entry])
        else:
            keep = keep | (path == entry) | path.startswith(entry.rstrip("/") + "/")
    return keep


def is_test_path(path: Column) -> Column:
    """Test file as code analysis sees it: a path part is tests or test or starts with test_."""
    return F.exists(F.split(path, "/"), lambda p: p.isin("tests", "test") | p.startswith("test_"))


def is_scored_test_path(path: Column) -> Column:
    """Test file as scoring sees it: tests/ or test_ at the start of the path or after a slash."""
    return path.rlike(r"(^|/)(tests/|test_)")


def is_linter_test_path(path: Column) -> Column:
    """Test file as the linter scan sees it."""
    return F.exists(F.split(path, "/"), lambda p: (p == "tests") | p.startswith("test_"))


def is_sensitive_env(path: Column) -> Column:
    """An environment file that may hold live secrets."""
    name = F.lower(base_name(F.replace(path, F.lit("\\"), F.lit("/"))))
    template = F.lit(False)
    for suffix in K.ENV_TEMPLATE_SUFFIXES:
        template = template | name.endswith(suffix)
    return ~template & (name.startswith(".env.") | name.endswith(".env"))


def is_config_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    hit = name.startswith("dockerfile") | F.contains(F.lower(path), F.lit(".github/")) | name.contains(".gitlab-ci")
    for part in K.CONFIG_NAME_PARTS:
        hit = hit | name.contains(part)
    return hit | F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(K.CONFIG_EXTENSIONS)


def with_security_weight(files: DataFrame, text: str = "text", name: str = "weight", chars: int | None = K.CONTENT_WEIGHT_CHARS) -> DataFrame:
    """Add the relevance of each file (path, language, text), 0 to 10, from its name and its first ``chars`` characters (None: all).

    The folded texts are columns of their own, so they are computed once and not in every test. A pattern is tried only
    where the folded text holds a word that it needs.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    head = whole if chars is None else F.substring(whole, 1, chars)
    prepared = files.withColumns({"_head": head, "_lower": fold_case(head), "_name": F.lower(base_name(F.col("path")))})
    points = [(has_word(F.col("_name"), words), boost) for words, boost in K.NAME_WEIGHTS]
    points += [(has_word(F.col("_lower"), needed_words(pattern) or [""]) & F.col("_head").rlike(unicode_pattern(pattern)), boost)
               for pattern, boost in K.CONTENT_WEIGHTS]
    total = reduce(lambda a, b: a + b, [F.when(hit, F.lit(n)).otherwise(F.lit(0)) for hit, n in points], F.lit(1))
    weight = F.when(F.col("language") == "other", F.lit(0)).otherwise(F.least(total, F.lit(K.WEIGHT_MAX)))
    return prepared.select(*files.columns, weight.alias(name))


def module_name(path: Column) -> Column:
    """Dotted module of a source path."""
    out = F.regexp_replace(path, r"[/\\]", ".")
    out = F.regexp_replace(out, r"\.(py|cs)$", "")
    out = F.regexp_replace(out, r"\.__init__$", "")
    return F.regexp_replace(out, r"^src\.", "")


def bare_type(text: Column) -> Column:
    """First type of a union that is not None, without its type arguments."""
    parts = F.filter(F.transform(F.split(text, r" \| "), lambda p: F.trim(p)), lambda p: p != "None")
    first = F.when(F.contains(text, F.lit(" | ")), F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))).otherwise(text)
    square = F.when(first.contains("[") & first.contains("]"), F.substring_index(first, "[", 1))
    angle = F.when(first.contains("<") & first.contains(">"), F.substring_index(first, "<", 1))
    return F.coalesce(square, angle, first)


def layer(path: Column) -> Column:
    """Directory that stands for the layer of a file."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (
        F.when(F.size(parts) >= 3, F.when(parts[0] != "", parts[1]).otherwise(parts[0]))
        .when(F.size(parts) == 2, parts[0])
        .otherwise(F.lit("root"))
    )
