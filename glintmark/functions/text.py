"""Text, regex, hash and glob helpers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glintmark.functions import constants as K

# Secret patterns in order. A keyed pattern keeps the key and the one character after it.
_KEYED_SECRET = (
    r"(?iuU)(api[_-]?key|token|password|secret|credential|auth)"
    r"""([\"\s:=])(?:[\"\s:=]*)[\"']?([a-zA-Z0-9_\-./+=]{8,})[\"']?"""
)
_CLOUD_KEY = r"AKIA[0-9A-Z]{16}"
_HOST_TOKEN = r"gh[pousr]_[A-Za-z0-9_]{36,}"
_LONG_SECRET = (
    r"(?iuU)(key|secret|password)(?:(\s)\s*[=:]|([=:]))\s*"
    r"""[\"\']?([A-Za-z0-9+/]{32,}={0,2})[\"\']?"""
)
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def glob_regex(pattern: str) -> str:
    """Anchored regex of a shell glob; ``*`` and ``?`` also match ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = pattern.find("]", i + 2 if pattern[i:i + 1] == "!" else i + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end].replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
            if body.startswith("!"):
                body = "^" + body[1:]
            elif body.startswith("^"):
                body = "\\" + body
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + r"\z"


def matches_glob(value: Column, patterns: list[str]) -> Column:
    """True when any of the globs matches the whole value."""
    hits = F.lit(False)
    for p in patterns:
        hits = hits | value.rlike(glob_regex(p))
    return hits


def redact(text: Column) -> Column:
    """Replace secrets, one pattern after the other."""
    out = F.regexp_replace(text, _KEYED_SECRET, "$1$2" + K.REDACTED)
    out = F.regexp_replace(out, _CLOUD_KEY, K.REDACTED)
    out = F.regexp_replace(out, _HOST_TOKEN, K.REDACTED)
    return F.regexp_replace(out, _LONG_SECRET, "$1$2$3" + K.REDACTED)


def fingerprint(cwe: Column, symbol: Column, file: Column, text: Column) -> Column:
    """Short hash that survives changes of spacing and comments."""
    s = F.regexp_replace(text, r"(?dm)#.*$", "")
    s = F.regexp_replace(s, r"(?dm)//.*$", "")
    s = F.regexp_replace(s, SPACE, "")
    blank = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat_ws("|", blank(cwe), blank(symbol), blank(file), blank(s))
    return F.substring(F.sha2(raw, 256), 1, 16)


def lines_of(text: Column) -> Column:
    """Lines of a text, without an empty last one after a final line break."""
    parts = F.split(text, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A column expression is written out wherever it is named, also inside branches; a projection that grows too long that
    way is no longer compiled by the JVM.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def fold_case(text: Column) -> Column:
    """Lower case, with the letters that ignoring case equates to plain ones replaced by them."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def has_word(text: Column, words: list[str]) -> Column:
    """True when the text contains any of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens_of_chars(text: Column) -> Column:
    """Token estimate of a prompt text."""
    return F.floor(F.length(text) / K.CHARS_PER_TOKEN)


def tokens_of_bytes(size: Column) -> Column:
    """Token estimate of a file."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(size / K.CHARS_PER_TOKEN))


def first_chars(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; None keeps all."""
    return text if chars is None else F.substring(text, 1, chars)


def short_cwe_name(cwe: Column, name: Column, chars: int | None = 50) -> Column:
    """``CWE-N name`` without the part in parentheses, cut at ``chars`` characters (None keeps all)."""
    base = F.when(F.instr(name, "(") > 0, F.trim(F.substring_index(name, "(", 1))).otherwise(name)
    cut = base if chars is None else F.when(F.length(base) > chars, F.concat(F.substring(base, 1, chars - 3), F.lit("..."))).otherwise(base)
    return F.concat(F.lit("CWE-"), cwe, F.lit(" "), cut)


def context_window(lines: Column, line: Column, radius: int = 30) -> Column:
    """Numbered lines around ``line``, the line itself marked, from an array of lines."""
    start = F.greatest(F.lit(0), line - F.lit(radius + 1))
    end = F.least(F.size(lines), line + F.lit(radius))
    part = F.slice(lines, start + 1, F.greatest(F.lit(0), end - start))

    def shown(text: Column, i: Column) -> Column:
        no = start + i + 1
        mark = F.when(no == line, F.lit(">>> ")).otherwise(F.lit("    "))
        return F.concat(mark, F.lpad(no.cast("string"), F.greatest(F.lit(4), F.length(no.cast("string"))), F.lit(" ")),
                        F.lit(" | "), text)

    return F.array_join(F.transform(part, shown), "\n")
