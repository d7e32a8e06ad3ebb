"""Words that any match of a pattern must hold, read off the pattern: a cheap test before the pattern is tried."""

from __future__ import annotations

import re

_FLAGS = re.compile(r"\(\?[a-zA-Z]+\)")
_REPEAT = re.compile(r"[*+?]|\{(\d*)(,?)(\d*)\}")


def unicode_pattern(pattern: str) -> str:
    """A pattern for Java with character classes and folding over all of Unicode."""
    flags = _FLAGS.match(pattern)
    if flags:
        return f"(?{flags.group()[2:-1]}uU)" + pattern[flags.end():]
    return "(?U)" + pattern if re.search(r"\\[bwsd]", pattern) else pattern


def needed_words(pattern: str) -> list[str] | None:
    """Lower-case words of which every match holds at least one, ignoring case; None where the pattern needs none.

    Reads literals, groups, alternation, classes and repetition. A class ends a word; so does whatever may be absent.
    """
    start = _FLAGS.match(pattern)
    words, _ = _choice(pattern, start.end() if start else 0)
    return sorted({w.lower() for w in words}) if words else None


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The set that rules out more: its shortest word is longer, or it has fewer words."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda ws: (min(map(len, ws)), -len(ws)))


def _choice(p: str, i: int) -> tuple[list[str] | None, int]:
    """Words of the branches from ``i`` to the end of the group; none if a branch needs none."""
    out, free = [], False
    while True:
        words, i = _branch(p, i)
        free = free or not words
        out += words or []
        if i >= len(p) or p[i] == ")":
            return (None if free else out), i
        i += 1


def _branch(p: str, i: int) -> tuple[list[str] | None, int]:
    best, run = None, ""
    while i < len(p) and p[i] not in "|)":
        char, words = None, None
        if p[i] == "\\":
            char = p[i + 1] if not p[i + 1].isalnum() else None
            i += 2
        elif p[i] == "[":
            end = p.index("]", i + 3 if p[i + 1:i + 2] == "^" else i + 2)
            i = end + 1
        elif p[i] == "(":
            look = re.match(r"\(\?(:|<?[=!])?", p[i:])
            words, end = _choice(p, i + (len(look.group()) if look else 1))
            if look and look.group(1) not in (None, ":"):
                words = None  # what lies ahead or behind is no part of the match
            i = end + 1
        elif p[i] in "^$.":
            i += 1
        else:
            char = p[i]
            i += 1
        repeat = _REPEAT.match(p, i)
        optional = bool(repeat) and (repeat.group() in "*?" or repeat.group(1) in ("0", "") and repeat.group()[0] == "{")
        if repeat:
            i = repeat.end()
            if p[i:i + 1] == "?":
                i += 1
        if char and not optional:
            run += char
        if not char or repeat:
            best = _better(best, [run] if run else None)
            run = ""
        if words and not optional:
            best = _better(best, words)
    return _better(best, [run] if run else None), i
