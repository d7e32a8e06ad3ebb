"""Token ids of whole texts as the tokenizers library gives them, each distinct word encoded once per task."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from struct import pack

import numpy as np

# Letters and signs whose place in every pattern of the vocabulary files is beyond doubt.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = "!#$%&()*+,./:;=?@[\\]^_`{|}~\"-"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Cache of what ``make`` gives for a word, of ``most`` words at most. Long words are not kept, so memory stays bounded.

    When half of ``most`` is reached, these words become the older half and the half before them goes; a word found
    among the older ones is taken over. So words in use stay, and only those that did not come again are made again.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.half, self.longest, self.older = make, max(1, most // 2), longest, {}

    def __missing__(self, word: str):
        older = self.older
        value = older[word] if word in older else self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class PerWord:
    """Values of a text's pre-tokens, found once per distinct word.

    A text is cut where its tokenizer always has a boundary. ``spaced``: white space belongs to the word after it
    (byte-level pattern without normalizer); a cut lies before a space that follows anything but white space.
    ``dropped``: white space is removed; cuts lie at white space. Any other tokenizer gets whole texts, and so do
    texts with control characters that Python counts as white space and the library does not. Words of plain letters
    with signs behind them are looked up in two parts; any other word is left to the library's own steps.

    Subclasses give the value of a pre-token (in the letters of the vocabulary) and of any other word.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) and not re.search(r"\s", "".join(self.specials))
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.kind = "whole"
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind = "spaced"
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        cuts = pre.get("pretokenizers", [])
        if plain and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and not cuts[1]["use_regex"] \
                and cuts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            self.kind = "dropped"
        self._odd = re.compile(r"[\x1c-\x1f]")
        self._other = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
        self._cut = re.compile(r"(?<!\s)(?= )")
        self._plain = re.compile(f"[{_LETTERS}]+")
        shown = byte_letters()
        self._shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}
        self.cores, self.tails, self.known = Words(self._core, most), Words(self._tail, most // 8), Words(self.word, most // 8)
        self.heads = Words(self._head, most // 8)

    def part(self, pretoken: str):
        raise NotImplementedError

    def word(self, word: str):
        raise NotImplementedError

    def _core(self, core: str):
        """Value of a word of plain letters, None for any other."""
        if core.isascii() and core.isalpha():  # letters that stand for themselves
            return self.part(self._shown[32] + core if self.kind == "spaced" else core.lower())
        if not self._plain.fullmatch(core):
            return None
        return self.part((" " + core if self.kind == "spaced" else core.lower()).translate(self._shown))

    def _head(self, core: str):
        """As ``_core``, for the first word of a line, which has no space before it."""
        return self.part(core.translate(self._shown)) if self._plain.fullmatch(core) else None

    def _tail(self, tail: str):
        return self.part(tail.translate(self._shown))

    def _line(self, words: list[str], cores: Words, space: str, out: list) -> None:
        tails, known = self.tails, self.known
        for w in words:
            core = w.rstrip(_SIGNS)
            value = cores[core]
            if value is None:
                out.append(known[space + w])
            else:
                out.append(value)
                if len(core) != len(w):
                    out.append(tails[w[len(core):]])

    def values(self, text: str) -> list:
        """One value or more for each word of a whole text, in order."""
        out: list = []
        if self.kind == "whole":
            return [self.word(text)]
        other = self._other.search(text)
        if other and self._odd.search(text):
            return [self.word(text)]
        if self.kind == "dropped":
            self._line(text.split(), self.cores, "", out)
        elif other or "  " in text or " \n" in text or "\n\n" in text or "\n " in text:
            out += [self.known[w] for w in self._cut.split(text)]
        else:  # every white space is a single space or line end
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append(self.known["\n"])
                first, *rest = line.split(" ")
                if first:
                    self._line([first], self.heads, "", out)
                self._line(rest, self.cores, " ", out)
        return out


class Encoder(PerWord):
    """``ids(text)``: little-endian unsigned 32-bit ids of a whole text, without added special tokens."""

    def part(self, pretoken: str) -> bytes:
        ids = [t.id for t in self.library.model.tokenize(pretoken)]
        return pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(self.values(text))


_OBJECTS: dict[tuple, object] = {}


def shared(kind: type, path: str, *args):
    """One object per Python worker, kept from task to task."""
    key = (kind, path, *args)
    if key not in _OBJECTS:
        _OBJECTS[key] = kind(path, *args)
    return _OBJECTS[key]
