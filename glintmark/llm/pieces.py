"""SentencePiece encoding and decoding over a shared trie of words, by forward scores kept for each prefix.

The distinct marked words of a batch are sorted, which visits the trie of all words depth-first, and the forward states
of the prefix shared with the word before are kept. What a state is depends on the model.

Unigram models: Viterbi. The state of a prefix is the score of its best segmentation and where its last piece begins.

Merge-ranked models: their scores are merge ranks, so a path of the highest sum is not what the library returns. The
state of a prefix is the last piece of its encoding: an encoding is the library's just when every two neighbours
would stay two if they were encoded alone, so the last piece of a prefix is the one whose left neighbour, the last piece
of the shorter prefix, allows it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glintmark.llm.common import slices, texts
from glintmark.llm.encoding import shared

MARK = "▁"
# Numbers of the model and piece types in a model file, and what an unknown character costs beyond the worst piece.
UNIGRAM, MERGES = 1, 2
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
UNKNOWN_COST = 10.0
# Fixed value: what an unknown piece reads as.
UNKNOWN_TEXT = " ⁇ "
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a serialised message: whole numbers, or the bytes of a text, message or float."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
            continue
        size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
        yield tag >> 3, raw[at:at + size]
        at += size


def model_type(raw: bytes) -> int:
    """The type that a serialised model names; unigram if it names none."""
    spec = b"".join(v for k, v in _fields(raw) if k == 2 and isinstance(v, bytes))
    return next((v for k, v in _fields(spec) if k == 3), UNIGRAM)


def removes_spaces(raw: bytes) -> bool:
    """Whether the model drops repeated spaces, and with them every mark before the first text when it decodes."""
    spec = b"".join(v for k, v in _fields(raw) if k == 3 and isinstance(v, bytes))
    return bool(next((v for k, v in _fields(spec) if k == 4), 1))


def piece_types(raw: bytes) -> list[int]:
    return [next((v for k, v in _fields(piece) if k == 3), NORMAL) for k, piece in _fields(raw) if k == 1]


def load(path: str) -> Pieces:
    """The encoder of a model file; model types other than unigram and merge-ranked are refused."""
    with open(path, "rb") as f:
        kind = model_type(f.read())
    made = {UNIGRAM: Unigram, MERGES: Pieces}.get(kind)
    if made is None:
        raise ValueError(f"{path}: model type {kind} is neither unigram ({UNIGRAM}) nor merge-ranked ({MERGES})")
    return made(path)


class Pieces:
    """Vocabulary of a model file, and the encoder of marked words by merge ranks."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts, self.ids, self.ranks, self.bytes = [], {}, {}, {}
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            self.texts.append(piece)
            if self.library.is_unknown(i):
                self.texts[i] = UNKNOWN_TEXT
            elif self.library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unused(i)):
                self.ids[piece] = i
                self.ranks[piece] = -self.library.get_score(i)
        for b, i in self.bytes.items():
            if b < 128:
                self.texts[i] = chr(b)  # a byte that is a character by itself
        self.of_byte = {i: b for b, i in self.bytes.items() if b >= 128}
        self.mark = {i for i, t in enumerate(self.texts) if t.startswith(MARK)}
        self.texts = [t.replace(MARK, " ") for t in self.texts]
        self.trims = removes_spaces(self.library.serialized_model_proto())
        # Every end of a piece of two characters or more, and whether it is a piece itself: where no piece ends so, none longer does.
        self.ends = {p[k:]: False for p in self.ids for k in range(len(p) - 1)}
        self.ends |= {p: True for p in self.ids if len(p) > 1}
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # pieces across words: no cutting then
        self.allowed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.most = most

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best pair first, leftmost first."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], i, p) for i in range(n - 1) if (p := text[i:i + 2]) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := piece + parts[after[i]]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], i, p))
            if before[i] >= 0 and (p := parts[before[i]] + piece) in self.ranks:
                heapq.heappush(heap, (self.ranks[p], before[i], p))
        return [p for p in parts if p]

    def _allows(self, left: str, right: str) -> bool:
        """Whether the two pieces stay two beside each other; with no left one, whether the piece is made at all."""
        key = (left, right)
        if (known := self.allowed.get(key)) is None:
            if len(self.allowed) >= self.most:
                self.allowed.clear()
            known = self.allowed[key] = self.merged(left + right) == [p for p in key if p]
        return known

    def _last(self, word: str, end: int, last: list[str]) -> str:
        """Last piece of the encoding of ``word[:end]``, given those of all shorter prefixes: the only one that its left neighbour allows."""
        allowed, ends = self.allowed, self.ends
        piece, start = word[end - 1], end - 1
        while True:
            key = (last[start], piece)
            known = allowed.get(key)
            if known or known is None and self._allows(*key):
                return piece
            start -= 1
            while not (is_piece := ends.get(word[start:end]) if start >= 0 else None):
                if is_piece is None:
                    return self.merged(word[:end])[-1]  # a model whose merges pairs do not settle
                start -= 1
            piece = word[start:end]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Pieces of every word; the words are visited in trie order and share the states of common prefixes."""
        out, before, last = {}, "", [""]
        for word in sorted(set(words)):
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del last[n + 1:]
            for end in range(n + 1, len(word) + 1):
                last.append(self._last(word, end, last))
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            out[word] = pieces[::-1]
            before = word
        return out

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.library.unk_id():  # unknown neighbours are one
                out.append(self.library.unk_id())
        return np.array(out, "<u4").tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the words of the whole batch are encoded together."""
        split = [[n] if self.whole else _WORD.findall(n) for n in (self.library.normalize(t) for t in batch)]
        new = {w for words in split for w in words} - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = {w for words in split for w in words}
        self.known |= {w: self._ids(p) for w, p in self.encode_words(new).items()}
        return [b"".join([self.known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        """Text of ids: marks become spaces, the one set before the text goes, runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.of_byte.keys().isdisjoint(numbers):
            text = "".join([self.texts[i] for i in numbers])
        else:
            for i in numbers:
                if i in self.of_byte:
                    run.append(self.of_byte[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.texts[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        cut = 0  # marks of the first piece, or of all pieces until one holds more
        for i in numbers:
            cut += i in self.mark
            if not self.trims or self.texts[i] != " ":
                break
        return text[cut:]


class Unigram(Pieces):
    """The encoder of marked words by the best sum of piece scores.

    The library adds scores up over a whole text in 32-bit numbers, so where two segmentations of a word are as good
    but for rounding, the text before the word decides. Such words are known by their margin; a text that holds one is
    searched as a whole. What the library adds up for a user-defined piece is not known to the last bit, so after one a tie
    may fall otherwise.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(path, most)
        types = piece_types(self.library.serialized_model_proto())
        normal = [self.library.get_score(i) for i, t in enumerate(types) if t == NORMAL]
        worst, top = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = float(np.float32(worst) - np.float32(UNKNOWN_COST))
        # A user-defined piece outdoes its parts: it has nearly the best score for each of its bytes.
        self.scores = {p: float(np.float32(len(p.encode()) * float(np.float32(top)) - 0.1)) if types[i] == USER_DEFINED else self.library.get_score(i)
                       for p, i in self.ids.items()}
        self.whole = self.whole or not (MARK in self.ids or self.bytes)  # unknown marks join their neighbours
        self.figures: dict[str, tuple[float, float]] = {}

    def encode_words(self, words: Iterable[str], note: bool = True) -> dict[str, list[str]]:
        """Pieces of every word; the words are visited in trie order and share the forward scores of common prefixes.

        The score of a prefix is the best over the pieces that end it, each added to the score of the prefix before it; of
        equal ones the longest piece wins. A character that is no piece by itself may stand for itself as unknown.
        """
        out, before, score, back, margin = {}, "", [0.0], [0], [np.inf]
        scores, ends, unknown, single = self.scores, self.ends, self.unknown, np.float32
        for word in sorted(set(words)):
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del score[n + 1:], back[n + 1:], margin[n + 1:]
            for end in range(n + 1, len(word) + 1):
                start = end - 1
                starts = [start]
                while start and (is_piece := ends.get(word[start - 1:end])) is not None:
                    start -= 1
                    if is_piece:
                        starts.append(start)
                best, at, second = -np.inf, 0, -np.inf
                for start in reversed(starts):  # the longest piece first
                    total = float(single(scores.get(word[start:end], unknown) + score[start]))
                    if total > best:
                        best, at, second = total, start, best
                    elif total > second:
                        second = total
                score.append(best)
                back.append(at)
                margin.append(best - second)
            pieces, end, least = [], len(word), np.inf
            while end:
                least = min(least, margin[end])
                pieces.append(word[back[end]:end])
                end = back[end]
            out[word] = pieces[::-1]
            if note:
                self.figures[word] = (least / (len(word) + 1), -score[-1])
            before = word
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        out = super().encode(batch)
        if not self.whole:
            for k, text in enumerate(batch):
                words = _WORD.findall(normal := self.library.normalize(text))
                rounding = 2.0**-21 * (1 + sum(abs(self.figures[w][1]) for w in words))
                if any(self.figures[w][0] <= rounding for w in words):
                    out[k] = self._ids(self.encode_words([normal], note=False)[normal])
        if len(self.figures) > self.most:
            self.known, self.figures = {}, {}
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2048) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids`` (little-endian unsigned 32-bit), ``ids_crc32`` of every whole text, as the library encodes it.

    Words of ``rows`` texts at a time share one trie; what a task keeps of words is bounded. Null text counts as empty
    and has no pieces. Null ids and repeated rows are encoded each; no rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(load, model)
        for b in slices(batches, rows):
            ids = pieces.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array([zlib.crc32(i) for i in ids], pa.int64())], schema=_OUT)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids binary, ids_crc32 long")


_BACK = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text", pa.string()), ("text_sha256", pa.string())])
_BACK_SQL = "doc_id long, n_pieces long, ids_crc32 long, text string, text_sha256 string"


def _decoded(pieces: Pieces, doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    out = [pieces.decode(i) for i in ids]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(out, pa.string()),
                                       pa.array([hashlib.sha256(t.encode()).hexdigest() for t in out], pa.string())], schema=_BACK)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_crc32``, ``text`` and its lower-case hex ``text_sha256`` from ``doc_id`` and ``ids``; null ids decode to empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(load, model)
        for b in slices(batches):
            yield _decoded(pieces, b.column(0), [i or b"" for i in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, _BACK_SQL)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 1024) -> DataFrame:
    """``decode_pieces`` of ``encode_pieces`` in one pass, so that ids need not leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(load, model)
        for b in slices(batches, rows):
            yield _decoded(pieces, b.column(0), pieces.encode(b.column(1).to_pylist()))

    return texts(docs, id_col, text_col).mapInArrow(run, _BACK_SQL)
