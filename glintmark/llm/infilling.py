"""Fill-in-middle: a document is a piece table, and cutting, arranging and restoring only move descriptors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# The order of parts in each form: sentinels by name, parts of the text by number (0 prefix, 1 middle, 2 suffix).
FORMS = {"psm": (PREFIX, 0, SUFFIX, 2, MIDDLE, 1), "spm": (SUFFIX, 2, PREFIX, 0, MIDDLE, 1)}
_SENTINELS = "".join((PREFIX, SUFFIX, MIDDLE)).encode()
_PLACE = {mark: _SENTINELS.index(mark.encode()) for mark in (PREFIX, SUFFIX, MIDDLE)}
TEXT, MARKS = 0, 1


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) over two buffers that never change: the text's bytes and the sentinels."""

    buffers: tuple[bytes, bytes]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, raw: bytes) -> PieceTable:
        return cls((raw, _SENTINELS), ((TEXT, 0, len(raw)),))

    def cut(self, *at: int) -> PieceTable:
        """Descriptors split so that each offset of ``at`` (ascending) lies between two of them; a repeated offset makes an empty one."""
        out, todo, begin = [], list(at), 0
        for buffer, start, length in self.pieces:
            done = 0
            while todo and todo[0] <= begin + length:
                out.append((buffer, start + done, todo[0] - begin - done))
                done = todo.pop(0) - begin
            out.append((buffer, start + done, length - done))
            begin += length
        return PieceTable(self.buffers, tuple(out))

    def arrange(self, form: tuple) -> PieceTable:
        """Descriptors in the order of ``form``, sentinels put between them."""
        return PieceTable(self.buffers, tuple(
            self.pieces[x] if isinstance(x, int) else (MARKS, _PLACE[x], len(x)) for x in form))

    def restore(self, form: tuple) -> PieceTable:
        """The inverse of ``arrange``: sentinels left out, parts in their first order."""
        parts = sorted((x, piece) for x, piece in zip(form, self.pieces, strict=True) if isinstance(x, int))
        return PieceTable(self.buffers, tuple(piece for _, piece in parts))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, length in self.pieces:
            yield views[buffer][start:start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for view in self.stream():
            h.update(view)
        return h.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def read_back(raw: bytes, form: str) -> PieceTable:
    """The document's text out of an output and its form alone: the sentinels are found in it and their parts put back."""
    if form == "plain":
        return PieceTable.of(raw)
    order = FORMS[form]
    at, ends = [], 0
    for mark in (x for x in order if isinstance(x, str)):
        start = raw.find(mark.encode(), ends)
        if start < 0:
            raise ValueError(f"no {mark} in an output of form {form}")
        ends = start + len(mark)
        at += [start, ends]
    return PieceTable(PieceTable.of(raw).cut(*at).buffers, PieceTable.of(raw).cut(*at).pieces[1:]).restore(order)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which the units ``[A-Za-z]+|[^A-Za-z]`` (over code points) of UTF-8 bytes begin."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    letter = _LETTER[codes]
    starts = (codes & 0xC0) != 0x80  # any byte that begins a code point
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def _chars(raw: bytes, lo: int, hi: int) -> int:
    part = np.frombuffer(raw, dtype=np.uint8, count=hi - lo, offset=lo)
    return int(((part & 0xC0) != 0x80).sum())


@dataclass(frozen=True)
class Split:
    """What becomes of one document."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    table: PieceTable


def split(doc_id: int | None, raw: bytes, seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> Split:
    """Cut one document in three where a hash of seed and id says, and arrange its parts.

    The first four 32-bit numbers of the SHA-256 of ``seed:doc_id`` give the two cuts (in units), whether the
    document stays plain (``plain_share`` of 100) and its order (``spm_share`` of 100). A text that is empty or
    contains a sentinel stays plain, so that outputs can be read back. A null id counts as an empty one.
    """
    table = PieceTable.of(raw)
    starts = unit_starts(raw)
    n = len(starts)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))
    if not raw or h3 % 100 >= 100 - plain_share or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return Split(n, "plain", None, None, table)
    lo, hi = (len(raw) if k == n else int(starts[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_share else "psm"
    return Split(n, form, _chars(raw, 0, lo), _chars(raw, lo, hi), table.cut(lo, hi).arrange(FORMS[form]))


_FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def _mapped(docs: DataFrame, more: dict[str, pa.DataType], make, id_col: str, text_col: str, options: tuple) -> DataFrame:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *more]
    types = [*_TYPES, *more.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = split(doc_id, text.as_buffer().to_pybytes(), *options)
                rows.append((doc_id, s.n, s.form, s.prefix_chars, s.middle_chars, *make(s)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, ", ".join([_FIELDS, *(f"{c} string" for c in more)]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and the ``output`` text of every row.

    Units are runs of A-Z letters and single other code points. Null text counts as empty and stays plain, as do
    texts that contain a sentinel; their two counts are null. Rows with the same id and text get the same output,
    and repeated rows are returned each. Other columns are left out, so their names cannot clash. No rows give no rows.
    """
    return _mapped(docs, {"output": pa.string()}, lambda s: (s.table.content().decode("utf-8"),), id_col, text_col, (seed, plain_share, spm_share))


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``outputs`` with ``text``, the document read back from output and form alone; null where either is null."""

    @F.pandas_udf("string")
    def back(output, form):
        return output.combine(form, lambda o, f: None if o is None or f is None else read_back(o.encode(), f).content().decode())

    return outputs.withColumn("text", back(F.col(output_col), F.col(form_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """The columns of ``fill_in_middle`` with SHA-256 digests instead of texts: of the output, and of the document read back from it.

    The first digest streams the output's descriptors; the second those of the table that ``read_back`` makes of the
    output's bytes, so texts stay in their task.
    """
    def both(s: Split) -> tuple[str, str]:
        return s.table.sha256(), read_back(s.table.content(), s.form).sha256()

    return _mapped(docs, {"output_sha256": pa.string(), "restored_sha256": pa.string()}, both, id_col, text_col, (seed, plain_share, spm_share))
