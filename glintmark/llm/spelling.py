"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts, and the form each word is a variant of."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.llm.boxes import DATA, QUERY, Budget, Tree, deal, grow, place, ranges, reach
from glintmark.llm.common import chosen, slices, texts
from glintmark.session import Scratch, settle

# Letters are A-Z, a-z and U+00C0 to U+00FF, one byte each in Latin-1; every other character ends a run.
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_TO_WORDS = bytes(b + 32 if 65 <= b < 91 else b if b in _LETTERS else 32 for b in range(256))
# One letter replaced keeps the length: one count rises, one falls. One letter more: one count rises.
SAME = Budget(1, 1, 2, step=1)
LONGER = Budget(1, 0, 1, step=1)


def runs(text: str) -> Counter:
    """Letter runs of a whole text, A-Z lower-cased, as Latin-1 bytes with their numbers."""
    return Counter(text.encode("latin-1", "replace").translate(_TO_WORDS).split())


def results(doc_id: int | None, found: Counter, divisor: int, shortest: int) -> Iterator[tuple[bytes, int]]:
    """Each run's result: where ``divisor`` divides the crc32 of ``id:run``, the run without one of its letters."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        if len(run) < shortest:  # a result is never longer than its run
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % divisor == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 97, shortest: int = 5, least: int = 3,
                held: int = 200_000) -> DataFrame:
    """``w`` (the word in Latin-1 bytes) and ``n`` of every result of at least ``shortest`` letters and ``least`` occurrences.

    A task adds counts up until it holds ``held`` words, then hands them on, so frequent words leave it few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])
            counts.clear()
            return made

        for b in slices(batches, 64):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in results(doc_id, runs(text), divisor, shortest):
                    counts[word] += n
                if len(counts) >= held:
                    yield out()
        yield out()

    return texts(docs, id_col, text_col).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words of one length, a row each, and how often each byte value occurs in each word."""
    rows = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, length)
    return rows, letter_counts(rows)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    values, place_of = np.unique(rows, return_inverse=True)
    place_of = place_of.reshape(rows.shape)
    k = len(values)
    flat = np.bincount((np.arange(len(rows))[:, None] * k + place_of).ravel(), minlength=len(rows) * k).reshape(-1, k)
    out = np.zeros((len(rows), 256), dtype=np.float32)
    out[:, values] = flat
    return out


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two words of one length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b``, one letter longer, are ``a`` with a letter put in: the ends that agree cover all of ``a``."""
    n = a.shape[1]
    head, tail = a == b[:, :n], a == b[:, 1:]
    before = np.where(head.all(axis=1), n, head.argmin(axis=1))
    after = np.where(tail.all(axis=1), n, tail[:, ::-1].argmin(axis=1))
    return before + after >= n


def _rows_held(length: int, capacity: int) -> int:
    """Rows of a tile: ``capacity``, or fewer of very long words, so that a tile's letters stay within 64 MB."""
    return max(1, min(capacity, (1 << 26) // length))


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(sizes):
        numbers = np.flatnonzero(sizes == length)
        for begin in range(0, len(numbers), max(1, min(4096, (1 << 24) // int(length)))):
            part = numbers[begin:begin + max(1, min(4096, (1 << 24) // int(length)))]
            yield int(length), part, letters([words[i] for i in part], int(length))[1]


_ONE_LEAF = Tree(np.array([-1]), np.array([0.0]), np.array([[-1, -1]]))


def _routes(length: int, points: np.ndarray, trees: dict[int, Tree]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``length, leaf, kind, rows, own``: words as data of their leaf, as queries of their own leaf and those in reach that are
    numbered higher, and as queries of the leaves in reach among the words one letter longer."""
    tree = trees.get(length, _ONE_LEAF)
    home = place(tree, points)
    for leaf, rows in reach(tree, points, SAME):
        here = home[rows] == leaf
        yield length, leaf, DATA, rows[here], np.ones(int(here.sum()), dtype=bool)
        ask = here | (leaf > home[rows])
        yield length, leaf, QUERY, rows[ask], here[ask]
    for leaf, rows in reach(trees.get(length + 1, _ONE_LEAF), points, LONGER):
        yield length + 1, leaf, QUERY, rows, np.zeros(len(rows), dtype=bool)


def _blocks(words: DataFrame, trees: dict[int, Tree], capacity: int) -> dict[tuple, int]:
    """Blocks of every leaf with more rows of a kind than a tile holds; their number is at most the routed rows over a tile's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for length, _, points in _by_length(b.column(0).to_pylist()):
                for to, leaf, kind, rows, _ in _routes(length, points, trees):
                    total[to, leaf, kind] += len(rows)
        out = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["length", "leaf", "kind", "n"])

    held = F.greatest(F.lit(1), F.least(F.lit(capacity), F.lit(1 << 26) / F.col("length")))
    found = words.select("w").mapInArrow(run, "length long, leaf long, kind long, n long").groupBy("length", "leaf", "kind").agg(F.sum("n").alias("n"))
    return {(r["length"], r["leaf"], r["kind"]): -(-r["n"] // _rows_held(r["length"], capacity)) for r in found.filter(F.col("n") > held).collect()}


_TILE = ["length", "leaf", "d", "q"]


def _tiles(words: DataFrame, trees: dict[int, Tree], blocks: dict[tuple, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            salts = np.array([zlib.crc32(w) for w in found], dtype=np.int64)
            for length, numbers, points in _by_length(found):
                for to, leaf, kind, rows, own in _routes(length, points, trees):
                    if not len(rows):
                        continue
                    nd, nq = blocks.get((to, leaf, DATA), 1), blocks.get((to, leaf, QUERY), 1)
                    take, i, j = deal(np.arange(len(rows)), salts[numbers[rows]], kind, nd, nq)
                    at = pa.array(numbers[rows[take]])
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, to, dtype=np.int64)), pa.array(np.full(n, leaf, dtype=np.int64)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)),
                        pa.array(np.full(n, kind, dtype=np.int32)), pa.array(own[take]), b.column(0).take(at), b.column(1).take(at)], [*_TILE, "kind", "own", "w", "n"])

    return words.select("w", "n").mapInArrow(run, "length long, leaf long, d long, q long, kind int, own boolean, w binary, n long")


def _classes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct count vectors, and the rows of each: row order, first place and number."""
    used = points.any(axis=0)
    _, first, number, sizes = np.unique(points[:, used].astype(np.uint16), axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(number.ravel(), kind="stable")
    return points[first], order, np.cumsum(sizes) - sizes, sizes


def near_pairs(asked: np.ndarray, data: np.ndarray, pairs: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of words of ``asked`` and ``data`` (letters, one length each, equal or data one longer) that are one edit apart.

    A k-d tree over the distinct count vectors of the data prunes boxes; of a leaf's vectors those within the budget are
    found by one matrix product, since all their differences are -1, 0 or 1; words of near vectors are compared letter by letter.
    """
    longer = data.shape[1] > asked.shape[1]
    budget, check, most = (LONGER, one_more, 1) if longer else (SAME, one_replaced, 2)
    qv, q_order, q_first, q_size = _classes(letter_counts(asked))
    dv, d_order, d_first, d_size = _classes(letter_counts(data))
    used = qv.any(axis=0) | dv.any(axis=0)
    qv, dv = np.ascontiguousarray(qv[:, used]), np.ascontiguousarray(dv[:, used])
    qs, ds = (qv * qv).sum(axis=1), (dv * dv).sum(axis=1)
    tree = grow(dv, 64)
    home = place(tree, dv)
    by_leaf = np.argsort(home, kind="stable")
    leaves, starts, sizes = np.unique(home[by_leaf], return_index=True, return_counts=True)
    span = {int(k): (int(s), int(s + n)) for k, s, n in zip(leaves, starts, sizes, strict=True)}
    step = max(1, pairs // data.shape[1])
    waiting, size = [], 0

    def checked(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word pairs of class pairs, in steps of bounded size."""
        n = q_size[i] * d_size[j]
        ends = np.cumsum(n)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
            a, b, m = i[at:to], j[at:to], n[at:to]
            at = to
            for begin in range(0, int(m.sum()), 8 * step) if len(a) == 1 else (0,):  # one pair of large classes comes in parts
                inner = np.arange(begin, min(int(m[0]), begin + 8 * step)) if len(a) == 1 else ranges(m)
                k = np.repeat(np.arange(len(a)), m) if len(a) > 1 else np.zeros(len(inner), dtype=np.int64)
                x = q_order[q_first[a[k]] + inner // d_size[b[k]]]
                y = d_order[d_first[b[k]] + inner % d_size[b[k]]]
                ok = check(asked[x], data[y])
                yield x[ok], y[ok]

    for leaf, rows in reach(tree, qv, budget):
        lo, hi = span[leaf]
        mine = by_leaf[lo:hi]
        for begin in range(0, len(rows), 8192):
            ask = rows[begin:begin + 8192]
            i, j = np.nonzero(qs[ask][:, None] + ds[mine][None, :] - 2 * (qv[ask] @ dv[mine].T) <= most)
            waiting.append((ask[i], mine[j]))
            size += len(i)
            if size >= step:
                yield from checked(np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting]))
                waiting, size = [], 0
    if size:
        yield from checked(np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting]))


def _near(tiles: DataFrame) -> DataFrame:
    """For words with near words in a tile: ``w``, their number ``near`` and, of those of largest ``best_n``, the first in letter order ``best``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        length = key[0].as_py()
        kind, own = table["kind"].to_numpy(), table["own"].to_numpy()
        words, n = table["w"].to_pylist(), table["n"].to_numpy()
        data = np.flatnonzero(kind == DATA)
        count = np.zeros(len(words), dtype=np.int64)
        rank = np.empty(len(words), dtype=np.int64)  # larger counts first, then letter order
        rank[sorted(range(len(words)), key=lambda r: (-n[r], words[r]))] = np.arange(len(words))
        best = np.full(len(words), len(words), dtype=np.int64)

        def note(a: np.ndarray, b: np.ndarray) -> None:
            np.add.at(count, a, 1)
            np.minimum.at(best, a, rank[b])

        asked = np.flatnonzero(kind == QUERY)
        sizes = np.array([len(words[i]) for i in asked], dtype=np.int64)
        for size in (length, length - 1):
            rows = asked[sizes == size]
            if not len(rows) or not len(data):
                continue
            for x, y in near_pairs(letters([words[i] for i in rows], size)[0], letters([words[i] for i in data], length)[0]):
                a, b = rows[x], data[y]
                note(a, b)
                far = ~own[a]  # a pair of one leaf comes twice, any other once
                note(b[far], a[far])
        out = np.flatnonzero(count)
        by_rank = np.empty(len(words), dtype=np.int64)
        by_rank[rank] = np.arange(len(words))
        to = by_rank[best[out]]
        return pa.table({"w": pa.array([words[i] for i in out], pa.binary()), "near": count[out], "best": pa.array([words[i] for i in to], pa.binary()), "best_n": n[to]})

    return tiles.groupBy(*_TILE).applyInArrow(run, "w binary, near long, best binary, best_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``w`` and ``root``: the end of the chain of forms, by pointer jumping; rounds grow with the log of the longest chain."""
    scratch = Scratch(forms.sparkSession, "roots")
    now = scratch.save(forms.select("w", F.col("form").alias("root")), "r0")
    turn = 0
    while True:
        onward = now.select(F.col("w").alias("root"), F.col("root").alias("next"))
        turn += 1
        after = scratch.save(now.join(onward, "root", "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"r{turn}")
        moved = not after.filter("moved").isEmpty()
        scratch.drop(f"r{turn - 1}")
        now = after.select("w", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 97, shortest: int = 5, least: int = 3, factor: int = 2,
                      capacity: int = 8192, sample: int = 100_000) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``: every word, its near words and the word it is a variant of.

    Words are letter runs (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at least ``shortest`` letters that occur at
    least ``least`` times; where ``divisor`` divides the crc32 of ``id:run``, a run first loses one letter. Words are
    near if one letter is put in, left out or replaced. The form of a word is its near word that occurs most (ties: first in
    code-point order), if it occurs at least ``factor`` times as often; the root is the end of the chain of forms.

    One edit changes the letter counts by at most two in all, so for every pair of lengths a word asks the k-d tree of
    the other length for the boxes in reach. The trees' tops are fitted to at most ``sample`` words and deal all words
    to leaves of about ``capacity``; they decide only the work. A leaf with more rows is cut into tiles in which every
    part meets every other. Tiles give figures of words, never pairs.

    Null texts hold no words; a null id counts as an empty one. Repeated rows count each. No rows or no words give no
    rows. Other columns are left out, so their names cannot clash.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2, so that chains of forms end")
    words = settle(word_counts(docs, id_col, text_col, divisor, shortest, least), "words")
    sizes = {r["k"]: r["n"] for r in words.groupBy(F.length("w").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).collect()}
    some = chosen(words.filter(F.length("w") < 1024).select("w"), sample, "w").toArrow()["w"].to_pylist()
    trees = {}
    for length in sorted({len(w) for w in some}):
        points = letters([w for w in some if len(w) == length], length)[1]
        trees[length] = grow(points, max(1, int(_rows_held(length, capacity) * len(points) / max(sizes.get(length, 1), 1))))
    near = settle(_near(_tiles(words, trees, _blocks(words, trees, capacity))), "near")
    figures = near.groupBy("w").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("top"))
    found = settle(words.join(figures, "w", "left").select("w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                   F.when(-F.col("top.rank") >= factor * F.col("n"), F.col("top.best")).alias("form"), F.when(-F.col("top.rank") >= factor * F.col("n"), -F.col("top.rank")).alias("form_n")), "forms")
    out = found.join(_roots(found.filter("form IS NOT NULL")), "w", "left")
    plain = {c: F.decode(c, "ISO-8859-1") for c in ("w", "form", "root")}
    return out.select(plain["w"].alias("word"), "n", "n_near", plain["form"].alias("form"), "form_n", F.coalesce(plain["root"], plain["w"]).alias("root"))
