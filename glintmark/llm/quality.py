"""Quality classifier learned from trusted positives and unlabelled text: non-negative unbiased risk, logistic loss."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import slices, texts
from glintmark.session import settle

# Classes of bytes: lower, upper, digit, space, line end, sentence signs, quotes and brackets, other signs, other letters.
_KINDS = 9
_CLASS = np.full(256, 8, dtype=np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r\v\f", 4), (b".,;:", 5), (b"'\"()[]{}", 6)):
    _CLASS[list(_chars)] = _kind
for _b in range(128):
    if _CLASS[_b] == 8:
        _CLASS[_b] = 7
WIDTH = _KINDS + _KINDS**2 + 7


def features(text: str) -> np.ndarray:
    """Numbers that describe the whole text, whatever its language: shares of byte classes and of their pairs, and how words repeat.

    Shares are drawn towards zero by a constant, so that very short texts are not extreme; an empty text gives zeros.
    """
    out = np.zeros(WIDTH)
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if not len(raw):
        return out
    kinds = _CLASS[raw]
    out[:_KINDS] = np.bincount(kinds, minlength=_KINDS) / (len(raw) + 20)
    out[_KINDS:_KINDS + _KINDS**2] = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS**2) / (len(raw) + 20)
    words = text.split()
    n = len(words)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = text.split("\n")
    at = _KINDS + _KINDS**2
    out[at:] = (
        np.log1p(n) / 10, len(counts) / (n + 5), (top[0][1] if top else 0) / (n + 5), sum(c for _, c in top) / (n + 5),
        len(text) / (n + 1) / 20, len(set(lines)) / len(lines), sum(c for c in counts.values() if c > 1) / (n + 5))
    return out


@dataclass(frozen=True)
class Model:
    """A linear scorer; ``weights`` is None where there was nothing to learn from, and every score is then ``base``."""

    centre: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.base)
        return _sigmoid(expand((rows - self.centre) / self.scale) @ self.weights)


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised values, bounded, with their squares and a constant."""
    x = np.clip(x, -8, 8)
    return np.concatenate([x, x * x / 8, np.ones((len(x), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Sums:
    """What one pass over the documents adds up for a scorer: all there is to know for a step, whatever their number.

    Of the unlabelled: their number, loss as negatives, its gradient and curvature. Of the positives: their number,
    losses as positives and as negatives, the sum of their values and the gradient of the loss as negatives.
    """

    n_u: float
    loss_u: float
    grad_u: np.ndarray
    curve_u: np.ndarray
    n_p: float
    loss_p: float
    loss_p_as_negative: float
    sum_p: np.ndarray
    grad_p: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> Sums:
        """Over expanded rows, all of them unlabelled text, some of them trusted positives as well."""
        z = x @ w
        s = _sigmoid(z)
        p = z[positive]
        return cls(len(x), float(np.logaddexp(0, z).sum()), x.T @ s, (x * (s * (1 - s))[:, None]).T @ x,
                   len(p), float(np.logaddexp(0, -p).sum()), float(np.logaddexp(0, p).sum()), x[positive].sum(axis=0), x[positive].T @ s[positive])

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n_u, self.loss_u, self.n_p, self.loss_p, self.loss_p_as_negative], self.grad_u, self.sum_p, self.grad_p, self.curve_u.ravel()])

    @classmethod
    def back(cls, v: np.ndarray) -> Sums:
        d = int((np.sqrt(4 * len(v) - 11) - 3) / 2 + 0.5)  # 5 + 3d + d * d numbers
        grad_u, sum_p, grad_p = v[5:5 + 3 * d].reshape(3, d)
        return cls(v[0], v[1], grad_u, v[5 + 3 * d:].reshape(d, d), v[2], v[3], v[4], sum_p, grad_p)

    def negative_risk(self, prior: float) -> float:
        """Loss of the unlabelled as negatives less the share that positives take in it: the part that must not fall below zero."""
        return self.loss_u / self.n_u - prior * self.loss_p_as_negative / self.n_p

    def risk(self, prior: float, w: np.ndarray, ridge: float) -> float:
        return prior * self.loss_p / self.n_p + max(0.0, self.negative_risk(prior)) + ridge * float(w @ w) / 2


def fit_pu(sums: Callable[[np.ndarray], Sums], width: int, prior: float, rounds: int = 24, ridge: float = 1e-4, damping: float = 0.1, rate: float = 0.7) -> np.ndarray:
    """Minimise the non-negative unbiased risk of a logistic scorer by damped Newton steps; ``sums`` makes one pass over the documents.

    The risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]): unlabelled text stands for negatives once
    the share that positives take in it is subtracted. With the logistic loss l(z) - l(-z) = -z, so while this difference
    is above zero the risk is convex, with gradient E_u[s x] - prior * E_p[x]. Where the difference falls below zero,
    its gradient is turned round, so that the scorer cannot win by fitting single unlabelled texts.
    """
    w = np.zeros(width)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(rounds):
        now = sums(w)
        if now.negative_risk(prior) >= 0:
            grad = now.grad_u / now.n_u - prior * now.sum_p / now.n_p + ridge * w
        else:
            grad = prior * now.grad_p / now.n_p - now.grad_u / now.n_u
        step = np.linalg.solve(now.curve_u / now.n_u + damping * np.eye(width), grad)
        w = w - step * (rate * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12)))
    return w


def remainder(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids count as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (the features as floats) of every row, written to the shared folder; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = [features(t).astype("<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], ["doc_id", "x"])

    return settle(texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, x binary"), "features")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, WIDTH).astype(float)


def _total(rows: DataFrame, size: int, one: Callable[[pa.RecordBatch], np.ndarray], groups: int = 16) -> np.ndarray:
    """The sum over all rows of an array of ``size`` numbers: added up within tasks, then over groups of tasks, then over the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in slices(batches, 2048):
            total += one(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups]), pa.array([total.tobytes()], pa.binary())], ["part", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None  # a task without rows has nothing to send
        for b in batches:
            for s in b.column(1):
                total = np.frombuffer(s.as_buffer(), dtype=float) + (0 if total is None else total)
        if total is None:
            return
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["part", "s"])

    parts = rows.mapInArrow(run, "part long, s binary").repartition(groups, "part").mapInArrow(add, "part long, s binary")
    return sum((np.frombuffer(r["s"], dtype=float) for r in parts.collect()), np.zeros(size))


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", held_out_fold: int = 0, folds: int = 5) -> Model:
    """Learn from the rows of a ``feature_table`` outside the held-out fold.

    Trusted positives are the rows whose id is labelled 1; the class prior is the share of 1 among labelled rows outside
    the fold; unlabelled are all rows outside the fold, the positives among them. Centre and scale are those of all these
    rows, and every step of the fit adds up over all of them; only sums reach the driver, as many numbers for any
    number of documents. Null ids and null labels are left out of the learning, repeated rows count each. Without
    positives, every score is 0.5.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out_fold))
    shares = known.agg(F.avg("label").alias("prior"), F.sum("label").alias("ones")).first()
    if not shares["ones"]:
        return Model(None, None, None, 0.5)
    ones = known.filter("label = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    outside = table.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out_fold))
    rows = settle(outside.join(ones, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "learning")

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _rows(b.column(0))
        return np.concatenate([[len(x), b.column(1).true_count], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _total(rows, 2 + 2 * WIDTH, moments)
    if not m[1]:
        return Model(None, None, None, 0.5)
    centre = m[2:2 + WIDTH] / m[0]
    scale = np.sqrt(np.maximum(m[2 + WIDTH:] / m[0] - centre**2, 0)) + 1e-3
    width = 2 * WIDTH + 1

    def sums(w: np.ndarray) -> Sums:
        def one(b: pa.RecordBatch) -> np.ndarray:
            return Sums.of(expand((_rows(b.column(0)) - centre) / scale), b.column(1).to_numpy(zero_copy_only=False), w).flat()

        return Sums.back(_total(rows, 5 + 3 * width + width**2, one))

    prior = float(np.clip(shares["prior"], 0.01, 0.99))
    return Model(centre, scale, fit_pu(sums, width, prior), prior)


def quality_scores(table: DataFrame, model: Model, threshold: float = 0.3, held_out_fold: int = 0, folds: int = 5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of a ``feature_table``; null and empty texts get a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_rows(b.column(1))), pa.float64())], ["doc_id", "score"])

    rows = table.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged; null text counts as empty."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = [model.score(np.stack([features(t or "") for t in text.slice(i, 512).to_pylist()]).astype("<f4")) for i in range(0, len(text), 512)]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn("_score", score(F.col(text_col))).filter(F.col("_score") >= threshold).drop("_score")
