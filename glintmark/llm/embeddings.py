"""Near-duplicate embeddings by a subspace pigeonhole join: range joins in low-dimensional blocks of the rotated vectors, candidates checked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.llm.boxes import DATA, QUERY, Budget, Forest, Tree, deal, grow, place, reach
from glintmark.llm.common import chosen
from glintmark.llm.components import components
from glintmark.session import settle

_SLACK = 1e-9  # far above the rounding of squared distances of unit vectors, far below any budget
_MOST_ROTATED = 1024


@dataclass(frozen=True)
class Index:
    """For vectors of one length: a rotation, its columns dealt over blocks, each block's budget of squared distance and its tree."""

    rotation: np.ndarray | None
    blocks: list[np.ndarray]
    budgets: np.ndarray
    trees: list[Tree]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Rotated unit vectors. Column by column, so that a vector has the same bits in whatever batch it comes."""
        unit = x / lengths(x)[:, None]
        if self.rotation is None:
            return unit
        out = np.zeros((len(x), self.rotation.shape[1]))
        for k in range(x.shape[1]):
            out += unit[:, k:k + 1] * self.rotation[k]
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Doubles, each vector divided by its largest component, so that no square overflows or vanishes."""
    x = np.asarray(x, dtype=np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def lengths(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * x[:, k]
    return np.sqrt(out)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, the same for (a, b) and (b, a) to the last bit."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += (a[:, k] - b[:, k]) ** 2
    return out


def index(x: np.ndarray, similarity: float, total: int, width: int, capacity: int) -> Index:
    """An index for ``total`` vectors, fitted to the sample ``x`` of them; any sample gives the same results.

    The rotation is to the principal axes, dealt over blocks of about ``width`` axes so that blocks have much the same
    variance. A block's budget is its share of the variance times the largest squared distance of a link: the shares add
    up to one, so two linked unit vectors keep within the budget in one block at least. Very long vectors are not rotated. Trees have leaves for about
    ``capacity`` of all vectors.
    """
    unit = x / lengths(x)[:, None]
    d = x.shape[1]
    if d <= _MOST_ROTATED:
        values, axes = np.linalg.eigh(unit.T @ unit / len(unit) - np.outer(unit.mean(axis=0), unit.mean(axis=0)))
    else:
        values, axes = unit.var(axis=0), None
    count = max(1, round(d / width))
    turn = np.array([i if (k // count) % 2 == 0 else count - 1 - i for k in range(d) for i in [k % count]])
    order = np.argsort(values)[::-1]
    blocks = [order[turn == b] for b in range(count)]
    share = np.array([max(values[b].sum(), 0) for b in blocks]) + 1e-6
    budgets = share / share.sum() * (2 * (1 - similarity) + _SLACK)
    made = Index(axes, blocks, budgets, [])
    at = made.coordinates(x)
    most = max(1, int(capacity * len(x) / max(total, 1)))
    return Index(axes, blocks, budgets, [grow(at[:, b], most) for b in blocks])


def _plain(d: int, similarity: float) -> Index:
    """One block and one leaf, for a length that the sample did not hold."""
    leaf = Tree(np.array([-1]), np.array([0.0]), np.array([[-1, -1]]))
    return Index(None, [np.arange(d)], np.array([2 * (1 - similarity) + _SLACK]), [leaf])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def _routes(at: np.ndarray, made: Index) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``part, leaf, kind, rows, own``: every row as data of its leaf, and as query of its own leaf and of those in reach that are numbered higher."""
    for part, (block, tree) in enumerate(zip(made.blocks, made.trees, strict=True)):
        points = np.ascontiguousarray(at[:, block])
        home = place(tree, points)
        most = float(made.budgets[part]) + _SLACK
        for leaf, rows in reach(tree, points, Budget(most, most, most, power=2)):
            here = home[rows] == leaf
            yield part, leaf, DATA, rows[here], np.ones(int(here.sum()), dtype=bool)
            ask = here | (leaf > home[rows])
            yield part, leaf, QUERY, rows[ask], here[ask]


def _by_length(batch: pa.RecordBatch, models: dict[int, Index], similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, Index]]:
    """Rows of a batch by length of their vectors: length, row numbers, rotated unit vectors, index."""
    column = batch.column("embedding")
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        made = models.get(int(d)) or _plain(int(d), similarity)
        yield int(d), rows, made.coordinates(_matrix(column.take(pa.array(rows)), int(d))), made


_TILE = ["dim", "part", "leaf", "d", "q"]


def _counts(nodes: DataFrame, models: dict[int, Index], similarity: float, capacity: int) -> dict[tuple, int]:
    """Blocks of every leaf that has more than ``capacity`` rows of a kind; their number is at most the routed rows over the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, part, leaf, kind, len(rows)) for d, _, at, made in _by_length(b, models, similarity)
                   for part, leaf, kind, rows, _ in _routes(at, made) if len(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["dim", "part", "leaf", "kind", "n"])

    found = nodes.mapInArrow(run, "dim long, part long, leaf long, kind long, n long").groupBy("dim", "part", "leaf", "kind").agg(F.sum("n").alias("n"))
    return {(r["dim"], r["part"], r["leaf"], r["kind"]): -(-r["n"] // capacity) for r in found.filter(F.col("n") > capacity).collect()}


def _tiles(nodes: DataFrame, models: dict[int, Index], similarity: float, blocks: dict[tuple, int]) -> DataFrame:
    vectors = nodes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                b = whole.slice(begin, 4096)
                salts = b.column("node").to_numpy() % 2_147_483_647
                for d, numbers, at, made in _by_length(b, models, similarity):
                    for part, leaf, kind, rows, own in _routes(at, made):
                        if not len(rows):
                            continue
                        nd, nq = blocks.get((d, part, leaf, DATA), 1), blocks.get((d, part, leaf, QUERY), 1)
                        take, i, j = deal(np.arange(len(rows)), salts[numbers[rows]], kind, nd, nq)
                        chosen_rows = pa.array(numbers[rows[take]])
                        n = len(take)
                        yield pa.RecordBatch.from_arrays([
                            *(pa.array(np.full(n, v, dtype=np.int64)) for v in (d, part, leaf)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)),
                            pa.array(np.full(n, kind, dtype=np.int32)), pa.array(own[take]), b.column("node").take(chosen_rows),
                            b.column("copies").take(chosen_rows), b.column("embedding").take(chosen_rows)], [*_TILE, "kind", "own", "node", "copies", "embedding"])

    return nodes.select("node", "copies", "embedding").mapInArrow(
        run, f"dim long, part long, leaf long, d long, q long, kind int, own boolean, node long, copies long, embedding {vectors}")


def _tile_links(made: Index, part: int, x: np.ndarray, y: np.ndarray, similarity: float, pairs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between rows of ``x`` (queries) and ``y`` (data) within the budget of a block: both row numbers, and whether no earlier block has the pair.

    A k-d tree over the data prunes boxes again; what is left is compared by matrix products, then checked exactly.
    """
    cx, cy = made.coordinates(x), made.coordinates(y)
    block, budget = made.blocks[part], float(made.budgets[part])
    bx, by = np.ascontiguousarray(cx[:, block]), np.ascontiguousarray(cy[:, block])
    nx, ny = lengths(x), lengths(y)
    sx, sy = (bx * bx).sum(axis=1), (by * by).sum(axis=1)
    tree = grow(by, 256)
    home = place(tree, by)
    order = np.argsort(home, kind="stable")
    starts = dict(zip(*(v.tolist() for v in np.unique(home[order], return_index=True)), strict=True))
    sizes = dict(zip(*(v.tolist() for v in np.unique(home, return_counts=True)), strict=True))
    for leaf, rows in reach(tree, bx, Budget(budget + _SLACK, budget + _SLACK, budget + _SLACK, power=2)):
        mine = order[starts[leaf]:starts[leaf] + sizes[leaf]]
        step = max(1, pairs // len(mine))
        for begin in range(0, len(rows), step):
            ask = rows[begin:begin + step]
            near = sx[ask][:, None] + sy[mine][None, :] - 2 * bx[ask] @ by[mine].T <= budget + _SLACK
            i, j = np.nonzero(near)
            i, j = ask[i], mine[j]
            ok = squared(bx[i], by[j]) <= budget
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= similarity
            i, j = i[ok], j[ok]
            first = np.ones(len(i), dtype=bool)
            for earlier in range(part):
                cols = made.blocks[earlier]
                first &= squared(cx[i][:, cols], cy[j][:, cols]) > made.budgets[earlier]
            yield i, j, first


def _links(tiles: DataFrame, models: dict[int, Index], similarity: float) -> DataFrame:
    """``node``, ``links`` (rows linked to it first in this tile) and ``least`` (a node of the tile it is connected with) for nodes with links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        d, part = key[0].as_py(), key[1].as_py()
        made = models.get(d) or _plain(d, similarity)
        table = table.combine_chunks()
        kind, own = table["kind"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = _matrix(table["embedding"].combine_chunks(), d)
        ask, data = np.flatnonzero(kind == QUERY), np.flatnonzero(kind == DATA)
        names, number = np.unique(node, return_inverse=True)
        count, forest = np.zeros(len(names)), Forest(len(names))
        if len(ask) and len(data):
            for i, j, first in _tile_links(made, part, x[ask], x[data], similarity):
                i, j = ask[i], data[j]
                other = node[i] != node[j]
                i, j, first = i[other], j[other], first[other]
                forest.add(number[i], number[j])
                i, j = i[first], j[first]
                count += np.bincount(number[i], weights=copies[j], minlength=len(names))
                far = ~own[i]  # a pair of one leaf comes twice, a pair of two leaves once
                count += np.bincount(number[j[far]], weights=copies[i[far]], minlength=len(names))
        out = np.flatnonzero((count > 0) | (forest.root != np.arange(len(names))))
        return pa.table({"node": names[out], "links": count[out].astype(np.int64), "least": names[forest.root[out]]})

    return tiles.groupBy(*_TILE).applyInArrow(run, "node long, links long, least long")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.95,
                    width: int = 8, capacity: int = 8192, sample: int = 20_000) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Two rows are linked when the cosine of their vectors, in double precision, is at least ``similarity`` (above 0).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links, itself
    included, and ``kept`` marks the row that has this id. Vectors of different lengths are never linked, nor are those
    that are null, empty, zero, or hold nulls or non-finite numbers.

    Rows with the same vector are one node with a number of copies, so they are never expanded into pairs. Each block
    of about ``width`` rotated axes has a tree whose leaves hold about ``capacity`` vectors; a vector is data in its own
    leaf and a query in those that its budget reaches. A leaf with more rows is cut into tiles of about ``capacity``
    rows of each kind, all of which meet. A tile gives counts and connections, never pairs; a pair counts in the first
    block that holds it alone. Rotation and trees are fitted to at most ``sample`` vectors (fewer if they are longer
    than 256) and decide only the work.

    Null ids get results but never name a component; where all of a component are null, so is its id. Repeated rows
    count each. No rows give no rows. Other columns are left out, so their names cannot clash.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    groups = rows.filter("sound").groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = settle(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")

    total = nodes.count()
    longest = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    models = {}
    if total:
        some = chosen(nodes.select("node", "embedding"), max(1, min(sample, 256 * sample // longest)), "node").toArrow()["embedding"].combine_chunks()
        sizes = np.diff(some.offsets.to_numpy())
        for d in np.unique(sizes):
            got = some.take(pa.array(np.flatnonzero(sizes == d)))
            models[int(d)] = index(_matrix(got, int(d)), similarity, total * len(got) // len(some), width, capacity)

    blocks = _counts(nodes.select("node", "copies", "embedding"), models, similarity, capacity)
    found = settle(_links(_tiles(nodes, models, similarity, blocks), models, similarity), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    ids = nodes.select("node", "first_id")
    named = roots.join(ids, "node")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    figures = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(figures, "node", "left").join(named, "node", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.filter("sound").join(classes, "embedding").select("vec_id", "n_links", "component_id").unionByName(
        rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
