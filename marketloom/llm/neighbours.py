"""Approximate nearest neighbours by vantage-point trees, one in each shard.

Largest inner product becomes smallest distance by one more coordinate: with ``m`` the longest norm, a vector ``x`` is
extended by ``sqrt(m² - |x|²)`` and a query by 0; then ``|q - x|² = |q|² + m² - 2 q·x``.

1. Rows go to the nearest of some pivots; a pivot's rows are dealt to as many shards as they need, so that a shard is
   bounded whatever its pivot attracts. Of each pivot the least and the greatest distance to its rows are known.
2. Every shard's tree is built once and written. A node holds a vantage point and the median distance to it; the nearer
   half lies inside. A query goes to its side first and to the other one if ``gap <= factor * radius``, where ``gap`` is
   its distance to the boundary and ``radius`` that to its k-th best so far.
3. Every query searches its own shard first. What it finds there bounds the rest: it goes to the shards of a pivot only
   if its gap to their distances passes the same test. Shards read their tree once and the queries in blocks; where there
   are many queries, a shard's are dealt to several tasks, each with the tree.

There are as many pivots as cells of ``CELL_ROWS`` rows need, so that trees have inner nodes and a query is sent to few
shards.

By the triangle inequality ``factor`` 1 loses nothing; smaller ones prune more. All queries of a block descend together,
as arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import materialise

SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Pivots are a sample of rows, those of the smallest hashes, one for so many rows and ``PIVOTS`` at most, and the zero vector.
#: Every row is indexed.
CELL_ROWS, PIVOTS = 4096, 4096
#: Queries that one task takes to a shard at most, about.
SLOT_QUERIES = 65_536
LEAF = 128
FACTOR = 0.5
K = 20


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed coordinate by coordinate, so that equal vectors have equal products to the last bit.

    ``vectors`` are the same for all queries (two axes) or each query's own (three).
    """
    if vectors.ndim == 3:
        return (queries[:, None, :] * vectors).cumsum(2)[:, :, -1] + 0.0  # sums in the same order; no negative zero
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


class Tree:
    """A vantage-point tree over the rows of ``vectors`` (sorted by id)."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        norms = (vectors**2).sum(1)
        self.most = norms.max(initial=0.0)
        self.vectors = vectors
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(self.most - norms, 0))])
        self.leaf = leaf
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from the first: far vantage points cut sharper than central ones
        far = rows[np.argmax(((self.points[rows] - self.points[rows[0]]) ** 2).sum(1))]
        d = np.sqrt(((self.points[rows] - self.points[far]) ** 2).sum(1))
        radius = float(np.median(d))
        near = d <= radius
        if near.all():  # many equal rows
            near = np.arange(len(rows)) < len(rows) // 2
        return far, radius, self._build(rows[near]), self._build(rows[~near])

    def search(
        self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of each query's ``k`` best (score -inf: none), leaving out row ``own`` (-1: none).

        What scores less than ``floor`` is of no use and need not be found.
        """
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        score = np.full((len(queries), k), -np.inf)
        row = np.full((len(queries), k), len(self.vectors))
        points = np.column_stack([queries, np.zeros(len(queries))])
        square = (queries**2).sum(1)
        length = self.most + square
        # more than sums of products in two orders can differ by, twice
        slack = 4 * queries.shape[1] * np.finfo(float).eps * np.sqrt(square * self.most) + np.finfo(float).tiny

        def hopeful(node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Those of ``at`` that a leaf may better, and for each the rows that may (to the right: none), or for all the leaf.

            A matrix product is cheap and tells them up to rounding; only they are scored by ``inner``.
            """
            rough = queries[at] @ self.vectors[node].T
            rough[own[at, None] == node[None, :]] = -np.inf
            bar = np.maximum(score[at, -1], floor[at])
            new = np.isneginf(bar)
            if len(node) > k and new.any():
                bar[new] = np.partition(rough[new], -k, axis=1)[:, -k]
            near = ~(rough < (bar - slack[at])[:, None])
            times = near.sum(1)
            some = np.flatnonzero(times)
            if 4 * times.sum() > len(some) * len(node):  # many equal rows
                return at[some], node
            query, place = np.nonzero(near[some])
            begins = np.cumsum(times[some]) - times[some]
            rows = np.full((len(some), times.max(initial=0)), len(self.vectors))
            rows[query, np.arange(len(query)) - begins[query]] = node[place]
            return at[some], rows

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                at, rows = hopeful(node, at)
                s = inner(queries[at], self.vectors.take(rows, axis=0, mode="clip"))
                if not len(at):
                    return
                rows = np.broadcast_to(rows, s.shape)
                s[(rows == own[at, None]) | (rows == len(self.vectors))] = -np.inf
                every, rows = np.hstack([score[at], s]), np.hstack([row[at], rows])
                rows = np.where(np.isneginf(every), len(self.vectors), rows)
                best = np.lexsort((rows, -every))[:, :k]
                score[at], row[at] = np.take_along_axis(every, best, 1), np.take_along_axis(rows, best, 1)
                return
            far, radius, near, rest = node
            d = np.sqrt(np.maximum(((points[at] - self.points[far]) ** 2).sum(1), 0))
            for inside in (True, False):
                mine = (d <= radius) == inside
                visit(near if inside else rest, at[mine])
                left = at[mine]
                reach = np.sqrt(np.maximum(length[left] - 2 * np.maximum(score[left, -1], floor[left]), 0))
                visit(rest if inside else near, left[np.abs(d[mine] - radius) <= factor * reach + 1e-9])

        visit(self.root, np.arange(len(queries)))
        return score, row


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Pivots:
    """Points by which rows of one length are parted, and the distances of rows and queries to them."""

    def __init__(self, vectors: list[list[float]], size: int, most: float):
        self.most = most  # square of the longest norm
        self.vectors = np.vstack([np.zeros((1, size)), np.asarray(vectors, float).reshape(-1, size)])
        self.more = self._more(self.vectors)

    def _more(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (vectors**2).sum(1), 0))

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        common = vectors @ self.vectors.T + np.outer(self._more(vectors), self.more)
        return np.sqrt(np.maximum(2 * self.most - 2 * common, 0))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        square = (vectors**2).sum(1)[:, None] + self.most - 2 * vectors @ self.vectors.T
        return np.sqrt(np.maximum(square, 0))


SHARD = ["size", "cell", "part"]


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    pivots: int | None = None,
    slot_queries: int = SLOT_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row for whose ``id`` ``asks`` holds, its ``k`` nearest found.

    All rows are candidates but the query's own, also those that repeat its id; nearness is the largest inner product in
    double precision, ties go to the smaller id. Rows whose id or vector is null, or whose vector is empty, zero or has
    null or non-finite components take no part. Vectors of different lengths are not comparable: a query sees those of
    its own length. Fewer candidates than ``k`` are all returned; an empty table gives no rows. The driver holds the
    pivots and a line for each pivot and length of vectors.
    """
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = found.filter(F.col("id").isNotNull() & usable(F.col("v")))
    found = found.withColumns({"row": F.monotonically_increasing_id(), "size": F.size("v"), "asks": F.coalesce(asks, F.lit(False))})
    found = materialise(found, "vectors")  # numbered once
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    sizes = found.groupBy("size").agg(F.max(square).alias("most"), F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()
    longest = {r["size"]: r["most"] for r in sizes}
    if pivots is None:
        pivots = min(PIVOTS, sum(r["n"] for r in sizes) // CELL_ROWS)
    slots = max(1, -(-sum(r["asks"] for r in sizes) // slot_queries))
    sample = found.orderBy(F.xxhash64("id", "v"), "id", "row").limit(pivots).select("size", "v").collect()
    points = {size: Pivots([r["v"] for r in sample if r["size"] == size], size, most) for size, most in longest.items()}

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for s in np.unique(size):
                part = batch.filter(pa.array(size == s))
                d = points[s].of_rows(_matrix(part.column("v")))
                cell = d.argmin(1)
                yield part.append_column("cell", pa.array(cell, pa.int32())).append_column("d", pa.array(d[np.arange(len(d)), cell]))

    fields = "id long, v array<double>, row long, size int, asks boolean"
    cells = materialise(found.select("id", "v", "row", "size", "asks").mapInArrow(to_cells, f"{fields}, cell int, d double"), "cells")
    counted = cells.groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).collect()
    shards: dict[int, dict[str, np.ndarray]] = {}
    for s in longest:
        mine = sorted((r for r in counted if r["size"] == s), key=lambda r: r["cell"])
        shards[s] = {c: np.array([r[c] for r in mine]) for c in ("cell", "n", "least", "most")}
        shards[s]["parts"] = -(-shards[s]["n"] // shard_rows)
    parts = [(s, int(c), int(p)) for s, m in shards.items() for c, p in zip(m["cell"], m["parts"])]
    many = vectors.sparkSession.createDataFrame(parts, "size int, cell int, parts int")
    # as many rows as there are pivots and lengths
    placed = cells.join(F.broadcast(many), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(group).combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")])
            ids, rows = table.column("id").to_numpy(), table.column("row").to_numpy()
            made = pickle.dumps((ids, rows, Tree(_matrix(table.column("v").combine_chunks()))))
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([made], pa.binary())], [*SHARD, "tree"])

        key, group = None, []
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy() for c in SHARD])
            bounds = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(at)]
            for a, b in zip(bounds, bounds[1:]):
                if b > a and tuple(at[a]) != key:
                    if group:
                        yield tree()
                    key, group = tuple(at[a]), []
                if b > a:
                    group.append(batch.slice(a, b - a))
        if group:
            yield tree()

    rows = placed.select(*SHARD, "id", "row", "v").repartition(*SHARD).sortWithinPartitions(*SHARD)
    trees = materialise(rows.mapInArrow(build, "size int, cell int, part int, tree binary"), "trees")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> pa.RecordBatch:
            ids, rows, tree = shard
            order = np.argsort(rows)
            mine = np.array([q[0] for q in block], np.int64)
            at = np.minimum(np.searchsorted(rows[order], mine), len(rows) - 1)
            own = np.where(rows[order][at] == mine, order[at], -1)
            floor = np.array([q[3] for q in block])
            score, row = tree.search(np.array([q[2] for q in block]), own, k, factor, floor)
            have = ~np.isneginf(score) & (score >= floor[:, None])
            times = have.sum(1)
            columns = [np.repeat(mine, times), np.repeat(np.array([q[1] for q in block], np.int64), times), ids[row[have]], score[have]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "query_id", "vec_id", "score"])

        shard, block = None, []
        for batch in batches:
            for tree, row, i, v, floor in zip(*(batch.column(c).to_pylist() for c in ("tree", "row", "id", "v", "floor")), strict=True):
                if block and (tree is not None or len(block) >= query_rows):
                    yield answers()
                    block = []
                if tree is not None:
                    shard = pickle.loads(tree)
                else:
                    block.append((row, i, v, floor))
        if block:
            yield answers()

    def searched(queries: DataFrame) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        blank = {"tree": "binary", "row": "long", "id": "long", "v": "array<double>", "floor": "double"}
        columns = lambda df: df.select(*SHARD, *(F.col(c) if c in df.columns else none(t).alias(c) for c, t in blank.items()))
        slotted = columns(trees).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).unionByName(columns(queries).withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")))
        both = slotted.repartition(*SHARD, "slot").sortWithinPartitions(*SHARD, "slot", F.col("tree").isNull()).drop("slot")
        return both.mapInArrow(search, "row long, query_id long, vec_id long, score double")

    asked = placed.filter("asks").select(*SHARD, "row", "id", "v")
    first = materialise(searched(asked.withColumn("floor", F.lit(float("-inf")))), "first")
    floors = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for s in np.unique(size):
                part = batch.filter(pa.array(size == s))
                v, m, p = _matrix(part.column("v")), shards[s], points[s]
                d = p.of_queries(v)[:, m["cell"]]
                gap = np.maximum(np.maximum(m["least"] - d, d - m["most"]), 0)
                floor = part.column("floor").to_numpy()
                reach = np.sqrt(np.maximum((v**2).sum(1) + p.most - 2 * floor, 0))
                query, cell = np.nonzero(gap <= factor * reach[:, None] + 1e-9)
                times = m["parts"][cell]
                query, cell = np.repeat(query, times), np.repeat(m["cell"][cell], times)
                begins = np.cumsum(times) - times
                number = np.arange(len(query)) - np.repeat(begins, times)
                other = (cell != part.column("cell").to_numpy()[query]) | (number != part.column("part").to_numpy()[query])
                for at in range(0, len(query), query_rows):
                    some = np.flatnonzero(other[at : at + query_rows]) + at
                    sent = part.take(pa.array(query[some]))
                    columns = [sent.column("size"), pa.array(cell[some], pa.int32()), pa.array(number[some], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, *(sent.column(c) for c in ("row", "id", "v", "floor"))], [*SHARD, "row", "id", "v", "floor"])

    bounded = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    sent = bounded.mapInArrow(route, "size int, cell int, part int, row long, id long, v array<double>, floor double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    best = first.unionByName(searched(sent)).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
