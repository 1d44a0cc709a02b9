"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

``X``, the centred rows, lies in Spark and is never gathered. A step multiplies it by a vector of the driver and the
result's columns by its transpose, in one pass over the rows:

    alpha[j] u[j] = X v[j] - beta[j-1] u[j-1],        beta[j] v[j+1] = X' u[j] - alpha[j] v[j]

The ``u`` are as long as the table. As every one of them is ``X y`` for a short ``y``, a task works the entries of its
own rows out from these rows and all ``y``; so no long vector is kept anywhere, and a lost executor's rows are just read
again. Of each pass only sums come back: ``U' w`` for the reorthogonalisation, ``X' w`` and ``w' w``. Both sides are
reorthogonalised in full; where little is left of a vector, once more.

The singular value decomposition of the small bidiagonal matrix gives the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise

#: A component c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Lanczos goes through all dimensions, up to this many; beyond, it ends when the wanted components have converged.
ALL_DIMENSIONS = 512
#: Vectors of sums that the driver adds up.
MOST_SUMS = 64
#: Share of a vector that may be left before it is orthogonalised again, and under which it counts as nothing.
LITTLE, NOTHING = 0.5, 1e-12


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, as rows."""
    column = batch.column(batch.num_columns - 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integer_vectors(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, x``: the rows that take part, as whole numbers. Those left out are null or hold null or non-finite entries."""
    c = F.transform(column, lambda v: v.cast("double"))
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT)
    return vectors.filter(F.coalesce(F.col(column).isNotNull() & fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


def pass_over(rows: DataFrame, dims: int, tasks: int, kind: str, part) -> np.ndarray:
    """The sum of ``part(x)`` over all batches ``x`` of the rows' vectors: one vector, summed within tasks.

    Where there are many ``tasks``, others add up what these give, so that the driver gets ``MOST_SUMS`` vectors at most.
    """

    def add(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = of(batch)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])

    schema = f"sums array<{kind}>"
    vectors = lambda batch: np.stack([v.values.to_numpy() for v in batch.column(0)]).sum(axis=0)
    sums = rows.select("x").mapInArrow(lambda b: add(b, lambda batch: part(_matrix(batch, dims))), schema)
    if tasks > MOST_SUMS:
        sums = sums.repartition(MOST_SUMS).mapInArrow(lambda b: add(b, vectors), schema)
    return np.sum([r["sums"] for r in sums.collect()], axis=0)


class Centre:
    """Exact sums of all vectors; ``of(x)`` gives centred rows, ``exact(x)`` these times the number of rows."""

    def __init__(self, rows: DataFrame, dims: int, tasks: int):
        # sums of what lies above the shift and of squares stay small and exact
        found = pass_over(rows, dims, tasks, "long", lambda x: np.concatenate([[len(x)], (x - SHIFT).sum(axis=0)]))
        self.n, self.sums = int(found[0]), found[1 : 1 + dims]

    def exact(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x - SHIFT) - self.sums

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x) / self.n


def bidiagonalise(rows: DataFrame, centre: Centre, dims: int, tasks: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) of the centred rows and their singular values, largest first, ``wanted`` or more."""
    rng = np.random.default_rng(11)
    v, y, across = np.empty((dims, 0)), np.empty((dims, 0)), np.empty((dims, 0))  # all v; all y; X' u of each u
    alphas: list[float] = []
    betas: list[float] = []
    largest = 0.0

    def products(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For ``w = X z``: ``U' w``, ``X' w`` and ``w' w``."""

        def part(x: np.ndarray) -> np.ndarray:
            x = centre.of(x)
            w = x @ z
            return np.concatenate([(x @ y).T @ w, np.zeros(dims - y.shape[1]), x.T @ w, [w @ w]])

        found = pass_over(rows, dims, tasks, "double", part)
        return found[: y.shape[1]], found[dims : 2 * dims], float(found[2 * dims])

    def orthogonal(new: np.ndarray) -> np.ndarray:
        for _ in range(2):
            new = new - v @ (v.T @ new)
        return new

    def fresh() -> np.ndarray:
        new = orthogonal(rng.standard_normal(dims))
        return new / np.linalg.norm(new)

    following = fresh()
    while True:
        v = np.column_stack([v, following])
        j = v.shape[1] - 1
        z = following - (betas[-1] * y[:, -1] if betas else 0)
        before = None
        for _ in range(4):
            common, back, square = products(z, y)
            # w loses its share in U
            z, back, left = z - y @ common, back - across @ common, max(square - common @ common, 0.0)
            whole, before = max(square, before or 0.0), square
            if left > LITTLE**2 * square or left <= (NOTHING * largest) ** 2:
                break
        alpha = float(np.sqrt(left)) if left > (NOTHING * max(largest, np.sqrt(whole))) ** 2 else 0.0
        largest = max(largest, alpha)
        alphas.append(alpha)
        scale = 1 / alpha if alpha else 0.0
        y, across = np.column_stack([y, z * scale]), np.column_stack([across, back * scale])
        if j + 1 == dims:
            break
        new = orthogonal(across[:, -1] - alpha * following)
        beta = float(np.linalg.norm(new))
        largest = max(largest, beta)
        if beta <= NOTHING * largest:
            beta, following = 0.0, fresh()  # all that this vector leads to is found
        else:
            following = new / beta
        betas.append(beta)
        if dims > ALL_DIMENSIONS and j + 1 >= wanted:
            left_vectors, singular, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[:-1], 1))
            if beta and (beta * np.abs(left_vectors[-1, :wanted]) <= NOTHING * singular[0]).all():
                break
    k = len(alphas)
    _, singular, right = np.linalg.svd(np.diag(alphas) + np.diag(betas[: k - 1], 1))
    return v @ right.T, singular


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row of ``vectors`` that takes part and each component up to ``components``:

    ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    Rows whose vector is null or holds a null or non-finite entry take no part. Each entry ``c`` counts as
    ``x = floor(64 c) + 1000000``. ``deviation`` is the exact sum over dimensions of ``(n x - S)^2``, an error if it does
    not fit a long. Components without any variance (of rows that lie in a smaller space, or of a single row) have
    ``whitened`` 0 and are left out of ``identity_error``; ``explained`` is 0 without any variance at all. There are no
    more components than dimensions. Vectors of different lengths are an error. Rows with equal or null ids count each by
    itself; other columns are ignored; an empty table gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialise(integer_vectors(vectors, id_column, column), "whitening")
    sized = rows.select(F.size("x").alias("dims"), F.spark_partition_id().alias("task"))
    least, dims, last = sized.agg(F.min("dims"), F.max("dims"), F.max("task")).first()
    if least != dims:
        raise ValueError(f"vectors of {least} to {dims} dimensions")
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    tasks = last + 1
    centre = Centre(rows, dims, tasks)
    count = min(components, dims)
    right, singular = bidiagonalise(rows, centre, dims, tasks, count)
    trace = float(pass_over(rows, dims, tasks, "double", lambda x: np.array([(centre.of(x) ** 2).sum()]))[0])
    right, singular = right[:, :count], singular[:count]
    held = singular > NOTHING * 10 * max(singular[0], 1e-300)
    scaled = right * np.where(held, np.sqrt(centre.n) / np.where(held, singular, 1.0), 0.0)
    explained = singular**2 / trace if trace else np.zeros(count)

    def covariance(x: np.ndarray) -> np.ndarray:
        z = centre.of(x) @ scaled
        return np.concatenate([z.sum(axis=0), (z.T @ z).reshape(-1)])

    moments = pass_over(rows, dims, tasks, "double", covariance)[: count + count * count] / centre.n
    mean, square = moments[:count], moments[count:].reshape(count, count)
    off = np.abs(square - np.outer(mean, mean) - np.eye(count))[np.ix_(held, held)]
    identity_error = float(off.max(initial=0.0))
    n = centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part, dims)
                exact, m = centre.exact(x), len(x)
                if (np.square(exact.astype(np.float64)).sum(axis=1) < 2.0**62).all():
                    deviation = np.square(exact).sum(axis=1)
                else:
                    deviation = [sum(e * e for e in map(int, row)) for row in exact]
                rank = np.arange(1, count + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), count))),
                        pa.array(np.tile(rank, m)),
                        pa.array(np.full(m * count, n)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), count))),
                        pa.array((exact / n @ scaled).reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * count, identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
