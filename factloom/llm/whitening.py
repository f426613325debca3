"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise TSQR.

1. Entries become whole numbers, so that copies are alike and sums are exact.  The fit
   list holds each distinct vector once.
2. Each task reduces its centred rows, batch by batch, to a triangle R with R'R equal to
   their products; triangles are stacked and reduced in groups until one is left.  Its
   size is the square of the dimension, whatever the number of rows.
3. Plane rotations make the columns of that R orthogonal, pair by pair.  The products of the
   rotations are the components, the norms of the columns their standard deviations
   times the root of the number of rows.  No covariance is ever formed, so that small
   deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import beside, partitions, ship, written

#: Whole numbers to one unit of an entry.
SCALE = 256
#: Entries beyond this count as this.
LARGEST = 1 << 62
#: Triangles that one task stacks.
FAN_IN = 16
#: Rotations end when all pairs of columns are orthogonal to this share of their norms, times the root of the dimension.
ORTHOGONAL = 1e-15
#: Components whose deviation is a smaller share of the greatest are rounding errors, not components.
RANK_SHARE = 1e-12
_LONG = 1 << 63


def whole_vectors(embeddings: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite, with ``x``, the entries in whole numbers."""
    c = F.col(f"`{column}`")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(c.isNotNull() & finite & (F.size(c) > 0)).withColumn("x", F.transform(c, lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST))))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, one a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n, rounded once where n * x fits in 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(sums).max(initial=0)) < _LONG:
        return (n * x - sums.astype(np.int64)) / n
    return x - sums.astype(float) / n


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def reduced(frames: Iterator[np.ndarray], d: int) -> np.ndarray | None:
    """The triangle of all rows of some blocks, which pass one by one."""
    r = None
    for rows in frames:
        if len(rows):
            r = triangle(rows if r is None else np.vstack([r, rows]))
    return r


def _triangles(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for part, r in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])


def tall_skinny_r(fit: DataFrame, sums: np.ndarray, n: int) -> np.ndarray:
    """R of the centred vectors of ``fit`` (column x): a triangle for each task, then triangles of FAN_IN triangles until one is left."""
    d = len(sums)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = reduced((centred(matrix(b.column(0)), sums, n) for b in batches), d)
        if r is not None:
            yield from _triangles(iter([(TaskContext.get().partitionId(), r)]))

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part: a part's triangles follow one another
        part, r = None, None
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(raw, dtype="<f8").reshape(-1, d)
                if p != part:
                    if r is not None:
                        yield from _triangles(iter([(part, r)]))
                    part, r = p, block
                else:
                    r = triangle(np.vstack([r, block]))
        if r is not None:
            yield from _triangles(iter([(part, r)]))

    schema, found = "part long, r binary", fit.select("x").mapInArrow(first, "part long, r binary")
    blocks = fit.rdd.getNumPartitions()
    while blocks > FAN_IN:
        blocks = -(-blocks // FAN_IN)
        found = found.select(F.floor(F.col("part") / FAN_IN).alias("part"), "r").repartition(min(blocks, partitions(fit.sparkSession)), "part").sortWithinPartitions("part").mapInArrow(stacked, schema)
    last = [np.frombuffer(row.r, dtype="<f8").reshape(-1, d) for row in found.orderBy("part").collect()]
    r = reduced(iter(last), d)
    return np.zeros((d, d)) if r is None else np.vstack([r, np.zeros((d - len(r), d))])


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns in rounds of disjoint pairs, as in a tournament (d even)."""
    ring, out = list(range(d)), []
    for _ in range(d - 1):
        out.append((np.array(ring[: d // 2]), np.array(ring[: d // 2 - 1 : -1])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, rotations): r @ rotations has orthogonal columns with these norms, greatest first.

    Each round rotates disjoint pairs of columns by the angles that make them orthogonal;
    sweeps end when no pair is further from it than rounding in its product allows.
    """
    d = r.shape[1]
    even, enough = d + d % 2, ORTHOGONAL * max(1.0, d**0.5)
    columns, turned = np.zeros((even, len(r))), np.eye(even)  # a column is a row here, so that a pair lies together
    columns[:d] = r.T
    greatest = np.abs(columns).max(initial=0)
    if greatest:
        columns /= greatest
    rounds = _rounds(even) if d > 1 else []
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = columns[p], columns[q]
            xx, yy, xy = (np.einsum("ij,ij->i", *m) for m in ((x, x), (y, y), (x, y)))
            scale = np.sqrt(xx * yy)
            off = np.where(scale > 0, np.abs(xy) / np.where(scale > 0, scale, 1), 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > enough
            if not turn.any():
                continue
            zeta = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0)[:, None]
            c = 1 / np.hypot(1, t)
            s = c * t
            columns[p], columns[q] = c * x - s * y, s * x + c * y
            x, y = turned[p], turned[q]
            turned[p], turned[q] = c * x - s * y, s * x + c * y
        if worst <= enough:
            break
    norms = np.sqrt((columns * columns).sum(1))[:d] * greatest
    order = np.argsort(-norms, kind="stable")
    return norms[order], turned[:d, :d][order].T


def exact_deviation(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """The sum over the dimensions of (n * x - sums) squared, as whole numbers; None where it doesn't fit in a long."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(sums).max(initial=0))
    if most * most * max(1, x.shape[1]) < _LONG:
        far = n * x - sums.astype(np.int64)
        return (far * far).sum(1).tolist()
    out = []
    for row in x.tolist():
        total = sum((n * a - b) ** 2 for a, b in zip(row, map(int, sums), strict=True))
        out.append(total if total < _LONG else None)
    return out


class Whitening:
    """The fitted transformation: ``n`` vectors with ``sums``, and the leading ``components`` (columns) with their eigenvalues."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray, most: int):
        norms, rotations = one_sided_jacobi(r)
        self.n, self.sums = n, sums
        kept = [j for j in range(min(most, len(norms))) if norms[j] > RANK_SHARE * norms[0]]
        self.components = rotations[:, kept]
        self.deviations = norms[kept] / np.sqrt(n)
        self.explained = norms[kept] ** 2 / (norms**2).sum() if kept else np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n) @ self.components / self.deviations


def exact_sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their sum in each dimension, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            x = matrix(batch.column(0))
            small = int(np.abs(x).max(initial=0)) < _LONG // (len(x) + 1)
            if len(x):
                n, total = n + len(x), total + np.array((x if small else x.astype(object)).sum(0).tolist(), dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(v) for v in (*total, n)])], ["at", "value"])

    rows = fit.select("x").mapInArrow(run, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {row["at"]: int(row["value"]) for row in rows}
    return by.get(d, 0), np.array([by.get(i, 0) for i in range(d)], dtype=object)


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """The greatest entry, by amount, of the covariance of the whitened fit list minus the identity; measured on all its vectors."""
    k = fitted.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fitted(matrix(batch.column(0)))
            total, products = total + w.sum(0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*total, *products.ravel()], pa.float64())], ["at", "value"])

    if not k:
        return 0.0
    by = {row["at"]: row["value"] for row in fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([by[i] for i in range(k)]) / fitted.n
    covariance = np.array([by[i] for i in range(k, k + k * k)]).reshape(k, k) / fitted.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = 4, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Whiten vectors: the ``keep`` columns and those of OUT, a row for each vector and leading component.

    A vector that is null, empty, or holds a null, NaN or infinite entry is dropped, and so are those of another
    dimension than most have (of equal numbers the greater dimension stays).  Each entry
    becomes floor(256 * entry), held within 2**62.  The fit list is each distinct vector once;
    vectors that repeat get equal rows.  Components whose deviation is zero (fewer distinct vectors than
    components, one vector only, equal entries) aren't returned, so there may be no rows; no vectors: no rows.  Equal
    eigenvalues leave their components open up to a rotation.  ``deviation`` is null where it
    doesn't fit in a long (from some 10**8 distinct vectors of unit length on).  Kept columns whose name is taken get ``in_`` before it.

    Vectors are shuffled once, to find the distinct ones; copies meet within their tasks first.  What comes to the driver is a triangle for each
    16 tasks at most, in the end a few, of the dimension's square each, and some sums; what is broadcast is d * 4 numbers.
    """
    spark = embeddings.sparkSession
    ship(spark)
    names = beside(keep, tuple(c.split()[0] for c in OUT.split(", ")))
    result = ", ".join([*(f"`{names[c]}` {embeddings.schema[c].dataType.simpleString()}" for c in names), OUT])
    whole = whole_vectors(embeddings.select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)], F.col(f"`{column}`").alias("vector")), "vector").drop("vector")
    distinct = written(spark, whole.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    d = sizes[0].d
    fit = distinct.where(F.size("x") == d)
    n, sums = exact_sums(fit, d)
    fitted = Whitening(n, sums, tall_skinny_r(fit, sums, n), components)
    error = identity_error(fit, fitted)
    k, width = fitted.components.shape[1], len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(width))
            rows, again = len(x), np.repeat(np.arange(len(x)), k)
            made = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, dtype=np.int64)),
                pa.array(exact_deviation(x, sums, n) if rows else [], pa.int64()).take(pa.array(again)),
                pa.array(fitted(x).ravel() if rows else np.zeros(0)),
                pa.array(np.tile(fitted.explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            fields = [*(names[c] for c in names), *(c.split()[0] for c in OUT.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(again)) for i in range(width)), *made], fields)

    return whole.where(F.size("x") == d).select(*[f"kept_{i}" for i in range(width)], "x").mapInArrow(run, result)
