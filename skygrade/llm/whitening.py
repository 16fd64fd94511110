"""Embeddings on uncorrelated axes of unit variance.

Vectors enter as whole numbers, so their sums and products are exact and do not
depend on how the table is cut. Tasks add up products, Spark adds up the tasks,
and the driver gets one triangle of width x width numbers, however many rows
there are. That centred scatter is factored by a Cholesky with diagonal pivots;
a one-sided Jacobi then rotates the columns of the triangular factor until they
are orthogonal. Their squared norms are the eigenvalues, the normalised columns
the components.

Defined results: a vector is dropped if it is null, holds a null, a NaN or an
entry beyond 2**40 either way, or has not the length that most vectors have (the
longer of equally frequent ones). Equal rows and rows without an id count as
they come. Components without variance have a null projection and explain 0
(null if nothing varies at all). An empty table gives an empty table. Only the
key and the vector are read, other columns cannot clash.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch, as_batches

#: Fixed values of the query: x = floor(1024 * c) + 100000.
SCALE, SHIFT = 1024, 100_000

LARGEST = float(1 << 40)
EXACT = 1 << 53  # doubles hold whole numbers up to here
DECIMAL = pa.decimal128(38, 0)


def fixed_point(frame: DataFrame, key="vec_id", vector="embedding", scale=SCALE, shift=SHIFT) -> DataFrame:
    """key, x: sound vectors as arrays of longs."""
    sound = lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST)  # noqa: E731  NaN is above every number
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift)
    kept = frame.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("x")).where(F.col("x").isNotNull())
    return kept.where(F.forall("x", sound)).select("key", F.transform("x", whole).alias("x"))


def matrix(column, width: int, origin: np.ndarray) -> np.ndarray:
    """Rows of an Arrow list column, less ``origin``; Python integers where longs could overflow later."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width) - origin


def products(x: np.ndarray) -> np.ndarray:
    """x'x without rounding, as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most >= EXACT:
        wide = x.astype(object)
        return wide.T @ wide
    total, rows = np.zeros((x.shape[1],) * 2, object), EXACT // max(1, most * most)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def moments(vectors: DataFrame, width: int, origin: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and sums of products, exact; every task sends one triangle, which Spark adds up."""

    def run(batches):
        n, sums, total = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), width, origin)
                n += len(x)
                sums += x.sum(axis=0).astype(object)
                total += products(x)
        if n:
            upper = np.triu_indices(width)
            # Row -1 holds the sums, row -2 the number of rows.
            i = np.concatenate([upper[0], np.full(width, -1), [-2]]).astype(np.int32)
            j = np.concatenate([upper[1], np.arange(width), [0]]).astype(np.int32)
            values = [Decimal(v) for v in [*total[upper], *sums, n]]
            yield from as_batches([i, j, pa.array(values, DECIMAL)], ["i", "j", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)")
    n, sums, total = 0, np.zeros(width, object), np.zeros((width, width), object)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)")).collect():
        if i >= 0:
            total[i, j] = total[j, i] = int(v)
        elif i == -1:
            sums[j] = int(v)
        else:
            n = int(v)
    return n, sums, total


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor f (one column for each pivot, largest remaining diagonal first) and the order of rows: a[order][:, order] = f f'."""
    rest, d = np.array(a, float), len(a)
    factor, order = np.zeros((d, d)), np.arange(d)
    floor = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0), 0)
    for k in range(d):
        at = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[at, at] <= floor:
            return factor[:, :k], order
        for m in (rest, rest.T, factor, order):
            m[[k, at]] = m[[at, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds(r: int):
    """Each pair of 0 .. r-1 once, in rounds of disjoint pairs, as in a tournament."""
    ring = list(range(r + r % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if max(a, b) < r]
        yield np.array(pairs, int).reshape(-1, 2).T
        ring.insert(1, ring.pop())


def one_sided_jacobi(factor: np.ndarray, sweeps=60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal; a round's disjoint pairs turn at once."""
    f, small = np.array(factor, float), np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(f.shape[1]):
            left, right = f[:, p], f[:, q]
            alpha, beta = (left * left).sum(axis=0), (right * right).sum(axis=0)
            gamma = (left * right).sum(axis=0)
            turn = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if turn.any():
                turned = True
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                left, right = left[:, turn], right[:, turn]
                f[:, p[turn]], f[:, q[turn]] = c * left - c * t * right, c * t * left + c * right
        if not turned:
            break
    return f


def principal_axes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and their unit eigenvectors as columns, the largest entry of each positive."""
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    rank = np.argsort(-norms, kind="stable")
    axes = np.empty_like(turned)
    axes[order] = turned / norms
    axes = axes[:, rank]
    if axes.size:
        axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return norms[rank] ** 2, axes


def projected(vectors: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray, origin: np.ndarray, components: int) -> DataFrame:
    """key, deviation (sum of squares of n * x - sums, exact), whitened (null beyond the given axes)."""
    width = len(origin)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), width, origin)
            most = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in sums)
            away = x * n - sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * n - sums
            square = (away * away if width * most * most < 1 << 63 else away.astype(object) ** 2).sum(axis=1).tolist()
            out = np.full((len(x), components), np.nan)
            out[:, : axes.shape[1]] = (away.astype(np.float64) / n) @ axes
            flat = pa.array(out.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, components), pa.int32()), flat)
            held = [Decimal(v) if v < 10**38 else None for v in square]
            yield from as_batches([batch.column("key"), pa.array(held, DECIMAL), lists], ["key", "deviation", "whitened"])

    return vectors.mapInArrow(run, "key long, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of the first k projections less the identity, both passes in Spark."""
    if not k:
        return None
    w = [F.col("whitened")[i] for i in range(k)]
    means = rows.agg(*[F.avg(x) for x in w]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, components=8) -> DataFrame:
    """One row for each vector of (key, x) and component: key, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact, and null where it has more than 38 digits.
    """
    spark = vectors.sparkSession
    schema = "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    most = vectors.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))
    common = most.where("w > 0").orderBy(F.desc("n"), F.desc("w")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width, origin = common.w, np.array(common.x, np.int64)
    vectors = vectors.where(F.size("x") == width)
    n, sums, total = moments(vectors, width, origin)
    scatter = n * total - np.outer(sums, sums)
    values, axes = principal_axes((scatter / (n * n)).astype(float))
    trace = int(scatter.trace()) / (n * n)
    shown = min(components, width)
    kept = min(shown, len(values))
    scaled = axes[:, :kept] / np.sqrt(values[:kept])
    rows = Scratch(spark).write(projected(vectors, n, sums, scaled, origin, shown), "whitened")
    share = [float(values[i] / trace) if i < kept else 0.0 if trace else None for i in range(shown)]
    error = identity_error(rows, kept)
    part = rows.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return part.select(
        "key",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(s).cast("double") for s in share])[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
