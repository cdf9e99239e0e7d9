"""Embedding whitening: principal directions by matrix-free block Lanczos, then every vector on unit-variance components.

Entries are taken as integers, ``x = floor(64 c) + 1000000``, so that counts, sums and deviations are exact. With n vectors
and sums S of each dimension, a vector's centred form is ``(n x - S) / n``, whose numerator is an exact integer.

Method
1. One pass over the stored integers adds up n and S.
2. The covariance V is never formed. For a block Q of ``BLOCK`` directions one pass computes ``Y = Xc Q`` and
   ``Xc' Y / n = V Q`` within the tasks; their sums, one row for each dimension, are all that reaches the driver.
3. The next block is what V Q adds to the basis, orthogonalised twice against all of it. A direction in which nothing is left
   is a breakdown (the basis is invariant there): the search restarts there from a random direction orthogonal to the basis.
4. Rayleigh-Ritz on the basis gives values, vectors and their true residuals. The search ends when the basis is the whole
   space, or when the residuals of the components asked for are within ``TOLERANCE`` of the largest eigenvalue and stay so,
   with equal values, after a restart with a random block (which finds copies of an eigenvalue that the first one missed).
5. ``trace(V)`` is the exact sum of all deviations over n cubed; shares of it are the explained shares. One more pass measures
   the covariance of the whitened rows.

The driver holds the basis: at most two matrices of dimension x dimension.

Defined results: vectors that are null or empty or hold null or non-finite entries are left out, and so are those whose
dimension is not the one that most vectors have (of equally frequent ones, the largest); a null vec_id is kept as it is;
repeated rows count each; entries beyond 2^52 / 64 count as that; a component without variance (``FLAT`` of the largest
eigenvalue or less, so also all of a single or constant vector) is whitened to null and explains 0 where there is no variance
at all; without usable vectors the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOP, BLOCK = 32, 16
#: Residuals at which a component counts as found, and variances that count as none, both of the largest eigenvalue.
TOLERANCE, FLAT = 1e-13, 1e-11
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_SOUND = "size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
_MOST = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float
    identity_error: float

    def flat(self) -> np.ndarray:
        return self.values <= FLAT * max(self.values[:1], default=0.0)

    def projection(self) -> np.ndarray:
        """Dimensions x components; those without variance are zero."""
        return np.where(self.flat(), 0.0, self.vectors / np.sqrt(np.where(self.flat(), 1.0, self.values)))


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(f"coalesce({_SOUND}, false)")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), 64 * c))).cast("long") + 1000000)
    return rows.where(F.size("embedding") == (sizes["dim"] if sizes else 0)).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole_sum(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    far = max(int(x.max()), -int(x.min()))
    return [int(v) for v in (x if far * len(x) < 1 << 62 else x.astype(object)).sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows less the mean, as doubles, and the sums of squares of ``n x - S``, as exact integers."""
    far = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums))
    off = x * n - np.array(sums) if far < 1 << 62 else x.astype(object) * n - np.array(sums, object)
    wide = int(np.abs(off).max()) ** 2 * x.shape[1] >= 1 << 62
    squares = off.astype(object) if wide else off
    return off.astype(float) / n, (squares * squares).sum(axis=1)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    def add(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = _whole_sum(_matrix(batch.column(0)))
                total, n = part if total is None else [a + b for a, b in zip(total, part)], n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1) - 1, pa.int32()), _decimals([n, *total])], names=["d", "s"])

    got = rows.select("x").mapInArrow(add, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("d").collect()
    return (int(got[0]["s"]), [int(r["s"]) for r in got[1:]]) if got else (0, [])


def _products(rows: DataFrame, n: int, sums: list[int], left: np.ndarray | None, right: np.ndarray) -> tuple[np.ndarray, int]:
    """``L'R`` summed over all rows, and the sum of all deviations; R is ``Xc right``, L is Xc or ``Xc left`` and a column of ones."""
    wide, names = right.shape[1], ["row", *(f"z{k}" for k in range(right.shape[1])), "deviation"]

    def add(batches):
        total, away = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                c, squares = centred(_matrix(batch.column(0)), n, sums)
                one = c if left is None else np.column_stack([c @ left, np.ones(len(c))])
                total, away = total + one.T @ (c @ right), away + int(squares.astype(object).sum())
        if not np.isscalar(total):
            rest = [away, *[0] * (len(total) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(z) for z in np.ascontiguousarray(total.T)), _decimals(rest)], names=names)

    schema = f"row int, {', '.join(f'z{k} double' for k in range(wide))}, deviation decimal(38,0)"
    summed = rows.select("x").mapInArrow(add, schema).groupBy("row").agg(*(F.sum(f"z{k}").alias(f"z{k}") for k in range(wide)), F.sum("deviation").cast("decimal(38,0)").alias("deviation"))
    got = summed.orderBy("row").collect()  # a row for each dimension
    return np.array([[r[f"z{k}"] for k in range(wide)] for r in got]), sum(int(r["deviation"]) for r in got)


def _onto(basis: np.ndarray, block: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal directions that ``block`` adds to ``basis``; where nothing is left of one, a random direction instead."""
    out = basis
    for v in block.T:
        for attempt in range(8):
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = float(np.linalg.norm(v))
            if left > (1e-10 * scale if attempt == 0 else 1e-3):
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v = rng.normal(size=len(basis)) / np.sqrt(len(basis))
        if out.shape[1] == len(basis):
            break
    return out[:, basis.shape[1] :]


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, top: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric positive operator, falling, and its eigenvectors as columns."""
    rng = np.random.default_rng(dim)
    basis = image = np.zeros((dim, 0))
    following, before = _onto(basis, rng.normal(size=(dim, min(block, dim))), 1.0, rng), None
    while True:
        made = multiply(following)
        basis, image = np.column_stack([basis, following]), np.column_stack([image, made])
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = np.maximum(values[::-1][:top], 0.0), mix[:, ::-1][:, :top]
        vectors, scale = basis @ mix, max(float(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == dim:
            return values, vectors
        residual = np.linalg.norm(image @ mix - vectors * values, axis=0)
        settled = len(values) == top and residual.max() <= tolerance * scale
        if settled and before is not None and np.abs(values - before).max() <= 10 * tolerance * scale:
            return values, vectors
        restart = settled and before is None
        before = values if settled else before if before is not None and len(values) == top and np.abs(values - before).max() <= 10 * tolerance * scale else None
        following = _onto(basis, rng.normal(size=(dim, min(block, dim))) if restart else made, scale if not restart else 1.0, rng)


def fitted(rows: DataFrame, top: int = TOP) -> Fit | None:
    """The fit of ``rows`` (x), or None where there are none."""
    n, sums = _sums(rows)
    if not n:
        return None
    away = []

    def multiply(q: np.ndarray) -> np.ndarray:
        z, total = _products(rows, n, sums, None, q)
        away.append(total)
        return z / n

    values, vectors = lanczos(multiply, len(sums), min(top, len(sums)))
    made = Fit(n, sums, values, vectors, float(Fraction(away[0], n**3)), 0.0)
    scaled, flat = made.projection(), made.flat()
    seen, _ = _products(rows, n, sums, scaled, scaled)
    cov = seen[:-1] / n - np.outer(seen[-1], seen[-1]) / n**2
    off = np.abs(cov - np.eye(len(cov)))[np.ix_(~flat, ~flat)]
    return Fit(n, sums, values, vectors, made.trace, float(off.max(initial=0.0)))


def whitened(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each vector that takes part and component up to ``top``: see ``SCHEMA``."""
    spark = vectors.sparkSession
    rows, _ = common.stored(integers(vectors), "whitening-integers")
    fit = fitted(rows, top)
    if fit is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(fit)

    def spread(batches):
        fit = shared.value
        scaled, flat, k = fit.projection(), fit.flat(), len(fit.values)
        share = fit.values / fit.trace if fit.trace else np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                c, squares = centred(_matrix(part.column(1)), fit.n, fit.sums)
                rows = len(c)
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, fit.n)), _decimals(squares).take(again),
                        pa.array((c @ scaled).ravel(), mask=np.tile(flat, rows)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, fit.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(spread, SCHEMA)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on 32 components; the exact deviation as a long, which is an error beyond its range."""
    return whitened(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
