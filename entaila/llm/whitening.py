"""Whitening of embeddings by Spark MLlib's `computeSVD` on centred rows.

1.  A vector becomes whole numbers x = floor(`scale` * c).  The fit list is each
    distinct x once (a `distinct`, so copies meet map-side), written to the
    shared folder.
2.  Sums S of each dimension and the size n of the fit list are exact integers.
3.  `RowMatrix.computeSVD` runs over the rows x - S/n, all of it in the JVM.  All
    singular values are asked for, so that it decomposes the Gram matrix by
    LAPACK to double precision (with few it would iterate to a tolerance).  An
    eigenvalue of the covariance is a singular value squared over n.
4.  The total variance does not come from the decomposition: it is the exact sum
    of (n*x - S)^2 over the fit list, over n^3.
5.  `identity_error` is measured on the whitened fit list, centred by its own
    mean before it is multiplied.

The Gram matrix of the dimensions is all that the driver holds (15,000 dimensions
at most, as MLlib demands).

Rows whose vector is null, empty or holds a null or a non-finite entry are left
out, and so are vectors of another length than the commonest (of two equally
common lengths the larger counts).  Repeated rows and ids are all returned, null
ids too.  Components whose variance is below 1e-12 of the largest, which double
precision cannot tell from 0, have a null `whitened` and 0 for `explained`, which
is null if all vectors are equal.  A vector of fewer dimensions has fewer
components.  Of a component's two signs the one whose largest entry (ties: the
first) is positive is taken.  An entry whose x does not fit 64 bits is an error.
Empty tables give no rows; other columns, of any names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, stored, table

SCALE, COMPONENTS = 256, 4
#: Singular values below this share of the largest are taken for 0.
LEAST_SINGULAR = 1e-6


@dataclass
class Whitening:
    n: int  #: vectors of the fit list
    sums: list[int]  #: exact sums of each dimension
    mean: np.ndarray
    eigenvalues: np.ndarray  #: of the components kept, falling; 0 where there is no variance
    vectors: np.ndarray  #: (dimension, component)
    trace: float  #: total variance
    identity_error: float | None = None

    @property
    def projection(self) -> np.ndarray:
        """x - S/n times this is whitened; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, self.vectors / np.sqrt(self.eigenvalues), np.nan)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that take part."""
    ok = "size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(ok)
    common = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return rows.filter(F.size("v") == F.lit(common["k"] if common else 0)).select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(total: int) -> tuple[int, int]:
    """An integer of any size as two that sum up without overflow."""
    return total >> 56, total & ((1 << 56) - 1)


def _add_up(df: DataFrame, numbers: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The exact sums over all batches of the integers that `numbers` gives of a batch of x."""
    ddl = "at int, hi decimal(38,0), lo decimal(38,0)"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = [_parts(int(v)) for v in numbers(_matrix(batch.column(0)))]
                cols = [range(len(got)), [Decimal(h) for h, _ in got], [Decimal(lo) for _, lo in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = df.select("x").mapInArrow(run, ddl).groupBy("at").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()  # a row for each number
    out = [0] * len(rows)
    for r in rows:
        out[r["at"]] = (int(r["hi"]) << 56) + int(r["lo"])
    return out


def _columns_sum(x: np.ndarray) -> list[int]:
    high, low = (x >> 30).sum(0), (x & ((1 << 30) - 1)).sum(0)
    return [(int(h) << 30) + int(v) for h, v in zip(high, low, strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """sum over dimensions of (n*x - S)^2, exact: 64-bit integers where they fit, else Python's."""
    far = float(np.abs(x.astype(float)).max(initial=0)) * n + max(map(abs, sums), default=0)
    if far * far * x.shape[1] < 2.0**62:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1)
    d = x.astype(object) * n - np.array(sums, object)
    return (d * d).sum(1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of `vectors`; None if there are none."""
    rows = stored(vectors.select("x").distinct())
    sums = _add_up(rows, lambda x: [len(x), *_columns_sum(x)])
    if not sums:
        return None
    n, sums = sums[0], sums[1:]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    kept = min(components, len(sums))
    total = _add_up(rows, lambda x: [int(sum(map(int, deviations(x, n, sums))))])[0]
    w = Whitening(n, sums, mean, np.zeros(kept), np.zeros((len(sums), kept)), float(Fraction(total, n**3)))
    if total:
        centre = F.array(*[F.lit(float(m)) for m in mean])
        centred = rows.select(array_to_vector(F.zip_with("x", centre, lambda a, m: a - m)).alias("v"))
        svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(sums)).computeSVD(len(sums), False, LEAST_SINGULAR)
        values, found = svd.s.toArray() ** 2 / n, svd.V.toArray()
        kept = min(kept, len(values))
        v = found[:, :kept]
        w.vectors[:, :kept] = v * np.sign(v[np.abs(v).argmax(0), np.arange(kept)])
        w.eigenvalues[:kept] = values[:kept]
        w.identity_error = _identity_error(rows, w, kept)
    return w


def _identity_error(rows: DataFrame, w: Whitening, kept: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    projection, mean, n = w.projection[:, :kept], w.mean, w.n

    def total(numbers: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        schema = arrow_schema("at int, v double")

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    got = numbers((_matrix(batch.column(0)) - mean) @ projection).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], schema=schema)

        got = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # at most components^2 rows
        return np.array([r["v"] for r in got])

    middle = total(lambda y: y.sum(0)) / n
    cov = total(lambda y: (y - middle).T @ (y - middle)).reshape(kept, kept) / n
    return float(np.abs(cov - np.eye(kept)).max())


def whiten(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error) of every row (id, x)."""
    ddl = f"id {dict(vectors.dtypes)['id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = arrow_schema(ddl)
    k = len(w.eigenvalues)
    share = [float(e / w.trace) if w.trace else None for e in w.eigenvalues]

    def run(batches):
        for batch in batches:
            x, rows = _matrix(batch.column(1)) if batch.num_rows else None, batch.num_rows
            if not rows:
                continue
            white = ((x - w.mean) @ w.projection).ravel()
            far = deviations(x, w.n, w.sums)
            far = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype == np.int64 else pa.array([Decimal(v) for v in far], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(rows), k))
            cols = [batch.column(0).take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, w.n), far.take(at), pa.array(white, mask=np.isnan(white)), pa.array(share * rows, pa.float64()), pa.array([w.identity_error] * (rows * k), pa.float64())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return vectors.mapInArrow(run, ddl)


def report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The query's rows; a deviation over 64 bits is an error."""
    vectors = whole_vectors(df, id_col, vec_col)
    w = fit(vectors)
    if w is None:
        w, vectors = Whitening(0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0), vectors.limit(0)
    return whiten(vectors, w).withColumn("deviation", F.col("deviation").cast("long")).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))
