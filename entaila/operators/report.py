"""Assembling result tables: rules, unions, last rows, pivots, fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that name an embedding's kind, in order of precedence.
EMBED_RULES = (("teal", "teal"), ("katz", "katz_emb"), ("codeword", "codeword"), ("poincare", "poincare"))


def contains(col: str, word: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit(""))).contains(word.lower())


def first_rule(col: str, rules: tuple[tuple[str, str], ...], default: str = "unknown") -> Column:
    """The name of the first rule whose word the column has."""
    return reduce(lambda out, r: F.when(contains(col, r[0]), r[1]).otherwise(out), reversed(rules), F.lit(default))


def extract_int(col: str, pattern: str, default: int | None = None) -> Column:
    got = F.regexp_extract(F.col(col), pattern, 1)
    return F.when(got == "", F.lit(default).cast("int")).otherwise(got.cast("int"))


def united(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns of `cols` that there are."""
    return df.select([c for c in cols if c in df.columns])


def last_rows(df: DataFrame, by: str, order: str, *more: str) -> DataFrame:
    """The row with the greatest order of every group: one aggregate, no sort."""
    cols = [c for c in df.columns if c != by]
    best = df.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct(order, *more)).alias("x"))
    return best.select(by, *[F.col(f"x.{c}").alias(c) for c in cols])


def row_mean(*cols: str) -> Column:
    """The mean of the columns that are not null; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def first_present(df: DataFrame, by: str, col: str, order: str) -> DataFrame:
    """(by, col): the first value that is not null, by order."""
    return df.filter(F.col(col).isNotNull()).groupBy(by).agg(F.min_by(col, order).alias(col))


def pivot_delta(df: DataFrame, by: str, key: str, value: str, base: str, other: str) -> DataFrame:
    """Mean value by key as two columns and other - base."""
    p = df.groupBy(by).pivot(key, [base, other]).agg(F.avg(value))
    return p.withColumn("delta", F.col(other) - F.col(base))


def line_fit(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Slope, intercept and r2 of a line, by group."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def points(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error by group: what a point plot shows."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("error"), F.count(value).alias("n"))
