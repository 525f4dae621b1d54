"""Intervals as sparse vectors: rows (key, bin, mass)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = (13, 26, 52, 104, 138)


def _bin(x, n):
    return F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1)).cast("int")


def midpoint(iv: DataFrame, key: str = "node", n_bins: int = 333, normalise: bool = False, point_weight: float = 1.0) -> DataFrame:
    """One bin at the middle, of the interval's width (of point_weight if that is 0)."""
    w = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0))
    mass = F.lit(1.0) if normalise else F.when(w > 0, w).otherwise(point_weight)
    return iv.select(key, _bin(0.5 * (F.col("lo") + F.col("hi")), n_bins).alias("bin"), mass.alias("mass"))


def spread(iv: DataFrame, key: str = "node", n_bins: int = 333, normalise: bool = False) -> DataFrame:
    """The overlap with every bin touched; nothing for an empty interval."""
    w = F.col("hi") - F.col("lo")
    at = iv.filter(w > 0).select(key, "lo", "hi", F.explode(F.sequence(_bin(F.col("lo"), n_bins), _bin(F.col("hi"), n_bins))).alias("bin"))
    mass = F.least((F.col("bin") + 1) / F.lit(float(n_bins)), "hi") - F.greatest(F.col("bin") / F.lit(float(n_bins)), "lo")
    return at.select(key, "bin", (mass / (F.col("hi") - F.col("lo")) if normalise else mass).alias("mass")).filter("mass > 0")


def multiscale(iv: DataFrame, key: str = "node", n_bins: int = 333, splits: tuple[int, ...] = SPLITS, mass: str = "binary", normalise: bool = False) -> DataFrame:
    """One bin in each of several grids laid one after the other."""
    if sum(splits) != n_bins:
        raise ValueError(f"splits must add up to {n_bins}")
    if mass not in ("binary", "width"):
        raise ValueError("mass must be binary or width")
    mid = 0.5 * (F.col("lo") + F.col("hi"))
    w = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0))
    m = F.lit(1.0 / len(splits)) if normalise else F.lit(1.0) if mass == "binary" else F.when(w > 0, w).otherwise(1.0)
    bins = F.array(*[_bin(mid, s) + sum(splits[:k]) for k, s in enumerate(splits)])
    return iv.select(key, F.explode(bins).alias("bin"), m.alias("mass"))


def summed(rows: DataFrame, key: str = "node", normalise: bool = True) -> DataFrame:
    """Vectors of a key added up, then scaled to a sum of 1."""
    s = rows.groupBy(key, "bin").agg(F.sum("mass").alias("mass"))
    if not normalise:
        return s
    t = s.groupBy(key).agg(F.sum("mass").alias("_t"))
    return s.join(t, key).select(key, "bin", F.when(F.col("_t") > 0, F.col("mass") / F.col("_t")).otherwise(F.col("mass")).alias("mass"))


def dense(rows: DataFrame, key: str, n_bins: int) -> DataFrame:
    """(key, features): arrays of n_bins values."""
    m = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "mass"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("features"))
