"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import concepts, corpus, pairs, reports, terms, ways  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every word, by positive pointwise mutual information."""
    return corpus.topk_associates(spark, sf_dir)
