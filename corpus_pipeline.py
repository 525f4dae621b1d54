"""A corpus pipeline: five operators, each on all that the stage before kept.

Every stage's result is written as Parquet to the shared folder and read again.
All stages but the last return the columns of `documents`, and any further ones.

Null and empty texts have no letter and go in the first stage; the later stages
keep them if they get them.  An empty table stays empty.  Every verdict is about a
row, not an id: rows that repeat an id are documents of their own, so that one of
them can go and another stay.  Of near copies the row with the least id stays, null
ids last, and of rows with the same id one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entaila.llm import bpe, langid, near_duplicates, phrase_index, pii
from entaila.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those in none of the learnt languages."""
    return langid.in_learnt_languages(docs)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key of id and whole text, and its name, which is new; null ids come last.

    It follows from the row alone, so that verdicts find their rows in another pass.
    """
    name = "key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("digest"))), name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each class of near copies."""
    rows, key = _keyed(docs)
    found = near_duplicates.classes(rows.select(key, "text"), key)
    keep = found.filter(F.col("class_id") == F.col(key)).groupBy(key).agg((F.max("n_copies") > 0).alias("copies"))
    kept = rows.join(keep.withColumnRenamed("copies", f"{key}copies").hint("merge"), key)
    one = F.when(F.col(f"{key}copies"), F.lit(0)).otherwise(F.monotonically_increasing_id())  # rows of one id and text are copies
    return kept.withColumn(f"{key}row", one).dropDuplicates([key, f"{key}row"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which a window of a benchmark item occurs."""
    rows, key = _keyed(docs)
    drop = phrase_index.decontaminate(rows.select(key, "text"), table(spark, sf_dir, "benchmark"), key).filter("n_hit > 0").select(key)
    return rows.join(drop.hint("merge"), key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii.session_key(spark)).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]
#: Language models, components of a graph and byte-pair merges are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
