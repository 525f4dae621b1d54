"""Corpus operators: cleaning, chunks, vocabularies, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import without_markup, words_of
from ..functions.storage import cut

CHUNK, STEP, LEAST = 200, 100, 20


def tokenised(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", markup: bool = False) -> DataFrame:
    """(doc_id, tokens); a null text has no tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), words_of(without_markup(text) if markup else text).alias("tokens"))


def chunked(tokens: DataFrame, size: int = CHUNK, step: int = STEP, least: int = LEAST) -> DataFrame:
    """(doc_id, start, tokens): overlapping chunks of more than `least` words."""
    starts = tokens.filter(F.size("tokens") > 0).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step))).alias("start"))
    return starts.select("doc_id", "start", F.slice("tokens", F.col("start") + 1, size).alias("tokens")).filter(F.size("tokens") > least)


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(tokens: DataFrame, min_count: int = 5) -> DataFrame:
    """(word, cnt) of words met `min_count` times or more."""
    return word_counts(tokens).filter(F.col("cnt") >= min_count)


def numbered(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """`df` with dense places 0, 1, ... in the order of a distinct column.

    Ranges are sorted apart; a range's first place is the size of those before
    it, so no task holds all rows.
    """
    parts = cut(df.repartitionByRange(col).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1 + F.col("_before")
    return parts.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")


def projected(vocab: DataFrame, senses: DataFrame, pos: str | None = None) -> DataFrame:
    """The words that the sense inventory has (as the given part of speech)."""
    known = senses if pos is None else senses.filter(F.col("pos") == pos)
    return vocab.join(known, vocab["word"] == known["lemma"], "left_semi")


def without_words(df: DataFrame, words: list[str], col: str = "word") -> DataFrame:
    return df.filter(~F.col(col).isin(words))
