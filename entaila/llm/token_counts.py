"""Exact length histogram of encoded documents.

Documents are counted by encoded length (a map-side aggregate: at most one row
per group, length and task is shuffled).  Suffix sums over the lengths then
give, for every context limit, the documents that fit, the tokens of longer
documents and the total after truncation.  The suffix sums run in two levels,
blocks of `BLOCK` lengths and the lengths inside a block, so that no window
spans all lengths.  A length is exact for any text; null and empty texts have
length 0.  A null group is a group of its own.  Repeated rows count each; documents
of equal length share a row.  An empty table gives no rows; other columns, of any
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import map_texts, stored

BLOCK = 1024


def lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(id, grp, n_tokens) of every whole text."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt"), (F.col(group_col) if group_col else F.lit("all")).cast("string").alias("grp"))

    def make():
        bpe = Bpe(ranks_path)
        return lambda ids, texts: {"id": ids, "n_tokens": bpe.count_batch(texts)}

    return map_texts(src, "id", "txt", make, f"id {dict(src.dtypes)['id']}, n_tokens long", keep=("grp",))


def histogram(lens: DataFrame) -> DataFrame:
    """(grp, n_tokens, docs)."""
    return lens.groupBy("grp", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length of a group as context limit: what lies at or above it.

    docs_ge / tokens_ge: documents of this length or more, and their tokens;
    truncated_total: tokens left when every document is cut to this length;
    docs_total / tokens_total of the group; share_le: the part of the group's
    documents that fit whole (the length is the share_le quantile).
    """
    h = hist.withColumn("blk", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    blocks = h.groupBy("grp", "blk").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.partitionBy("grp").orderBy(F.desc("blk"))
    whole = Window.partitionBy("grp")
    blocks = blocks.select(
        "grp", "blk",
        (F.sum("bd").over(above) - F.col("bd")).alias("d_above"), (F.sum("bt").over(above) - F.col("bt")).alias("t_above"),
        F.sum("bd").over(whole).alias("docs_total"), F.sum("bt").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("grp", "blk").orderBy(F.desc("n_tokens"))
    h = h.select("grp", "blk", "n_tokens", "docs", F.sum("docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t"))
    j = h.alias("h").join(blocks.alias("b"), h["grp"].eqNullSafe(blocks["grp"]) & (h["blk"] == blocks["blk"]))
    docs_ge, tokens_ge = F.col("d") + F.col("d_above"), F.col("t") + F.col("t_above")
    return j.select(
        F.col("h.grp").alias("grp"), "n_tokens", "docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("docs_total") - docs_ge + F.col("docs")) / F.col("docs_total")).alias("share_le"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any stated limits, from the sums: one row for each group and limit."""
    spark = sums.sparkSession
    lim = spark.createDataFrame([(int(x),) for x in limits], "lim long")
    j = sums.join(F.broadcast(lim), F.col("n_tokens") >= F.col("lim"))
    got = j.groupBy("grp", "lim").agg(F.min_by(F.struct("docs_ge", "tokens_ge"), "n_tokens").alias("x"))
    groups = sums.groupBy("grp").agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total")).join(F.broadcast(lim))
    out = groups.alias("g").join(got.alias("x"), F.col("g.grp").eqNullSafe(F.col("x.grp")) & (F.col("g.lim") == F.col("x.lim")), "left")
    ge, tok = F.coalesce(F.col("x.x.docs_ge"), F.lit(0)), F.coalesce(F.col("x.x.tokens_ge"), F.lit(0))
    return out.select(F.col("g.grp").alias("grp"), F.col("g.lim").alias("context_limit"), ge.alias("docs_ge"), (F.col("tokens_total") - tok + ge * F.col("g.lim")).alias("truncated_total"), (F.col("docs_total") - ge).alias("docs_shorter"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """Smallest length with at least a share q of the group's documents at or below it."""
    q = sums.sparkSession.createDataFrame([(float(x),) for x in qs], "q double")
    return sums.join(F.broadcast(q), F.col("share_le") >= F.col("q")).groupBy("grp", "q").agg(F.min("n_tokens").alias("n_tokens"))


def token_length_histogram(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, ranks_path: str | None = None) -> DataFrame:
    return suffix_sums(stored(histogram(lengths(df, id_col, text_col, group_col, ranks_path))))
