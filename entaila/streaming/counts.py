"""Running word and pair counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import text


def pair_stream(stream: DataFrame, first: int = 5, last: int = 19) -> DataFrame:
    """(w1, w2, c): running counts of forward pairs of a stream (doc_id, text); update or complete mode.

    The state is one row for each pair; the vocabulary is applied when the
    counts are read, since it depends on all of them.
    """
    ch = text.chunked(text.tokenised(stream))
    ahead = ch.select("tokens", F.posexplode("tokens").alias("p", "w1")).select("w1", F.explode(F.slice("tokens", F.col("p") + first + 1, last - first + 1)).alias("w2"))
    return ahead.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))


def word_stream(stream: DataFrame) -> DataFrame:
    return text.word_counts(text.tokenised(stream))


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed counts under path/batch=<id>; the latest batch of a key holds."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The stored counts as they are now."""
    cols = [c for c in df.columns if c not in (*keys, "batch")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("x"))
    return best.select(*keys, "x.*")
