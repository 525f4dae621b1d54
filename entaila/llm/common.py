"""Helpers shared by the operators: Arrow slices, shared storage, CSR sums."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one call of a kernel, unless a single text is longer.
SLICE_BYTES = 4 << 20
#: Rows in one Arrow batch between the JVM and Python.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) with about `limit` bytes of text each; null texts are empty."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield ids.slice(a, b - a).to_pylist(), [t or "" for t in texts.slice(a, b - a).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list, list[str]], dict]], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Run a kernel over every whole text, in Arrow slices.

    `make()` is called once in a task and returns kernel(ids, texts) -> columns
    by name, in the order of `schema`; columns named in `keep` are passed on in
    front of them.  Only the id, the text and `keep` leave the JVM, so other
    columns may have any names.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in keep])
    head = ", ".join(f"`{c}` {dict(src.dtypes)[c]}" for c in keep)
    arrow_schema = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            at = 0
            for ids, texts in slices(batch.column(0), batch.column(1)):
                cols = kernel(ids, texts)
                out = [pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name] for f in arrow_schema]
                kept = [batch.column(2 + k).slice(at, len(ids)) for k in range(len(keep))]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([*kept, *out], names=[*keep, *arrow_schema.names])

    return src.mapInArrow(run, ", ".join(x for x in (head, schema) if x))


def filter_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of `df`, with all columns, whose whole text kernel(texts) accepts; null texts are empty."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            text = batch.column(place)
            yield batch.filter(pa.array([ok for _, texts in slices(text, text) for ok in kernel(texts)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_schema(ddl: str) -> pa.Schema:
    return _arrow_schema(None, ddl)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    Only a session on this machine alone may leave that unset: it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there.

    `file_rows`, if not 0, bounds the rows of a file and with them what a writer or reader of large rows holds.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows, for the jobs run within: rows that are large must not meet in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc(col: str | Column) -> Column:
    """crc32 of a value written as text, as Python's zlib.crc32 gives it."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


def py_crc(value) -> int:
    return zlib.crc32(str(value).encode())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
