"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Index (`build_index`).  With c the mean of all vectors and P a random rotation
(a fixed seed), a vector v = c + r*o of unit direction o keeps the signs of P*o
as packed bits, and two scalars.  With a = <signs / sqrt(bits), P*o>, the product
<signs, P*q> / (a * sqrt(bits)) estimates <o, q> without bias, and its error is at
most `EPSILON` * |q| * sqrt(1/a^2 - 1) / sqrt(bits - 1) but for a rare few: the
scalars are what multiplies the product and the error for <v, q>.  Short vectors
are padded with zeros to `LEAST_BITS` dimensions before they are rotated, so that
their codes are precise as well.  Every row is indexed, in segments of about
`SEGMENT_BYTES` that are rows of a table in the shared folder.  Equal vectors of a
segment have one code and a list of their rows.

Search (`search`).  Queries come in blocks of bounded size; each is broadcast in
turn and meets all segments, and its hits are written before the next one comes.
A task keeps the nearest found so far of each query and reads segments one by
one: the estimates of a segment's codes are a product of matrices over its signs,
and only vectors whose estimate plus error bound reaches the worst of the nearest
are scored exactly on the original vectors.  The lists of tasks are merged by
query.  Equal queries of a block are searched once, for one neighbour more, and
each then leaves out its own row.  So copies, of queries and of candidates, cost
nothing but their rows.

Scores are sums from the first dimension to the last in double precision.
Vectors that are null, zero or empty, or hold a null or a non-finite entry take
no part, nor do those of another length than the commonest (of two equally common
lengths the larger counts).  Ties go to the smaller id, null ids last; rows that
repeat an id are rows of their own, as queries and as candidates.  A row with a
null id is no query.  Empty tables give no rows; other columns, of any names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, ragged, shared_dir, stored, table

NEAREST, EVERY = 20, 20
#: Standard errors allowed for; at 3 about one in 700 neighbours at the very edge is missed.
EPSILON = 3.0
#: Bits of the shortest code.
LEAST_BITS = 256
SEGMENT_BYTES = 2 << 20
#: Bytes of the original vectors of a block of queries.
BLOCK_BYTES = 8 << 20
#: Estimates made at once.
TILE = 1 << 22


@dataclass
class Index:
    segments: DataFrame  #: (segment, ids, first, queries, codes, scale, slack, vectors)
    dims: int
    bits: int
    centre: np.ndarray
    rotation: np.ndarray  #: (bits, dims) of a rotation of `bits` dimensions


def rotation(bits: int, dims: int, seed: int) -> np.ndarray:
    """The columns that a random rotation of `bits` dimensions has for the first `dims`."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dims])


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, scale, slack) of vectors in rows."""
    bits = len(turn)
    rest = vectors - centre
    r = np.sqrt((rest * rest).sum(1))
    o = (rest / np.where(r > 0, r, 1)[:, None]) @ turn.T
    a = np.abs(o).sum(1) / np.sqrt(bits)
    a = np.where(r > 0, a, 1)
    return np.packbits(o >= 0, axis=1), (r / (a * np.sqrt(bits))).astype(np.float32), (r * np.sqrt(np.maximum(1 / a**2 - 1, 0) / (bits - 1))).astype(np.float32)


def build_index(df: DataFrame, id_col: str, vec_col: str, is_query: Column, seed: int = 7, least_bits: int = LEAST_BITS) -> Index:
    """All rows of `df` that take part; `is_query` marks those to be searched for."""
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    ok = "size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"), (F.col(id_col).isNotNull() & F.coalesce(is_query, F.lit(False))).alias("q")).filter(ok)
    common = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    dims = common["k"] if common else 1
    rows = rows.filter(F.size("v") == dims)
    mean = rows.agg(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"] if common else None
    centre = np.zeros(dims) if mean is None else mean.toArray()
    bits = -(-max(dims, least_bits) // 64) * 64
    shared = df.sparkSession.sparkContext.broadcast((centre, rotation(bits, dims, seed)))
    per_segment = max(64, SEGMENT_BYTES // (dims * (8 if wide else 4)))
    kind = np.float64 if wide else np.float32
    ddl = "segment long, ids array<long>, first array<int>, queries array<boolean>, codes binary, scale binary, slack binary, vectors binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, per_segment):
                part = batch.slice(at, per_segment)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims).astype(kind) + kind(0)  # no -0.0
                ids = part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
                uniq, inverse = np.unique(v.view(f"V{dims * v.itemsize}")[:, 0], return_inverse=True)
                v = uniq.view(kind).reshape(-1, dims)
                order = np.lexsort((ids, inverse.ravel()))  # rows of equal vectors stand together, least id first
                first = np.searchsorted(inverse.ravel()[order], np.arange(len(v) + 1)).astype(np.int32)
                codes, scale, slack = encode(v.astype(float), *shared.value)
                take = pa.array(order)
                cols = [[number], [part.column(0).take(take)], [first], [part.column(2).take(take)], [codes.tobytes()], [scale.tobytes()], [slack.tobytes()], [v.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0].to_pylist() if isinstance(x[0], pa.Array) else x[0]], f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
                number += 1

    return Index(stored(rows.mapInArrow(run, ddl)), dims, bits, centre, shared.value[1])


def _values(column: pa.Array, row: int, kind) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _ids(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which are null)."""
    ids = column[row].values
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)


def query_rows(index: Index) -> DataFrame:
    """(id, segment, place, vec) of the rows to be searched for; a place is a row of its segment."""
    kind = "V" + str(index.dims * _width(index))
    schema = arrow_schema("id long, segment long, place int, vec binary")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = np.flatnonzero(batch.column("queries")[row].values.to_numpy(zero_copy_only=False))
                first = batch.column("first")[row].values.to_numpy()
                vec = _values(batch.column("vectors"), row, kind)[np.searchsorted(first, at, "right") - 1]
                cols = [batch.column("ids")[row].values.take(pa.array(at)), [batch.column("segment")[row].as_py()] * len(at), at, [v.tobytes() for v in vec]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(cols, schema, strict=True)], schema=schema)

    return index.segments.select("segment", "ids", "first", "queries", "vectors").mapInArrow(run, "id long, segment long, place int, vec binary")


def _width(index: Index) -> int:
    """Bytes of an entry of the stored vectors."""
    one = index.segments.select(F.length("vectors").alias("b"), F.expr("(size(first) - 1)").alias("n")).first()
    return one["b"] // (one["n"] * index.dims) if one else 8


class Nearest:
    """The k nearest found so far of each query, kept in order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.null, self.id = np.zeros((n, k), bool), np.zeros((n, k), np.int64)
        self.segment, self.place = np.zeros((n, k), np.int64), np.full((n, k), -1, np.int32)

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, segment: int, place: np.ndarray) -> None:
        some = np.unique(query)
        k = self.k
        old = np.repeat(some, k)
        q = np.concatenate([old, query])
        s = np.concatenate([self.score[some].ravel(), score])
        null, ids = np.concatenate([self.null[some].ravel(), null]), np.concatenate([self.id[some].ravel(), ids])
        seg, place = np.concatenate([self.segment[some].ravel(), np.full(len(query), segment)]), np.concatenate([self.place[some].ravel(), place])
        order = np.lexsort((place, seg, ids, null, -s, q))
        head = np.searchsorted(q[order], some)
        keep = order[(head[:, None] + np.arange(k)).ravel()]  # each query had k entries, empty ones last
        for mine, new in ((self.score, s), (self.null, null), (self.id, ids), (self.segment, seg), (self.place, place)):
            mine[some] = new[keep].reshape(-1, k)


def exact_scores(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first dimension to the last."""
    out = np.empty(len(qi))
    step = max(1, (1 << 20) // q.shape[1])
    for a in range(0, len(qi), step):
        b = slice(a, a + step)
        out[b] = np.add.accumulate(q[qi[b]] * v[vi[b]], axis=1)[:, -1]
    return out


def _scan(best: Nearest, block: dict, epsilon: float, segment: int, ids: np.ndarray, null: np.ndarray, first: np.ndarray, signs: np.ndarray, scale: np.ndarray, slack: np.ndarray, v: np.ndarray) -> None:
    """Bring one segment's vectors to the queries' lists."""
    q, turned, offset, norm = block["q"], block["turned"], block["offset"], block["norm"]
    copies = np.minimum(np.diff(first), best.k)  # further copies cannot be among the k nearest

    def rerank(qi, vi):
        score = exact_scores(q, v, qi, vi)
        ok = score >= best.worst[qi]
        qi, vi, score = qi[ok], vi[ok], score[ok]
        if len(qi):
            place = ragged(first[vi], copies[vi])
            best.add(np.repeat(qi, copies[vi]), np.repeat(score, copies[vi]), null[place], ids[place], segment, place.astype(np.int32))

    tile = max(1, TILE // len(v))
    for a in range(0, len(q), tile):
        b = min(a + tile, len(q))
        estimate = offset[a:b, None] + (turned[a:b] @ signs.T) * scale
        upper = estimate + norm[a:b, None] * (epsilon * slack + np.float32(1e-5) * scale)
        empty = np.flatnonzero(best.worst[a:b] == -np.inf)
        if len(empty):  # the likeliest first, so that there is something to beat
            m = min(2 * best.k, len(v))
            likely = np.argpartition(estimate[empty], len(v) - m, axis=1)[:, len(v) - m :]
            upper[empty[:, None], likely] = -np.inf
            rerank(np.repeat(empty + a, m), likely.ravel())
        qi, vi = np.nonzero(upper >= best.worst[a:b, None])
        ok = np.isfinite(upper[qi, vi])
        rerank(qi[ok] + a, vi[ok])


def _search_block(index: Index, width: int, shared: Broadcast, k: int, epsilon: float) -> DataFrame:
    """(q, hits) of the k nearest of each vector of the block; hits are (neg, null, id, segment, place) in order."""
    dims, bits, kind = index.dims, index.bits, np.float32 if width == 4 else np.float64
    ddl = "q int, hits array<struct<neg: double, none: boolean, id: long, segment: long, place: int>>"
    schema = arrow_schema(ddl)

    def run(batches):
        b = shared.value
        best = Nearest(len(b["q"]), k)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, null = _ids(batch.column("ids"), row)
                first = batch.column("first")[row].values.to_numpy()
                signs = np.unpackbits(_values(batch.column("codes"), row, np.uint8).reshape(-1, bits // 8), axis=1).astype(np.float32) * 2 - 1
                v = _values(batch.column("vectors"), row, kind).reshape(-1, dims).astype(float)
                _scan(best, b, epsilon, batch.column("segment")[row].as_py(), ids, null, first, signs, _values(batch.column("scale"), row, np.float32), _values(batch.column("slack"), row, np.float32), v)
        full = np.isfinite(best.score)
        n = full.sum(1)
        at = np.flatnonzero(n)
        if len(at):
            flat = [best.score[full] * -1, best.null[full], best.id[full], best.segment[full], best.place[full]]
            inner = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, schema.field("hits").type.value_type, strict=True)], fields=list(schema.field("hits").type.value_type))
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[at])]), pa.int32()), inner, type=schema.field("hits").type)
            for x in range(0, len(at), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(at[x : x + 4096], pa.int32()), hits[x : x + 4096]], schema=schema)

    found = index.segments.select("segment", "ids", "first", "codes", "scale", "slack", "vectors").mapInArrow(run, ddl)
    return found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))  # k of each task


def search(index: Index, k: int = NEAREST, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row marked as a query."""
    spark = index.segments.sparkSession
    width = _width(index)
    kind = np.float32 if width == 4 else np.float64
    rows = stored(query_rows(index))
    blocks = max(1, -(-rows.count() * index.dims * 8 // BLOCK_BYTES))
    rows = stored(rows.repartition(blocks).withColumn("block", F.spark_partition_id()))
    path, ddl = shared_dir(spark), "query_id long, rank int, vec_id long, score double"
    for number in range(blocks):
        mine = rows.filter(F.col("block") == number).select("id", "segment", "place", "vec").toPandas()  # at most BLOCK_BYTES of vectors
        if not len(mine):
            continue
        q = np.frombuffer(b"".join(mine["vec"]), kind).reshape(len(mine), index.dims)
        uniq, which = np.unique(q.copy().view(f"V{index.dims * width}")[:, 0], return_inverse=True)
        q = uniq.view(kind).reshape(-1, index.dims).astype(float)
        block = {"q": q, "turned": (q @ index.rotation.T).astype(np.float32), "offset": (q @ index.centre).astype(np.float32), "norm": np.sqrt((q * q).sum(1)).astype(np.float32)}
        shared = spark.sparkContext.broadcast(block)
        hits = _search_block(index, width, shared, k + 1, epsilon)
        own = spark.createDataFrame(mine.assign(q=which.ravel().astype(np.int32))[["q", "id", "segment", "place"]], "q int, query_id long, own_segment long, own_place int")
        others = F.filter("hits", lambda h: (h["segment"] != F.col("own_segment")) | (h["place"] != F.col("own_place")))
        out = own.join(hits, "q").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "h"))
        out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(~F.col("h.none"), F.col("h.id")).alias("vec_id"), (-F.col("h.neg")).alias("score")).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(ddl).parquet(path) if _any(rows) else spark.createDataFrame([], ddl)


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by `every`."""
    return search(build_index(df, id_col, vec_col, F.col(id_col) % every == 0), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the rows of `query`: all inner products, without an index.
ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= {NEAREST}
"""
