"""Windowed co-occurrence counts and what is asked of them.

x(a, b) is twice the number of ordered places (p, q) of a and b in one chunk
with first <= |p - q| <= last; places are counted before the vocabulary is
applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.storage import cut
from . import packed
from .text import CHUNK, LEAST, STEP, numbered

EPS = 1e-12
#: How texts are cut into chunks.
CUTS = (CHUNK, STEP, LEAST)
#: Words that are broadcast, at most.
BROADCAST_WORDS = 500_000
#: Row sums, two numbers each, that are broadcast, at most.
BROADCAST_SUMS = 4_000_000
# Words without content of their own, and leftovers of addresses.
STOPWORDS = ["the", "of", "and", "a", "an", "to", "in", "that", "it", "is", "was", "for", "on", "are", "as", "with", "he", "she", "at", "by", "this", "from", "or", "be"]
JUNK = ["s", "t", "http", "https", "www"]


def numbered_words(vocab: DataFrame) -> DataFrame:
    """`vocab` with dense numbers idx in the order of the words."""
    return cut(numbered(vocab, "word"))


def encoded(df: DataFrame, known: DataFrame) -> DataFrame:
    """`df` with the words in `tokens` as numbers, null for those not in `known` (word, cnt, idx); rows without tokens are left out.

    A vocabulary of up to `BROADCAST_WORDS` words is broadcast, and words are looked up
    in tasks without a shuffle.  Of a larger one
    only words with a share of 1 / BROADCAST_WORDS of all places or more are, of
    which there can be no more than that; the rest, none of them frequent, is
    joined by a shuffle.
    """
    keys = [c for c in df.columns if c != "tokens"]
    words = known.select("word", "idx")
    if known.count() <= BROADCAST_WORDS:
        return _looked_up(df.filter(F.size("tokens") > 0).select(*keys, "tokens"), words)
    at = df.select(*keys, F.posexplode("tokens").alias("_p", "word"))
    places = known.agg(F.sum("cnt")).first()[0]
    often = F.broadcast(known.filter(F.col("cnt") * BROADCAST_WORDS >= places).select("word", "idx"))
    at = at.join(often, "word").unionByName(at.join(often, "word", "left_anti").join(words.hint("merge"), "word", "left"))
    rows = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "idx"))).alias("_e"))
    return rows.select(*keys, F.transform("_e", lambda x: x["idx"]).alias("tokens"))


def _looked_up(df: DataFrame, words: DataFrame) -> DataFrame:
    """`df` (..., tokens) with the numbers of its tokens, by a broadcast table (word, idx)."""
    got = words.toArrow().combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast((got["word"].combine_chunks().cast(pa.string()), got["idx"].combine_chunks().cast(pa.int64())))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, idx = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = pc.index_in(lists.flatten().cast(pa.string()), value_set=word)
            ends = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, idx.take(at))], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(x for x in (kinds, "tokens array<long>") if x))


def number_counts(chunks: DataFrame, first: int = 5, last: int = 19) -> DataFrame:
    """(i, j, x), symmetric; the tokens of the chunks are numbers below 2^31 or null.

    Each place looks ahead by a slice, so no range join is needed.  A pair is one
    number, the lesser first, counted map-side before the one shuffle; the mirror
    image is made from the counts.
    """
    ahead = F.slice("tokens", F.col("p") + first + 1, last - first + 1)
    pairs = chunks.select("tokens", F.posexplode("tokens").alias("p", "a")).filter("a is not null").select("a", F.explode(ahead).alias("b")).filter("b is not null")
    return _symmetric(pairs)


def _symmetric(pairs: DataFrame) -> DataFrame:
    """(i, j, x): the counts of pairs of word numbers (a, b), both ways."""
    key = F.shiftleft(F.least("a", "b"), 32).bitwiseOR(F.greatest("a", "b"))
    c = pairs.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    c = c.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "c")
    entry = lambda i, j, n: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.col("c") * n).alias("x"))
    both = F.when(F.col("a") == F.col("b"), F.array(entry("a", "b", 4))).otherwise(F.array(entry("a", "b", 2), entry("b", "a", 2)))
    return c.select(F.explode(both).alias("e")).select("e.*")


def named(x: DataFrame, known: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """`x` with the words w1 and w2 in place of their numbers.

    Words are broadcast as in `encoded`, so that the counts, of which there are far more,
    are not sent for their names; of a larger vocabulary the rest is joined by a shuffle.
    """
    rest = [c for c in x.columns if c not in (i, j)]
    small = known.count() <= BROADCAST_WORDS
    for c, w in ((i, "w1"), (j, "w2")):
        words = known.select(F.col("idx").alias(c), F.col("word").alias(w))
        x = x.join(F.broadcast(words) if small else words, c)
    return x.select("w1", "w2", *rest)


def window_counts(chunks: DataFrame, vocab: DataFrame, first: int = 5, last: int = 19) -> DataFrame:
    """(w1, w2, x), symmetric; chunks are (doc_id, start, tokens)."""
    known = numbered_words(vocab)
    return named(number_counts(encoded(chunks, known), first, last), known)


def band_join_counts(chunks: DataFrame, vocab: DataFrame, first: int = 5, last: int = 19) -> DataFrame:
    """The same counts by a join on the chunk with a range on the distance: a cross-check.

    Places have word numbers, a pair is counted once for both ways, and words come back last.
    """
    known = numbered_words(vocab)
    words = known.select("word", "idx")
    at = chunks.select("doc_id", "start", F.posexplode("tokens").alias("p", "word")).join(F.broadcast(words) if known.count() <= BROADCAST_WORDS else words, "word").drop("word")
    a, b = at.alias("a"), at.alias("b")
    near = (F.col("b.p") - F.col("a.p")).between(first, last)
    fwd = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") == F.col("b.start")) & near)
    return named(_symmetric(fwd.select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))), known)


def text_counts(texts: DataFrame, first: int = 5, last: int = 19, cuts: packed.Cuts = CUTS) -> DataFrame:
    """(i, j, x), symmetric, of the chunks of whole texts (tokens: numbers below 2^31 or null), from one shuffle of packed counts."""
    return packed.row_entries(packed.packed_counts(texts, first, last, cuts=cuts), lambda i, j, x: np.ones(len(x), bool))


def merged(*counts: DataFrame) -> DataFrame:
    """Stored counts and new ones added up: the upsert of an accumulator."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("w1", "w2").agg(F.sum("x").alias("x"))


def merged_packed(*counts: DataFrame) -> DataFrame:
    """(i, j, x): packed counts (`packed.packed_counts`), stored and new ones, added up where the rows of a word meet."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return packed.row_entries(out, lambda i, j, x: np.ones(len(x), bool))


def marginals(x: DataFrame, i: str = "w1", v: str = "x") -> DataFrame:
    return x.groupBy(F.col(i).alias("w")).agg(F.sum(v).alias("r"))


def total(x: DataFrame, v: str = "x") -> DataFrame:
    return x.agg(F.coalesce(F.sum(v), F.lit(0)).alias("t"))


def _pmi(v: str) -> Column:
    return F.ln((F.col(v) * F.col("t").cast("double") + EPS) / (F.col("r").cast("double") * F.col("c") + EPS))


def pmi(x: DataFrame, i: str = "w1", j: str = "w2", v: str = "x", symmetric: bool = False) -> DataFrame:
    """`x` with its row sum r, column sum c, total t and pointwise mutual information (natural log).

    The sums of a symmetric matrix are taken once.
    """
    rows = x.groupBy(i).agg(F.sum(v).alias("r"))
    cols = rows.select(F.col(i).alias(j), F.col("r").alias("c")) if symmetric else x.groupBy(j).agg(F.sum(v).alias("c"))
    t = total(rows, "r")
    out = x.join(rows, i).join(cols, j).crossJoin(F.broadcast(t))  # t is one row
    return out.withColumn("pmi", _pmi(v))


def ppmi(x: DataFrame, shift: float = 1.0, i: str = "w1", j: str = "w2", v: str = "x", symmetric: bool = False) -> DataFrame:
    """Shifted positive PMI; entries that become 0 stay."""
    if shift <= 0:
        raise ValueError("shift must be > 0")
    return pmi(x, i, j, v, symmetric).select(i, j, F.greatest(F.col("pmi") - F.ln(F.lit(float(shift))), F.lit(0.0)).alias("ppmi"))


def positive(x: DataFrame, shift: float | None = None, i: str = "i", j: str = "j", v: str = "v", symmetric: bool = False) -> DataFrame:
    """Positive PMI of any sparse matrix without its zeros, then shifted if shift > 0."""
    out = pmi(x, i, j, v, symmetric).filter("t > 0 and pmi > 0").select(i, j, F.col("pmi").alias(v))
    if shift and shift > 0:
        out = out.withColumn(v, F.col(v) - F.ln(F.lit(float(shift)))).filter(F.col(v) > 0)
    return out


def associates(values: DataFrame, counts: DataFrame, k: int = 10, least_len: int = 2, stopwords: list[str] = STOPWORDS, v: str = "ppmi", numbers: tuple[str, str] | None = None) -> DataFrame:
    """(w1, rank, w2, value, freq): the k best partners of every word.

    max(50 k, 200) partners by value go in; then the word itself, short words,
    junk and stop words are left out.  Ties are in order of the partner.  With
    `numbers`, the names of columns of word numbers (in the order of the words,
    idx in `counts`), words come in after the first cut.
    """
    a, b = numbers or ("w1", "w2")
    top = values.withColumn("n", F.row_number().over(Window.partitionBy(a).orderBy(F.desc(v), b))).filter(F.col("n") <= max(k * 50, 200)).drop("n").filter(F.col(v) > 0)
    if numbers:
        top = named(top, counts, a, b)
    top = top.filter((F.col("w1") != F.col("w2")) & (F.length("w2") >= least_len) & ~F.col("w2").isin(JUNK + stopwords))
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("w1").orderBy(F.desc(v), "w2"))).filter(F.col("rank") <= k)
    return top.join(counts.select(F.col("word").alias("w2"), F.col("cnt").alias("freq")), "w2", "left").select("w1", F.col("rank").cast("long").alias("rank"), "w2", F.col(v).alias("value"), F.coalesce("freq", F.lit(0)).alias("freq"))


def best_associates(chunks: DataFrame, known: DataFrame, k: int = 10, least_len: int = 2, stopwords: list[str] = STOPWORDS, digits: int = 6, first: int = 5, last: int = 19, cuts: packed.Cuts | None = None) -> DataFrame:
    """The rows of `associates` for the rounded PPMI of all pairs, without a shuffle for each step.

    chunks, or with `cuts` texts, have word numbers of `known` (word, cnt, idx) as tokens.  Row sums are taken from
    the places, so a word's counts meet once, packed, and leave its block as the pairs that
    can be among its k best: those within a rounding of the k-th value.  These are ranked by
    the exact rounded value.  Where more than `BROADCAST_SUMS` words are met, or so many words
    are left out that the first cut of `associates` decides, its steps are taken.
    """
    left_out = known.filter((F.length("word") < least_len) | F.col("word").isin(JUNK + stopwords)).select("idx")
    most = max(k * 50, 200) - k  # with fewer left out, the k best of the others are always within the first cut
    r = cut(packed.word_sums(chunks, first, last, cuts))
    if r.count() > BROADCAST_SUMS or left_out.limit(most).count() == most:
        x = cut(text_counts(chunks, first, last, cuts) if cuts else number_counts(chunks, first, last))
        return associates(ppmi(x, i="i", j="j", symmetric=True).withColumn("ppmi", rounded("ppmi", digits)), known, k, least_len, stopwords, numbers=("i", "j"))
    got = r.toArrow()
    sums = np.zeros(known.count())
    sums[got["i"].to_numpy()] = got["r"].to_numpy()
    skip = np.array([row["idx"] for row in left_out.collect()], np.int64)
    shared, whole, margin = chunks.sparkSession.sparkContext.broadcast(sums), sums.sum(), 2 * 10.0**-digits

    def near_best(i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = shared.value
        v = np.log((x * whole + EPS) / (at[i] * at[j] + EPS))
        on = np.flatnonzero((v > 0) & (i != j) & ~np.isin(j, skip))
        order = on[np.lexsort((-v[on], i[on]))]
        begin = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]]) if len(order) else order
        size = np.diff(np.r_[begin, len(order)])
        least = v[order[begin + np.minimum(size, k) - 1]] - margin
        mask = np.zeros(len(i), bool)
        mask[order[v[order] >= np.repeat(least, size)]] = True
        return mask

    near = packed.row_entries(packed.packed_counts(chunks, first, last, cuts=cuts), near_best)
    j = near.join(F.broadcast(r), "i").join(F.broadcast(r.select(F.col("i").alias("j"), F.col("r").alias("c"))), "j").crossJoin(F.broadcast(total(r, "r")))
    j = j.select("i", "j", rounded(F.greatest(_pmi("x"), F.lit(0.0)), digits).alias("value")).filter("value > 0")
    top = j.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("value"), "j")).cast("long")).filter(F.col("rank") <= k)
    freq = known.select(F.col("word").alias("w2"), F.col("cnt").alias("freq"))
    top = named(top, known).join(freq if known.count() > BROADCAST_WORDS else F.broadcast(freq), "w2")
    return top.select("w1", "rank", "w2", "value", "freq")


def pair_counts(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """`pairs` (w1, w2) with freq; 0 where nothing is counted."""
    return pairs.join(x, ["w1", "w2"], "left").withColumn("freq", F.coalesce("x", F.lit(0))).drop("x")


def pair_probabilities(pairs: DataFrame, x: DataFrame, vocab: DataFrame) -> DataFrame:
    """freq, joint = x / T and cond = x / r(w1) of `pairs`; null if a word is not in the vocabulary."""
    r, t = marginals(x), total(x)
    known = vocab.select(F.col("word").alias("k"))
    p = pairs.join(known.withColumnRenamed("k", "k1"), F.col("w1") == F.col("k1"), "left").join(known.withColumnRenamed("k", "k2"), F.col("w2") == F.col("k2"), "left")
    p = cut(p)
    found = x.join(cut(p.select("w1", "w2").distinct()), ["w1", "w2"])  # stored, so that Spark knows its size: few pairs are sent to the counts, not the counts to them
    p = p.join(found, ["w1", "w2"], "left").join(r.withColumnRenamed("w", "w1"), "w1", "left").crossJoin(F.broadcast(t))
    ok = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    n = F.coalesce("x", F.lit(0))
    ratio = lambda d: F.when(ok, F.when(F.coalesce(d, F.lit(0)) == 0, 0.0).otherwise(n / d))
    return p.select(*pairs.columns, F.when(ok, n).alias("freq"), ratio(F.col("t")).alias("joint"), ratio(F.col("r")).alias("cond"))


def query_pairs(pairs: DataFrame, x: DataFrame, vocab: DataFrame, mode: str = "cooc", prob: str = "global") -> DataFrame:
    """`pairs` with one value: a count, a joint or a conditional probability."""
    if mode not in ("cooc", "prob") or prob not in ("global", "cond"):
        raise ValueError("mode must be cooc or prob, prob must be global or cond")
    col: Column = F.col("freq").cast("double") if mode == "cooc" else F.col("joint") if prob == "global" else F.col("cond")
    return pair_probabilities(pairs, x, vocab).select("w1", "w2", col.alias("value"))
