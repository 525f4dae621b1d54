"""Spelling variants: words one edit apart, by two-dimensional range reporting.

1.  `word_counts` reads every whole text and counts its words; counts of a slice
    of texts leave a task, words meet once more in a sum.
2.  Words that differ by one replaced code point have equal lengths m; words that
    differ by one inserted (or deleted) one have lengths m and m + 1, and the
    shorter asks for the longer.  An edit lies at one position p: the p code points
    before it and those after it are the same in both words.
3.  A collection of words is sorted forwards and backwards.  The words with the
    first p code points of a word are an interval of the first order, those with
    its code points behind p are an interval of the second, so the words one edit
    at p away are the points of a rectangle in the permutation between the two
    orders (`Order`, `edits`).  A wavelet tree over the permutation reports them
    (`Wavelet`).  Intervals come from the common prefixes of neighbours in an
    order, by doubling; all pairs (word, p) of a collection go through together.
4.  Collections are dealt (`_deal`): positions are cut into ranges, and a word is
    sent once for each range to the group of those that agree with it outside the
    range, so that words that are one edit apart in the range meet.  A group that
    is too large is cut into smaller ranges, down to single positions, where a
    group is as large as the alphabet.  Groups are put together in buckets of
    about `BUCKET` code points, each one collection for every length and range.
5.  A word's `form` is its near word of largest count, if that is at least twice
    its own; roots are found from words without a form downwards, a join a step.
    Counts double at every step, so there are at most log2 of the largest.

An insertion into a run of equal letters is found at the last place of the run
alone, so that each pair counts once.  Null texts have no words, and a null id is
written `null` where an id is part of a digest.  Repeated rows count as often as
they come.  Texts and words of any length are taken whole.  Ties go to the word
that is least in code-point order.  Empty tables give no rows; other columns, of
any names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, ragged, stored, table
from .hashing import prefix_sums, spans_hash

#: One word in so many, by a digest of document and word, loses a code point.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Code points of a bucket; groups of more than a quarter are cut.
BUCKET = 1 << 18
#: Rectangles that go through a wavelet tree together.
CHUNK = 1 << 17

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # steps of the register from 0


# -- words ------------------------------------------------------------------------
def crc_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of prefix + data[begin:end] for each span; before: the prefixes' crc32."""
    state, length = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - begin
    order = np.argsort(-length, kind="stable")
    at, left, reg = begin[order], length[order], state[order]
    live = len(order)
    for k in range(min(int(left[0]) if live else 0, 64)):
        live = int(np.searchsorted(-left, -k, "left"))  # spans longer than k come first
        part = reg[:live]
        reg[:live] = _CRC[(part ^ data[at[:live] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > 64).tolist():  # rest of the few long ones
        out[k] = zlib.crc32(data[begin[k] + 64 : end[k]].tobytes(), int(out[k]))
    return out


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) in UTF-8 bytes of maximal runs of A-Z, a-z and U+00C0 to U+00FF (two bytes, the first C3)."""
    low = data | 32
    letter = (low >= 97) & (low <= 122) & (data < 128)
    lead = data == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    return edge[::2], edge[1::2]


def count_slice(ids: list, texts: list[str], damage: int) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of some texts."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" ").translate(_LOW), np.uint8)
    begin, end = runs(data)
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    stop = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(stop, begin, "right")
    before = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc_spans(data, begin, end, before[doc])
    hit = crc % np.uint32(damage) == 0
    damaged = []
    for a, b, h in zip(begin[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), strict=True):
        w = data[a:b].tobytes().decode()
        p = h % len(w)
        damaged.append(w[:p] + w[p + 1 :])
    begin, end = begin[~hit], end[~hit]
    _, first, n = np.unique(spans_hash(prefix_sums(data), begin, end), return_index=True, return_counts=True)
    length = end[first] - begin[first]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    whole = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[ragged(begin[first], length)]))
    return pa.concat_arrays([whole, pa.array(damaged, pa.string())]), np.concatenate([n, np.ones(len(damaged), np.int64)])


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all texts; one in `damage` words of a document is damaged."""

    def make():
        def kernel(ids, texts):
            words, n = count_slice(ids, texts, damage)
            return {"word": words, "n": n}

        return kernel

    return map_texts(df, id_col, text_col, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- two orders and a wavelet tree ----------------------------------------------------
class Order:
    """Rows of code points (0 behind their end) in order, with the common prefixes of neighbours."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.order = np.argsort(np.ascontiguousarray(rows, dtype="<u4").view(f"<U{width}")[:, 0], kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        s = rows[self.order]
        common = np.full(n + 1, -1, np.int64)  # of the rows before and at a place; none at the ends
        if n > 1:
            common[1:n] = (s[1:] != s[:-1]).argmax(1)
        self.least = [common]  # of 2^k of them from a place on
        while 2 << (len(self.least) - 1) <= n + 1:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def longest(self) -> np.ndarray:
        """The longest prefix that each row shares with another."""
        common = self.least[0]
        return np.maximum(common[self.place], common[self.place + 1])

    def interval(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[begin, end) of the places of rows that share the first `length` code points with a row."""
        lo, hi = self.place[row].copy(), self.place[row] + 1
        for k in range(len(self.least) - 1, -1, -1):
            least, step = self.least[k], 1 << k
            back = lo - step + 1
            lo -= step * ((back >= 0) & (least[np.maximum(back, 0)] >= length))
            hi += step * ((hi < len(least)) & (least[np.minimum(hi, len(least) - 1)] >= length))
        return lo, hi


class Wavelet:
    """A wavelet tree over a permutation, level by level from the highest bit, stored as counts of zeros."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            bit = (values >> b) & 1
            self.levels.append((b, np.concatenate([[0], np.cumsum(1 - bit)])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every place in [lo, hi) with a value in [low, high)."""
        q, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            l0, r0 = zeros[lo], zeros[hi]
            left, right = node * 2, node * 2 + 1
            go = (r0 > l0) & (left << b < high[q]) & ((left + 1) << b > low[q])
            l1, r1 = lo - l0 + zeros[-1], hi - r0 + zeros[-1]
            on = (r1 > l1) & (right << b < high[q]) & ((right + 1) << b > low[q])
            q, node, lo, hi = (np.concatenate([x[go], y[on]]) for x, y in ((q, q), (left, right), (l0, l1), (r0, r1)))
        return q, node


def edits(rows: np.ndarray, backwards: np.ndarray, asks: np.ndarray, answers: np.ndarray, m: int, insert: bool, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """(word that asks, word that answers): pairs one edit at a position in [s, e) apart.

    rows: code points of words, `backwards` from their ends.  Without `insert` all
    words have m code points and ask and answer; with it those that ask have m and
    those that answer one more.
    """
    forth, back = Order(rows), Order(backwards)
    behind = m - (0 if insert else 1)  # code points of the asking word but for those in front of p: behind - p
    who = np.flatnonzero(asks)
    first = np.maximum(s, behind - back.longest()[who])  # else no other word has its end
    last = np.minimum(np.minimum(e - 1, behind), forth.longest()[who])  # nor its start
    n = np.maximum(last - first + 1, 0)
    who, p = np.repeat(who, n), ragged(first, n)
    # the answering words alone, in both orders
    seen_f, seen_b = (np.concatenate([[0], np.cumsum(answers[o.order])]) for o in (forth, back))
    rank_b = np.empty(len(rows), np.int64)
    rank_b[back.order] = seen_b[:-1]
    target_f, target_b = forth.order[answers[forth.order]], back.order[answers[back.order]]
    if not len(target_f):
        return who[:0], who[:0]
    tree = Wavelet(rank_b[target_f])
    found = []
    for a in range(0, len(who), CHUNK):
        w, at = who[a : a + CHUNK], p[a : a + CHUNK]
        lo, hi = (seen_f[x] for x in forth.interval(w, at))
        low, high = (seen_b[x] for x in back.interval(w, behind - at))
        some = np.minimum(hi - lo, high - low) > (0 if insert else 1)  # without `insert` a word finds itself
        w, at = w[some], at[some]
        q, value = tree.report(lo[some], hi[some], low[some], high[some])
        other = target_b[value]
        ok = rows[other, at[q]] != rows[w[q], at[q]]
        found.append((w[q][ok], other[ok]))
    return tuple(np.concatenate([f[c] for f in found]) if found else who[:0] for c in range(2))


def near_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best): for each word the near ones that this bucket finds, and the best of them."""
    code, words = pd.factorize(pdf["word"], sort=False)
    words = words.to_numpy()
    count = np.zeros(len(words), np.int64)
    count[code] = pdf["n"]
    pairs = []
    for (insert, m, s, e), at in pdf.groupby(["insert", "m", "s", "e"], sort=False).indices.items():
        if len(at) < 2:
            continue
        of = code[at]
        length = np.array([len(w) for w in words[of]])
        width = m + bool(insert)
        flat = np.frombuffer("".join(words[of]).encode("utf-32-le"), np.uint32)
        start = np.cumsum(length) - length
        col = np.arange(width)[None, :]
        inside = col < length[:, None]
        rows, backwards = (np.where(inside, flat[np.clip(x, 0, len(flat) - 1)], 0) for x in (start[:, None] + col, (start + length)[:, None] - 1 - col))
        asks = length == m
        a, b = edits(rows, backwards, asks, ~asks if insert else asks, m, bool(insert), s, e)
        pairs.append((of[a], of[b]))
        if insert:
            pairs.append((of[b], of[a]))
    word, other = (np.concatenate([x[c] for x in pairs]) if pairs else np.zeros(0, np.int64) for c in range(2))
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words.astype(str))] = np.arange(len(words))  # code-point order
    order = np.lexsort((rank[other], -count[other], word))
    word, other = word[order], other[order]
    head = np.flatnonzero(np.diff(word, prepend=-1))
    n = np.diff(np.append(head, len(word)))
    return pd.DataFrame({"word": words[word[head]], "n_near": n, "best_n": count[other[head]], "best": words[other[head]]})


# -- dealing ------------------------------------------------------------------------------
def _cut_ranges(rows: DataFrame) -> DataFrame:
    """Each row once for each part of its range: halves, or sixteenths of long ones.

    An insertion is looked for at the end of a run of equal letters in the longer
    word, so that word is left out of parts that lie inside a run.
    """
    step = F.expr("cast(ceil((e - s) / if(e - s <= 64, 2, 16)) as int)")
    parts = rows.select("*", F.explode(F.sequence(F.col("s"), F.col("e") - 1, step)).alias("x"), step.alias("step"))
    parts = parts.select("insert", "m", F.col("x").alias("s"), F.least(F.col("x") + F.col("step"), "e").alias("e"), "word", "n", "len")
    inside = "insert and m < len and e < len and substring(word, s + 1, e - s + 1) = repeat(substring(word, s + 1, 1), e - s + 1)"
    return parts.filter(f"not ({inside})")


def _deal(words: DataFrame) -> DataFrame:
    """(insert, m, s, e, word, n, group): words that are one edit in [s, e) apart have a group in common."""
    part = lambda insert, m, end: F.struct(F.lit(insert).alias("insert"), (F.col("len") + m).alias("m"), (F.col("len") + end).alias("end"))
    each = words.withColumn("len", F.char_length("word")).select("*", F.explode(F.array(part(False, 0, 0), part(True, 0, 1), part(True, -1, 0))).alias("r"))
    todo = _cut_ranges(each.select("r.insert", "r.m", F.lit(0).alias("s"), F.col("r.end").alias("e"), "word", "n", "len"))
    done = None
    while True:
        # code points behind the range: from e on, in a word that asks for insertions one less
        rest = F.expr("substring(word, e + 1 - if(insert and len = m, 1, 0), len)")
        todo = stored(todo.withColumn("group", F.xxhash64("insert", "m", "s", "e", F.expr("substring(word, 1, s)"), rest)))
        large = todo.groupBy("group").agg(F.sum("len").alias("size"), F.max(F.col("e") - F.col("s")).alias("wide"), F.expr("if(max(insert), min(len) < max(len), count(*) > 1)").alias("some")).filter(F.col("size") > BUCKET // 4)
        large = stored(large.filter("wide > 1 or not some").select("group", "some"))  # those of a single position stay, those without a pair go
        if not large.limit(1).count():
            return todo if done is None else done.unionByName(todo)
        ready = todo.join(large, "group", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        todo = _cut_ranges(todo.join(large.filter("some"), "group", "left_semi"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of (word, n): all words one edit away are counted, the one of largest n is named."""
    dealt = _deal(words)
    size = dealt.agg(F.sum("len").alias("s")).first()["s"] or 0
    buckets = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    found = dealt.withColumn("bucket", F.pmod("group", F.lit(buckets))).groupBy("bucket").applyInPandas(near_in_bucket, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("neg"), "best")).alias("b"))
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("b.neg")).alias("best_n"), "b.best")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n)."""
    enough = F.col("best_n") >= ratio * F.col("n")
    rows = stored(near_words(words).select("word", F.when(enough, F.col("best")).alias("form"), "n", "n_near", F.when(enough, F.col("best_n")).alias("form_n")))
    level = stored(rows.filter("form is null").select("word", F.col("word").alias("root")))
    below, roots = rows.filter("form is not null").select("word", "form"), level
    while level.limit(1).count():
        level = stored(below.join(level.withColumnRenamed("word", "form"), "form").select("word", "root"))
        roots = roots.unionByName(level)
    return rows.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = word_counts(df, id_col, text_col).filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))
    return variants(stored(counts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of `query`: crc32 byte by byte, near words by what is left when a code point goes.
ORACLE = rf"""
WITH RECURSIVE crc(i, v, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
run AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
own AS (SELECT d, w, count(*) AS c, hex(encode(d || ':' || w)) AS x FROM run GROUP BY d, w),
dig AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h FROM own, tab),
wrd AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM dig),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM wrd GROUP BY word HAVING sum(c) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM del d JOIN v ON v.word = d.k UNION SELECT v.word, d.word, d.n FROM del d JOIN v ON v.word = d.k),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
pick AS (SELECT near.word, n_near, best.m, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.m = best.m GROUP BY ALL),
f AS MATERIALIZED (SELECT v.word, CASE WHEN m >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM v LEFT JOIN pick USING (word)),
walk AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, root FROM f JOIN walk ON f.form = walk.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN walk USING (word)
"""
