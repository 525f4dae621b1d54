from collections import Counter

import pytest
from pyspark.sql import functions as F

from entaila.functions.columns import key_ladder, norm_lemma, without_markup
from entaila.operators import cooc, text


def tokens(spark, docs):
    return spark.createDataFrame([(k, w) for k, w in enumerate(docs)], "doc_id long, tokens array<string>")


@pytest.mark.parametrize("n,starts", [(0, []), (20, []), (21, [0]), (100, [0]), (101, [0]), (121, [0, 100]), (200, [0, 100]), (201, [0, 100]), (221, [0, 100, 200])])
def test_chunks(spark, n, starts):
    got = text.chunked(tokens(spark, [["w"] * n])).orderBy("start").collect()
    assert [r["start"] for r in got] == [s for s in starts if n - s > 20]
    assert all(len(r["tokens"]) == min(200, n - r["start"]) for r in got)


def test_markup_order(spark):
    cases = {"a<b>c": "a c", "[[x|y]]": "y", "[[x]]": "x", "{{t}}z": " z", "a&amp;b": "a b", "&AMP;": "&AMP;"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", without_markup("t").alias("c")).collect()} == cases


def brute(docs, vocab, first, last):
    out = Counter()
    for d in docs:
        for i, a in enumerate(d):
            for j, b in enumerate(d):
                if first <= abs(i - j) <= last and a in vocab and b in vocab:
                    out[a, b] += 2
    return out


def test_counts_three_ways(spark):
    docs = [list("abcabca"), list("aaaaaaa"), list("xay"), [], ["a"], list("bzzzzb")]
    ch = tokens(spark, docs).withColumn("start", F.lit(0))
    vocab = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("y", 1)], "word string, cnt long")
    for first, last in ((1, 2), (2, 5), (5, 19)):
        want = brute(docs, set("abcy"), first, last)
        for f in (cooc.window_counts, cooc.band_join_counts):
            assert {(r.w1, r.w2): r.x for r in f(ch, vocab, first, last).collect()} == dict(want)
    halves = cooc.merged(*[cooc.window_counts(ch.filter(F.col("doc_id") % 2 == k), vocab, 1, 2) for k in (0, 1)])
    assert {(r.w1, r.w2): r.x for r in halves.collect()} == dict(brute(docs, set("abcy"), 1, 2))


def test_probabilities_and_errors(spark):
    x = spark.createDataFrame([("a", "b", 4), ("b", "a", 4), ("a", "a", 2)], "w1 string, w2 string, x long")
    vocab = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "word string, cnt long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "a"), ("q", "a")], "w1 string, w2 string")
    got = {(r.w1, r.w2): (r.freq, r.joint, r.cond) for r in cooc.pair_probabilities(pairs, x, vocab).collect()}
    assert got[("a", "b")] == (4, 0.4, 4 / 6) and got[("b", "b")] == (0, 0.0, 0.0) and got[("c", "a")] == (0, 0.0, 0.0) and got[("q", "a")] == (None, None, None)
    assert {(r.w1, r.w2): r.freq for r in cooc.pair_counts(pairs, x).collect()}[("q", "a")] == 0
    for bad in (lambda: cooc.ppmi(x, 0), lambda: cooc.query_pairs(pairs, x, vocab, "x"), lambda: cooc.query_pairs(pairs, x, vocab, "prob", "y")):
        with pytest.raises(ValueError):
            bad()


def test_associates_filters_and_ties(spark):
    v = spark.createDataFrame([("a", w, s) for w, s in (("zz", 2.0), ("yy", 2.0), ("the", 9.0), ("q", 8.0), ("a", 7.0), ("www", 6.0), ("xx", 0.0))], "w1 string, w2 string, ppmi double")
    got = cooc.associates(v, spark.createDataFrame([("yy", 5)], "word string, cnt long"), 3).orderBy("rank").collect()
    assert [(r.w2, r.freq) for r in got] == [("yy", 5), ("zz", 0)]


def test_numbered_is_dense_for_any_partitioning(spark):
    words = [f"w{k:03d}" for k in range(257)]
    for parts in (1, 7):
        df = spark.createDataFrame([(w,) for w in words], "word string").repartition(parts)
        assert {r.word: r.idx for r in text.numbered(df, "word").collect()} == {w: k for k, w in enumerate(words)}
    assert text.numbered(spark.createDataFrame([], "word string"), "word").count() == 0


def test_lemmas_and_keys(spark):
    df = spark.createDataFrame([(" Pike  Fish-x ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(norm_lemma(F.col("s"))).collect()] == ["pike_fish_x", "", None]
    r = spark.createDataFrame([("Ab c!",)], "s string").select(key_ladder("s")).first()[0]
    assert r == ["Ab c!", "ab c!", "ab_c!", "ab c", "ab_c"]


def test_counts_are_not_sent_for_their_names(spark):
    known = spark.createDataFrame([("a", 3, 0), ("b", 2, 1)], "word string, cnt long, idx long")
    x = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (0, 0, 4)], "i long, j long, x long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cooc.named(x, known)
        assert sorted(map(tuple, got.collect())) == [("a", "a", 4), ("a", "b", 2), ("b", "a", 2)]
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_associates_meet_packed_rows_once(spark, monkeypatch):
    """The rows of the separate steps, from one shuffle of packed counts: no counted pair is sent by itself."""
    import numpy as np

    from entaila.functions.columns import rounded
    from entaila.operators import packed

    rng = np.random.default_rng(3)
    words = ["the", "a", "www", *(f"w{k}" for k in range(300))]
    docs = [[words[min(int(k), 302)] for k in rng.zipf(1.3, n) - 1] for n in rng.integers(0, 90, 60)]
    ch = tokens(spark, docs).withColumn("start", F.lit(0)).repartition(3)
    known = cooc.numbered_words(text.vocabulary(ch, 2)).cache()
    encoded = cooc.cut(cooc.encoded(ch, known))
    x = cooc.number_counts(encoded)
    sums = {r.i: r.r for r in packed.word_sums(encoded).collect()}
    assert sums == {r.w: r.r for r in cooc.marginals(x, "i").collect()}
    want = cooc.associates(cooc.ppmi(x, i="i", j="j", symmetric=True).withColumn("ppmi", rounded("ppmi")), known, 3, numbers=("i", "j"))
    for sizes in ({}, {"run": 50, "held": 100}):
        every = packed.row_entries(packed.packed_counts(encoded, **sizes), lambda i, j, n: n > 0)
        assert sorted(map(tuple, every.collect())) == sorted(map(tuple, x.collect()))
    got = cooc.best_associates(encoded, known, 3)
    assert got.count() > 300 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "deltas" in plan and "hashpartitioning(key" not in plan
    monkeypatch.setattr(cooc, "BROADCAST_SUMS", 0)
    assert sorted(map(tuple, cooc.best_associates(encoded, known, 3).collect())) == sorted(map(tuple, want.collect()))


def test_packed_numbers_come_back():
    import numpy as np

    from entaila.operators.packed import _numbers, _varints

    for x in ([], [0], [127, 128, 0, (1 << 38) - 1, (1 << 62) + 5], list(range(300))):
        assert _numbers(_varints(np.array(x, np.int64))).tolist() == x


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upserted_counts_meet_packed(spark):
    """Stored and new counts are packed and added up by blocks of words; no counted pair is sent by itself."""
    from entaila import catalogue
    from entaila.operators import packed

    words = "a b c d".split()
    ch = tokens(spark, [[words[k % 4] for k in range(n)] for n in (30, 41, 7, 0)]).withColumn("start", F.lit(0))
    known = cooc.numbered_words(text.vocabulary(ch, 1))
    enc = cooc.cut(cooc.encoded(ch, known))
    halves = [packed.packed_counts(enc.filter(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    want = sorted(map(tuple, cooc.number_counts(enc).collect()))
    assert want and sorted(map(tuple, cooc.merged_packed(cooc.cut(halves[0]), halves[1]).collect())) == want
    assert sorted(map(tuple, cooc.merged_packed(*halves, halves[0].limit(0)).collect())) == want
    plan = plan_of(catalogue.QUERIES["cooc_upsert_merge"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(block" in plan and "hashpartitioning(w1" not in plan


def test_band_join_counts_numbers_once(spark):
    """Pairs are counted by number, both ways as one: words are not sent for their counts, nor the counts twice."""
    docs = [[f"w{k % 7}" for k in range(n)] for n in (30, 41, 7, 0)]
    ch = tokens(spark, docs).withColumn("start", F.lit(0))
    vocab = text.vocabulary(ch, 4)
    got = cooc.band_join_counts(ch, vocab)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cooc.window_counts(ch, vocab).collect())) != []
    plan = plan_of(cooc.band_join_counts(ch, vocab))
    assert "hashpartitioning(key" in plan and "hashpartitioning(w1" not in plan and "Union" not in plan


def test_counts_of_whole_texts_are_those_of_their_chunks(spark):
    """A pair of places counts once for each chunk that has both; texts are looked up and counted without a shuffle of places or pairs."""
    import numpy as np

    from entaila import catalogue
    from entaila.operators import packed

    rng = np.random.default_rng(4)
    tk = tokens(spark, [[f"w{k}" for k in rng.integers(0, 40, n)] for n in (0, 1, 20, 21, 99, 100, 119, 120, 121, 200, 201, 220, 221, 450, 1000)])
    known = cooc.numbered_words(text.vocabulary(text.chunked(tk), 50))
    enc = cooc.cut(cooc.encoded(tk, known))
    want = sorted(map(tuple, cooc.number_counts(text.chunked(enc)).collect()))
    assert want and sorted(map(tuple, cooc.text_counts(enc).collect())) == want
    assert sorted(map(tuple, packed.word_sums(enc, cuts=cooc.CUTS).collect())) == sorted(map(tuple, cooc.marginals(cooc.number_counts(text.chunked(enc)), "i").collect()))
    for size, step, least in ((7, 3, 2), (6, 3, 1)):
        got = packed.row_entries(packed.packed_counts(enc, 1, 4, cuts=(size, step, least)), lambda i, j, n: n > 0)
        chunks = text.chunked(enc, size, step, least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cooc.number_counts(chunks, 1, 4).collect()))
    plan = plan_of(catalogue.QUERIES["cooc_window"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(block" in plan and "hashpartitioning(doc_id" not in plan and "hashpartitioning(key" not in plan
