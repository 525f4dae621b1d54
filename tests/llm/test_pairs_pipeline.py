import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from entaila.llm import near_duplicates, phrase_index, repeats
from entaila.llm.graph import components
from entaila.llm.shingles import shingle_sets


def docs(spark, texts):
    rows = [(k, t, "en", "s", len(t or ""), "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, root string")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (3, 1)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} | {101 + k: 100 for k in range(20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(texts, t=0.8):
    sets = {}
    for k, x in enumerate(texts):
        w = phrase_index.words(x)
        s = frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset([k])
        sets.setdefault(s, []).append(k)
    keys = list(sets)
    near = {a: [b for b in keys if a != b and len(a & b) >= t * len(a | b) - 1e-9] for a in keys}
    root, links = {k: sets[k][0] for k in keys}, {a: len(bs) for a, bs in near.items()}
    while any(root[b] > root[a] for a in keys for b in near[a]):
        for a in keys:
            for b in near[a]:
                root[b] = min(root[a], root[b])
    return {d: (root[k], links[k], len(ds) - 1) for k, ds in sets.items() for d in ds}


def near_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 1, 2, 4, 9):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(120)] = word()
            out.append(" ".join(w))
    return [*out, None, "", "!!", "one two", "One, two", "one two three four five", out[0].upper()]


def classes_of(frame):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near_duplicates.classes(frame).collect()}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_classes(texts)
    assert classes_of(docs(spark, texts)) == want
    monkeypatch.setattr(near_duplicates, "SMALL", 2)  # larger nodes by matrix products
    monkeypatch.setattr(near_duplicates, "BLOCK", 300)  # nodes are cut into pairs of blocks
    assert classes_of(docs(spark, texts)) == want
    monkeypatch.setattr(near_duplicates, "TAIL", 0)  # the shortest prefix alone
    assert classes_of(docs(spark, texts)) == want
    assert near_duplicates.classes(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = ("w%d " % k + "x y z u v w one two three four five six seven eight nine ten eleven twelve" for k in range(3))
    rows = [(1, a), (1, a), (1, b), (2, c), (None, a), (None, None), (3, "other words stand here alone"), (3, "other words stand here alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in near_duplicates.classes(frame).collect())
    assert got == [(0, 0, 0, 0), (0, 1, 2, 2), (1, 1, 2, 0), (1, 1, 2, 2), (1, 1, 2, 2), (2, 1, 2, 0), (3, 3, 0, 1), (3, 3, 0, 1)]


def edited(r, base, edits):
    w = list(base)
    for k in r.sample(range(len(w)), edits):
        w[k] = f"e{r.randrange(10**9)}"
    return " ".join(w)


def test_prefixes_are_shortened_until_the_recall_is_met(spark, monkeypatch):
    depths, inner = [], near_duplicates._round
    monkeypatch.setattr(near_duplicates, "_round", lambda *a: depths.append(a[3]) or inner(*a))
    r = random.Random(2)
    bases = [[f"b{k}w{r.randrange(10**6)}" for _ in range(200)] for k in range(60)]
    classes_of(docs(spark, [edited(r, b, e) for b in bases for e in (0, 1)]))
    assert depths == [8]  # copies of one edit meet at full depth
    depths.clear()
    texts = [edited(r, b, e) for b in bases for e in (0, 3, 5, 7)]
    got = classes_of(docs(spark, texts))
    assert depths[0] == 8 and 4 <= depths[-1] < 8 and len(depths) <= 3
    want = brute_classes(texts)
    assert sum(x[1] for x in got.values()) >= 0.999 * sum(x[1] for x in want.values()) > 100
    assert {k for k in want if want[k][0] != k} == {k for k in got if got[k][0] != k}


def test_forest_depth_and_recall():
    shortest = near_duplicates.shortest_prefix(0.8)
    assert shortest == 4 and near_duplicates.shortest_prefix(0.2) == 1
    assert near_duplicates.measured({100: 5}, 8) == 1 and abs(near_duplicates.measured({80: 10}, 8) - near_duplicates.meets(0.8, 8)) < 1e-9 and near_duplicates.measured({80: 10, 99: 10}, 8, 4) > 0.9995
    rng = np.random.default_rng(0)
    met = np.zeros(5)
    for _ in range(400):
        base = rng.integers(0, 2**63, 180).astype(np.uint64)
        prefix, tail = near_duplicates.strings([np.unique(base[:170]), np.unique(base[10:])], shortest)
        for k in range(5):
            met[k] += bool(((prefix[0] == prefix[1]) & (tail[0] >> np.uint64(16 * k) == tail[1] >> np.uint64(16 * k) if k < 4 else prefix[0] == prefix[1])).any())
    for k, share in enumerate(met / 400):  # similarity 160 / 180
        assert abs(share - near_duplicates.meets(160 / 180, 8 - k)) < 0.02


def test_shingles():
    sets = shingle_sets(["a b c d e f", "A-b c,d e  f", "a b", "", "x " * 300_000])
    assert len(sets[0]) == 2 and (sets[0] == sets[1]).all() and len(sets[2]) == 1 and len(sets[3]) == 0 and len(sets[4]) == 1


def brute_repeats(texts):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        cover, new = bytearray(len(b)), set()
        for a in range(len(b) - 49):
            w = b[a : a + 50]
            new.add(w)
            if w in seen:
                cover[a : a + 50] = b"\1" * 50
        seen |= new
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(bool(cover[a]) and (a == 0 or not cover[a - 1]) for a in range(len(b)))
        out[k] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    rnd = lambda n, s="abcdefghij klmné": "".join(r.choice(s) for _ in range(n))
    shared = [rnd(n) for n in (49, 50, 51, 80, 200, 700)]
    phrase = rnd(30)  # a minimiser met in many contexts
    texts = [None, "", "short", "short"]
    for _ in range(30):
        texts.append(rnd(r.randrange(5, 60)) + r.choice(shared) + rnd(r.randrange(60)) + r.choice(shared)[r.randrange(20) :] + rnd(9))
    texts += [texts[7], "a" * 400, "b" + "a" * 300, "ab" * 200, "ba" * 150, shared[4] * 3, "é" * 60, "é" * 70, "z" * 49, "z" * 49]
    texts += [rnd(40) + phrase + r.choice(("same tail of many letters in a row here", rnd(40))) for _ in range(20)] + [rnd(700) + shared[4]]
    want = brute_repeats(texts)
    rows = lambda: {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.report(docs(spark, texts)).collect()}
    assert rows() == want
    for name, value in (("HOT", 2), ("PIECE", 120), ("LOT", 3)):  # split minimisers, long texts, small lots
        monkeypatch.setattr(repeats, name, value)
    assert rows() == want
    assert repeats.report(docs(spark, texts).limit(0)).count() == 0
    assert repeats.report(docs(spark, [None, ""])).count() == 2


def test_a_string_in_all_documents_is_sent_once_a_chunk(spark, monkeypatch):
    sent, inner = [], repeats.window_ids
    monkeypatch.setattr(repeats, "window_ids", lambda strings, least: sent.append(len(strings)) or inner(strings, least))
    passage = "this passage of many words stands in every document of the table and costs one row a chunk"
    texts = [f"{k} {passage}" for k in range(300)]
    got = {x.doc_id: x.n_removed for x in repeats.report(docs(spark, texts)).collect()}
    want = brute_repeats(texts)
    assert got == {k: x[1] for k, x in want.items()} and sum(v > 0 for v in got.values()) == 299


def test_repeats_with_repeated_and_null_ids(spark):
    a, b, c = (f"{w} alone stands here at the front " + "and the rest of it is shared by all three of these texts" for w in ("first", "second", "other"))
    frame = spark.createDataFrame([(1, a), (1, a), (1, b), (2, c), (None, a), (None, None)], "doc_id long, text string")
    got = {(x.doc_id, x.n_bytes): x.n_removed for x in repeats.report(frame).collect()}
    shared = len(" alone stands here at the front and the rest of it is shared by all three of these texts")
    assert got == {(1, len(a)): 0, (1, len(b)): 0, (2, len(c)): shared, (None, len(a)): len(a), (None, 0): 0}


@pytest.mark.parametrize("seed", range(4))
def test_column_order_is_the_suffix_order(seed):
    r = random.Random(seed)
    strings = list({"".join(r.choice("ab" if seed % 2 else "abcd") for _ in range(r.randrange(50, 81))).encode() for _ in range(25)})
    who, size, lcp = repeats.column_order(strings)
    suffix = [strings[w][len(strings[w]) - s :] for w, s in zip(who, size, strict=True)]
    assert suffix == sorted(suffix) and len(suffix) == sum(map(len, strings)) + len(strings)
    for k in range(1, len(suffix)):
        n = 0
        while n < min(len(suffix[k]), len(suffix[k - 1])) and suffix[k][n] == suffix[k - 1][n]:
            n += 1
        assert lcp[k] == n


def test_pipeline_equals_brute_force(spark, tmp_path):
    en, de = "the cat and the dog are with them on this hill {} today", "der hund und die katze sind nicht auf dem dach {} heute"
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(5))
    text = lambda form: " ".join(form.format(word()) for _ in range(6))
    passage = " ".join(word() for _ in range(14))
    base = text(en)
    texts = [text(en if k % 2 else de) for k in range(40)] + [base, base, base + " end", f"{text(en)} {passage}", "123 456", None, f"{text(de)} mail jane.doe@mail.example.com", ""]
    rows = [(k, t, "de" if k < 40 and k % 2 == 0 else "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(41), 46}
    from entaila.llm import bpe, pii

    b = bpe.Bpe()
    for k, x in got.items():
        assert x.n_tokens == len(b.encode_batch([pii.Pseudonyms(pii.TEST_KEY).text(texts[k])[0]])[0])
    names = spark.read.parquet(str(tmp_path / "documents.parquet")).columns
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == names


def test_pipeline_stages_on_nulls_extra_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(spark, [None, "", "one two three", "one two three", None])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, str(tmp_path))
        if name not in ("language", "tokens"):
            kept = {r.doc_id for r in got.collect()}
            assert kept == ({0, 1, 2, 4} if name == "near_copies" else {0, 1, 2, 3, 4}) and got.columns == d.columns
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.language(spark, d, "").collect()} == {2, 3}


def test_pipeline_decides_by_row(spark, tmp_path):
    spark.createDataFrame([(1, "secret item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b, c = "one two three four five six", "other words that stand alone here", "again something else without a copy"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (3, None), (3, None), (5, b)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, id string").repartition(5)
    key = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    got = corpus_pipeline.near_copies(spark, frame, str(tmp_path))
    assert key(got) == sorted([(1, a), (5, b), (None, c), (3, None), (3, None)], key=str) and got.columns == frame.columns
    mixed = spark.createDataFrame([(1, "a secret item"), (1, "clean"), (None, "Secret, item!"), (None, "clean"), (1, "clean")], "doc_id long, text string")
    assert key(corpus_pipeline.decontaminate(spark, mixed, str(tmp_path))) == [(1, "clean"), (1, "clean"), (None, "clean")]
