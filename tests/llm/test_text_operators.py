import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from entaila.llm import bpe, html_text, langid, media, phrase_index, pii, quality, queries, token_counts

ODD = [None, "", " ", "a", "Hello  world\n\n'tis 3.5%", "é漢字🙂" * 50, "<|endoftext|>", "x" * 3000, " " * 500 + "y", "a \tb\r\n c  ", "\x00\x01 z"]


def docs(spark, texts, extra=True):
    """Rows with columns whose names operators could use themselves."""
    rows = [(k, t, "en", k, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, _text string, n_tokens string")


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks_path()), special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- byte-level BPE, token counts ------------------------------------------------
def test_bpe_equals_tiktoken(spark):
    enc, df = tiktoken_encoding(), docs(spark, ODD + ODD[:3])
    for r in bpe.digests(df).collect():
        want = enc.encode_ordinary((ODD + ODD[:3])[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha((ODD + ODD[:3])[r.doc_id] or ""))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(back[k] == (t or "").encode() for k, t in enumerate(ODD))
    assert bpe.digests(df.limit(0)).count() == 0


def test_bpe_random_strings():
    rng = np.random.default_rng(5)
    enc, b = tiktoken_encoding(), bpe.Bpe()
    texts = ["".join(rng.choice(list("abcdeé \n\t1.,'sS"), int(n))) for n in rng.integers(1, 900, 60)]
    assert b.encode_batch(texts) == [enc.encode_ordinary(t) for t in texts]
    for piece in ("ab" * 200, "zqxj" * 90):
        assert list(b.merge_long(piece.encode())) == enc.encode_ordinary(piece) == list(b.merge_rows(np.frombuffer(piece.encode(), np.uint8)[None])[0])


def test_token_histogram(spark):
    enc = tiktoken_encoding()
    texts = ["a b c d", "a b", None, "a b", "x " * 3000, ""]
    n = sorted(len(enc.encode_ordinary(t or "")) for t in texts)
    sums = token_counts.token_length_histogram(docs(spark, texts))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(n))
    for k, r in rows.items():
        assert (r.docs, r.docs_ge, r.tokens_ge) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (6, sum(n), sum(min(x, k) for x in n)) and r.share_le == sum(x <= k for x in n) / 6
    for r in token_counts.at_limits(sums, [1, 3, 10**6]).collect():
        assert (r.docs_ge, r.truncated_total) == (sum(x >= r.context_limit for x in n), sum(min(x, r.context_limit) for x in n))
    assert {r.q: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: n[2], 1.0: n[-1]}
    assert token_counts.token_length_histogram(docs(spark, []).limit(0)).count() == 0
    nulls = docs(spark, ["a", "b"]).withColumn("lang", F.lit(None).cast("string"))
    assert token_counts.token_length_histogram(nulls, group_col="lang").first().docs == 2


def test_long_texts_and_repeated_rows_of_the_encoder(spark):
    enc = tiktoken_encoding()
    texts = ["word and \n\n other 12 " * 250_000, "a" * 40_000, "x", "x"]  # the first is over one slice
    for r in bpe.digests(docs(spark, texts).union(docs(spark, texts[:2]))).collect():
        want = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha(texts[r.doc_id]))


# -- media ---------------------------------------------------------------------
def test_media_round_trip(spark):
    df = docs(spark, ODD + ["RIFF BM P5\n1 1\n255\n GIF89a .snd"] * 2)
    got = {r.doc_id: r for r in media.round_trip(df).collect()}
    for k, t in enumerate(ODD):
        p = media.payload(t)
        assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == (t or "").encode().rstrip(b"\0")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len((t or "").encode()), len(p), sha(p), zlib.crc32(p[-64:]))
    a, b = got[len(ODD)], got[len(ODD) + 1]
    assert a[1:] == b[1:]


def test_media_of_an_empty_table(spark):
    df = docs(spark, ["a"]).limit(0)
    assert media.round_trip(df).count() == media.store(df).count() == media.sniff(media.store(df), "doc_id", "media", "declared").count() == 0


def test_sniffing_corrects_and_carves():
    s = media.Sniffer()
    data = media.payload("some samples " * 30)
    for kind in media.WRITTEN:
        blob = media.write(kind, data)
        got = media.describe(blob, "gif", s)
        assert got["kind"] == kind and got["data"] == data and "corrected=1" in got["feature"]
        inside = media.describe(b"junk RIFF BM" + blob + b"tail", kind, s)
        assert inside["kind"] == "unknown" and inside["carved"] == [(kind, blob)]
        assert s(blob[: len(blob) // 2]) == []  # cut files don't pass
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b"
    assert s(b"xx" + gif)[0][:3] == ("gif", 2, 2 + len(gif))
    assert s(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02zz\xff\xd9")[0][0] == "jpeg"
    assert media.describe(None, None, s)["kind"] == "unknown"


def test_media_columns(spark):
    df = media.store(docs(spark, ["a", None]))
    got = {r.doc_id: r for r in media.sniff(df, "doc_id", "media", "declared").collect()}
    assert bytes(got[0].data) == media.payload("a") and bytes(got[1].data) == bytes(64)


# -- decontamination -----------------------------------------------------------------
def brute_hits(text, items):
    w = phrase_index.words(text)
    cover, found = set(), set()
    for i, t in items:
        iw = phrase_index.words(t)
        k = min(10, len(iw))
        wins = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in wins:
                cover |= set(range(a, a + k))
                found.add(str(i))
    return len(w), len(cover), sorted(found)


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(list("abcdef"), n))
    items = [(1, word(30)), (2, "Short É-item"), (3, None), (4, ""), (10, word(12)), (2, "Short É-item"), (11, "zz")]
    texts = [word(400), items[0][1].upper() + " x", "q " + items[4][1], "short é item ZZ zz", None, "", "!!!", items[0][1][:18], "a " * 20000 + items[4][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in phrase_index.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}
    built, inner = [], phrase_index.build_index
    monkeypatch.setattr(phrase_index, "build_index", lambda *a: built.append(1) or inner(*a))
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", 15)  # spans of several blocks are united, a long item is cut
    blocks = list(phrase_index.item_blocks(bench))
    assert len(blocks) > 3 and max(len(b.windows) for b in blocks) <= 16
    twice = docs(spark, texts).union(docs(spark, [texts[1], texts[5]]))  # rows that repeat an id
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in phrase_index.decontaminate(twice, bench).collect())
    assert got == sorted([(k, *brute_hits(t, items)) for k, t in enumerate(texts)] + [(0, *brute_hits(texts[1], items)), (1, *brute_hits(texts[5], items))])
    assert len(built) == 1  # one index for all blocks


@pytest.mark.parametrize("block", [phrase_index.BLOCK_WORDS, 2])
def test_decontamination_of_equal_rows_in_other_partitions(spark, monkeypatch, block):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block)
    rows = [(2, "one two"), (7, "cat"), (2, "one two"), (7, "dog"), (None, "cat"), (None, "dog"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "cat"), (2, "two"), (3, "owl"), (4, "one two")]
    got = phrase_index.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, *brute_hits(t, items)) for i, t in rows], key=str)


def test_decontamination_without_items_or_rows(spark):
    texts, bench = ["a b", None, ""], spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = phrase_index.report(docs(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and all(r.n_hit == 0 and r.items_sha256 == sha("") for r in none)
    assert phrase_index.report(docs(spark, texts).limit(0), bench).count() == 0


def test_proximity(spark):
    index = phrase_index.build_index(docs(spark, ["a x b", "a x x b a", None, "A É a É"]))
    assert {r.doc_id: r.pairs for r in phrase_index.near(index, "A", "b", 2).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.pairs for r in phrase_index.near(index, "a", "É", 1).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    for wrong in (("a", "b", 1000), ("a b", "c", 2), ("a", "!", 2)):
        with pytest.raises(ValueError):
            phrase_index.near(index, *wrong)


def test_terms_are_the_words(spark):
    texts = ["A-b c,d É9", "", "!!", "zz  zz\n", "a\x00b \x7f x"]
    term, n = phrase_index.terms_of(texts)
    assert term.tolist() == [phrase_index.term(w) for t in texts for w in phrase_index.words(t)] and n.tolist() == [len(phrase_index.words(t)) for t in texts]
    assert len(phrase_index.terms_of([])[0]) == 0


def test_phrase_queries_equal_sql(spark):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("op5_decontamination", "proximity"):
        df = queries.QUERIES[name](spark, d)
        res = con.execute(queries.ORACLES[name])
        at = [[x[0] for x in res.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in res.fetchall())


# -- language --------------------------------------------------------------------------
EN, DE = "the cat and the dog are with them on this ", "der hund und die katze sind nicht auf dem dach "


def test_language(spark):
    rows = [(k, (EN if k % 2 else DE) * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, None, "en"), (101, "123 !?", "de"), (102, "", None), (103, "und die katze", None), (104, EN * 4000, None), (104, EN * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "'x' as score", "'y' as lg", "'z' as txt", "2 as n")
    assert sorted(r.doc_id for r in langid.identify(df).collect()) == sorted(r[0] for r in rows)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(60))
    assert [got[k].lang_pred for k in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert {r.lang_pred for r in langid.identify(df.filter("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_code_lengths_follow_the_definition():
    texts = {"x": [b"abracadabra abracadabra abracadabra"], "y": [b"zzzz yyyy zzzz yyyy zzzz"]}
    counts = {k: np.unique(langid.ngrams(v), return_counts=True) for k, v in texts.items()}
    trees = langid.grow({k: (c, n.astype(float)) for k, (c, n) in counts.items()})

    def brute(lang, data):
        known = {}
        for v in texts[lang]:
            s = bytes(3) + v
            for i in range(3, len(s)):
                for d in range(4):
                    known.setdefault(s[i - d : i], {}).setdefault(s[i], 0)
                    known[s[i - d : i]][s[i]] += 1
        use = {b""}
        for lng in texts:
            for v in texts[lng]:
                s = bytes(3) + v
                seen = {}
                for i in range(3, len(s)):
                    for d in range(1, 4):
                        seen[s[i - d : i]] = seen.get(s[i - d : i], 0) + 1
                use |= {c for c, n in seen.items() if n >= langid.MIN_CONTEXT}
        total, s = 0.0, bytes(3) + data
        for i in range(3, len(s)):
            d = 0
            while d < 3 and s[i - d - 1 : i] in use:
                d += 1
            while True:
                if d < 0:
                    total += 8
                    break
                row = known.get(s[i - d : i])
                if row:
                    n, q = sum(row.values()), len(row)
                    if s[i] in row:
                        total -= np.log2(row[s[i]] / (n + q))
                        break
                    total -= np.log2(q / (n + q))
                d -= 1
        return total

    data = [b"abra zzzz", b"", b"qq\xffabracad"]
    got = trees.bits(data)
    for k, t in enumerate(data):
        assert np.allclose(got[k], [brute("x", t), brute("y", t)], atol=1e-3)


def test_tables_stay_within_their_bound():
    rng = np.random.default_rng(4)
    langs = {f"l{k:02d}": np.unique(langid.ngrams([bytes(rng.choice(rng.integers(97, 123, 8), 3000).astype(np.uint8))]), return_counts=True) for k in range(40)}
    counts = {k: (c, n.astype(float)) for k, (c, n) in langs.items()}
    whole, small = langid.grow(counts), langid.grow(counts, 200_000)
    assert small.n_bytes <= 200_000 < whole.n_bytes and len(small.parent) < len(whole.parent)
    assert langid.grow({}).langs == [] and langid.grow({"x": (np.zeros(0, np.int64), np.zeros(0))}).bits([b"ab"]).tolist() == [[16.0]]


def invented(rng, letters, n_words=12):
    """A language: a few words of its letters."""
    return ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(2, 7, n_words)]


def test_texts_in_an_unlearnt_language_go(spark):
    rng = np.random.default_rng(9)
    langs = {"aa": invented(rng, "abcdehilmnorst"), "bb": invented(rng, "aeioukpstrnvz"), "zz": invented(rng, "wqxyjgfuvcmd")}
    text = lambda lang, n: " ".join(rng.choice(langs[lang], n))
    rows = [(k, text(("aa", "bb")[k % 2], int(rng.integers(20, 200))), ("aa", "bb")[k % 2]) for k in range(300)]
    foreign = [(1000 + k, text("zz", 80), None) for k in range(50)]
    odd = [(2000, None, "aa"), (2001, "", None), (2002, "12 34", "bb"), (2003, "no. 4821 " + text("aa", 60), None), (2004, text("aa", 1), None), (5, rows[5][1], None)]
    df = spark.createDataFrame(rows + foreign + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "'x' as rate")
    kept = sorted(r.doc_id for r in langid.in_learnt_languages(df).collect())
    assert kept == sorted([*range(300), 5, 2003, 2004])  # all 50 planted texts go, all clean ones stay
    assert langid.in_learnt_languages(df).columns == df.columns and langid.in_learnt_languages(df.limit(0)).count() == 0
    assert langid.in_learnt_languages(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_a_language_left_out_of_the_documents_goes(spark):
    import os

    d = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(d)
    learnt = docs.filter("lang != 'es'")
    trees = langid.train(learnt.filter(~langid.held_out()))
    most = langid.bound(learnt.filter(langid.held_out()), trees)
    share = lambda rows: langid.accepted(rows, trees, most).count() / rows.count()
    assert share(docs.filter("lang = 'es'")) < 0.05 and share(learnt) > 0.99


# -- quality -----------------------------------------------------------------------------
def test_quality(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["stone", "river", "went", "the", "of", "light"], 60)) + "."
    bad = lambda: "BUY!!! $$$ " * int(rng.integers(5, 30))
    rows = [(k, good() if k % 2 else bad()) for k in range(200)] + [(500, None), (501, ""), (502, "w " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, 1), (7, None), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(df, lab).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k in range(200) if got[k].held_out]
    assert np.mean([got[k].predicted == k % 2 for k in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality.classify(df, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), lab).count() == 0


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["Stone", "river.", "went", "the", "of", "$$$", "BUY", "12"], int(rng.integers(1, 80)))) for _ in range(150)] + [None, "", "x" * 5000]
    rows = [(k, t, k % 2, 0.5, "z") for k, t in enumerate(texts)] + [(0, texts[0], 1, 0.5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, score double, lid string")  # names that the operator uses
    lab = [(k, int(len(texts[k] or "") % 3 == 0)) for k in range(0, 150, 2)]
    got = sorted((r.doc_id, r.score, r.predicted, r.held_out) for r in quality.classify(df, spark.createDataFrame(lab, "doc_id long, quality int")).collect())
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    learnt = sorted((k, y) for k, y in lab if not held(k)) + ([(0, dict(lab)[0])] if not held(0) else [])
    learnt.sort()
    m = quality.fit(np.array([quality.features(texts[k]) for k, _ in learnt]), np.array([y for _, y in learnt], float))

    def brute(text):
        x, z = quality.features(text or ""), m.bias
        for j, v in enumerate(x):
            z += m.tables[j][sum(e <= v for e in m.edges[j])]
        for (a, b), grid in zip(m.pairs, m.pair_tables, strict=True):
            z += grid[sum(e <= x[a] for e in m.pair_edges[a]), sum(e <= x[b] for e in m.pair_edges[b])]
        return 1 / (1 + np.exp(-z))

    want = sorted((k, brute(t), int(brute(t) >= 0.5), held(k)) for k, t, *_ in rows)
    assert [(k, p, h) for k, _, p, h in got] == [(k, p, h) for k, _, p, h in want] and np.allclose([r[1] for r in got], [r[1] for r in want])


def test_gam_is_additive_and_finds_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


# -- PII ------------------------------------------------------------------------------------
PII = {
    "email": "jane.doe42@mail.example.com", "phone": "+1 (743) 555-3824", "card": "4390 6985 7587 3170", "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789", "ip": "192.168.7.41", "date": "2021-02-28", "secret": "f33e61083db5dbdf4bd2369d2f80176e57f7fda2",
}


def test_pseudonyms_keep_format_link_and_invert(spark):
    p = pii.Pseudonyms(b"k1")
    for kind, v in PII.items():
        assert [(v[0:0] or "x " + v + " y")[a:b] for a, b, k in pii.spans("x " + v + " y")] == [v], kind
        assert pii.spans("x " + v + ". z")[0][2] == kind
        new = p(kind, v)
        assert new != v and p(kind, new, True) == v and pii.Pseudonyms(b"k2")(kind, v) != new
        if kind != "ip":
            assert len(new) == len(v) and [c.isdigit() for c in new if not c.isalpha()] == [c.isdigit() for c in v if not c.isalpha()] or kind in ("secret", "iban")
        assert pii.spans(new)[0][2] == kind
    assert pii.is_card(p("card", PII["card"])) and pii.is_iban(p("iban", PII["iban"])) and pii.parse_date(p("date", "31.12.1999"))
    for clean in ("4390698575873171", "300.1.1.1", "2021-02-30", "000-12-3456", "1.5 and 3.14", "a@b", "@x.com", "version 1.2.3", "in 2021", "12345678"):
        assert pii.spans(clean) == [], clean
    texts = [f"mail {PII['email']} call {PII['phone']}", PII["email"], None, "", "nothing", "x " * 100000 + PII["ip"]]
    out = {r.doc_id: r for r in pii.pseudonymise(docs(spark, texts), b"k1", kinds_col="kinds").collect()}
    assert out[0].kinds == ["email", "phone"] and out[1].text in out[0].text and out[2].text is None and out[3].text == "" and out[4].text == "nothing" and out[5].kinds == ["ip"]
    assert out[0]._text == "x" and pii.report(docs(spark, texts).limit(0)).count() == 0


def test_personal_data_next_to_numbers():
    found = lambda t: [(t[a:b], k) for a, b, k in pii.spans(t)]
    for form in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"):
        for t in ("{} 12/26", "{} 123.", "item 12 {}", "{} 7", "1 2 3 4 5 6 {} 7 8 9 10", "{}-99", "No. 12-{}-34", "2 {} 12th", "x {0}, {0} 12 {0}"):
            want = [(form, "card")] * max(1, t.count("{0}"))
            assert found(t.format(form)) == want, t.format(form)
    iban, phone = "ES91 2100 0418 4502 0005 1332", "555-123-4567"
    for t, want in {
        "id 12345 123-45-6789": [("123-45-6789", "ssn")],
        "12 34 56 2021-02-28 77": [("2021-02-28", "date")],
        f"room 1234 {phone} 99 11 22": [(phone, "phone")],
        "+34 612 345 678 4111 1111 1111 1111 12": [("+34 612 345 678", "phone"), ("4111 1111 1111 1111", "card")],
        "0034 612 345 678 2021-02-28": [("0034 612 345 678", "phone"), ("2021-02-28", "date")],
        "+1 (826) 555-4081 190.137.223.204": [("+1 (826) 555-4081", "phone"), ("190.137.223.204", "ip")],
        "+49 30.12.34.56": [("+49 30.12.34.56", "phone")],
        f"{iban} 2024": [(iban, "iban")],
        f"{iban} BIC": [(iban, "iban")],
        f"AB12 {iban}": [(iban, "iban")],
        "2021-02-28T10:30:00Z": [("2021-02-28", "date")],
        "25/12/1990 12/25/1990 31/04/1990": [("25/12/1990", "date"), ("12/25/1990", "date")],
        "2021-02-30 2021-02-28": [("2021-02-28", "date")],
    }.items():
        assert found(t) == want, t
    for n in (20_000, 40_000):  # long tables of numbers stay linear
        pii.spans("12 345 6 " * n)


def test_pseudonyms_of_day_first_dates_and_upper_case_secrets_invert():
    p, low = pii.Pseudonyms(b"k1"), PII["secret"]
    for d in range(13, 29):
        v = f"{d}/0{d % 9 + 1}/1990"
        new = p("date", v)
        assert new != v and int(new[:2]) > 12 and p("date", new, True) == v and pii.spans(new)[0][2] == "date"
    for v in (low.upper(), "A" + "0" * 31, low[:20] + low[20:].upper()):
        assert [k for _, _, k in pii.spans(f"key {v}.")] == ["secret"]
        new = p("secret", v)
        assert new != v and p("secret", new, True) == v and pii.spans(new)[0][2] == "secret" and [c.islower() for c in new if c.isalpha()].count(True) * v.isupper() == 0


def test_a_phone_number_is_linked_in_all_its_forms():
    p = pii.Pseudonyms(b"k")
    bare = lambda s: "".join(c for c in s.replace("(0)", "") if c.isdigit()).removeprefix("00")
    for forms in (
        ["+4915112345678", "+49 151 12345678", "+49 (0)151 12345678", "0049 151 12345678", "004915112345678", "+49-151-12345678"],
        ["+17435553824", "+1 743 555 3824", "+1 (743) 555-3824", "+1.743.555.3824"],
        ["+35312345678", "+353 1 234 5678"],
    ):
        new = [p.text(f"call {f} now") for f in forms]
        assert {k for _, ks in new for k in ks} == {"phone"} and len({bare(t) for t, _ in new}) == 1
        assert [p("phone", t[5:-4], True) for t, _ in new] == forms
        assert all(pii.country_end(t[5:]) == pii.country_end(f) and t[5:][: pii.country_end(f)] == f[: pii.country_end(f)] for f, (t, _) in zip(forms, new, strict=True))
    assert p.text("743-555-3824")[0] == p.text("+1-743-555-3824")[0][3:]


def test_long_texts_of_digits_take_linear_time():
    p = pii.Pseudonyms(b"k")
    for unit in ("1 ", "4111 1111 1111 1111 ", "123456789 "):
        began = time.time()
        p.text(unit * (400_000 // len(unit)))
        assert time.time() - began < 8


def test_one_value_in_two_formats_gets_one_pseudonym():
    p = pii.Pseudonyms(b"k1")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    for kind, forms in {"phone": ("(743) 555-3824", "743-555-3824", "743.555.3824", "+1 743 555 3824", "+1 (743) 555-3824"), "card": ("4390 6985 7587 3170", "4390698575873170", "4390-6985-7587-3170")}.items():
        assert len({digits(p(kind, v))[-10:] for v in forms}) == 1 and all(pii.spans(p(kind, v)) == [(0, len(v), kind)] and p(kind, p(kind, v), True) == v for v in forms)
    days = [("2001-03-25", "2001/03/25", "25.03.2001", "03/25/2001", "25/03/2001"), ("2001-03-05", "05.03.2001", "03/05/2001")]
    for forms in days:
        assert len({pii.parse_date(p("date", v))[0] for v in forms}) == 1 and all(p("date", p("date", v), True) == v for v in forms)


def test_long_secrets_are_found_whole_and_invert():
    p, r = pii.Pseudonyms(b"k1"), np.random.default_rng(3)
    for n in (32, 64, 65, 128, 129, 160, 100_000):
        for letters in ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF"):
            v = "a0" * 2 + "".join(r.choice(list(letters), n - 4)) if letters[10] == "a" else "A0" * 2 + "".join(r.choice(list(letters), n - 4))
            assert pii.spans(f"key {v}.") == [(4, 4 + n, "secret")]
            new = p("secret", v)
            assert new != v and len(new) == n and p("secret", new, True) == v and pii.spans(new) == [(0, n, "secret")]
            other = p("secret", v[:-1] + ("1" if v[-1] != "1" else "2"))
            assert other != new


def brute_spans(text):
    """Personal data by trying every substring: the first, then the longest, that is a whole value with free borders."""
    import re

    forms = {
        "email": r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", "ssn": r"\d{3}-\d\d-\d{4}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "date": r"\d{4}-\d\d-\d\d",
        "card": r"\d{4}( \d{4}){3}", "phone": r"\(\d{3}\) \d{3}-\d{4}", "secret": r"[0-9a-f]{32,}",
    }
    valid = {"ssn": pii.is_ssn, "ip": pii.is_ip, "card": pii.is_card, "date": lambda v: pii.parse_date(v) is not None}
    out, a = [], 0
    word = lambda c: c.isalnum()
    while a < len(text):
        for b in range(len(text), a, -1):
            v = text[a:b]
            free = not (a and (word(text[a - 1]) or text[a - 1] in ".@") and word(v[0])) and not (b < len(text) and word(text[b]) and word(v[-1]))
            kind = next((k for k, f in forms.items() if free and re.fullmatch(f, v) and valid.get(k, lambda _: True)(v)), None)
            if kind:
                out.append((a, b, kind))
                a = b - 1
                break
        a += 1
    return out


def test_pseudonyms_equal_brute_force(spark):
    r = np.random.default_rng(6)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    d = lambda n: "".join(r.choice(list("0123456789"), n))

    def value():
        body = "4" + d(14)
        card = body + pii.luhn_digit(body)
        return pick(
            f"user{d(2)}@mail{d(1)}.example", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}.{d(3)}.{d(1)}.{d(2)}", f"{1900 + int(d(2))}-{d(2)}-{d(2)}",
            " ".join(card[k : k + 4] for k in range(0, 16, 4)), " ".join(f"{r.integers(1000, 9999)}" for _ in range(4)), f"({2 + int(d(1)) % 8}{d(2)}) {d(3)}-{d(4)}", "".join(r.choice(list("0123456789abcdef"), pick(31, 32, 160))), "plain", d(5),
        )

    texts = [", and ".join(pick("some words", "we met") + " " + value() for _ in range(4)) + pick(".", "", "!") for _ in range(60)] + [None, "", "x"]
    p = pii.Pseudonyms(pii.TEST_KEY)
    for row in pii.report(docs(spark, texts).union(docs(spark, texts[:3]))).collect():
        text, out, at, found = texts[row.doc_id], [], 0, []
        for a, b, kind in brute_spans(text or ""):
            out += [text[at:a], p(kind, text[a:b])]
            at, found = b, [*found, kind]
        want = None if text is None else "".join([*out, text[at:]])
        assert (row.text, row.n_found, row.kinds) == (want, len(found), ",".join(sorted(set(found))))


def test_a_key_is_needed_and_names_must_be_new(spark):
    df = docs(spark, [PII["email"]])
    for wrong in ({"key": b""}, {"key": b"k", "kinds_col": "lang"}):
        with pytest.raises(ValueError):
            pii.pseudonymise(df, **wrong)
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.report(df).first().text == pii.Pseudonyms(b"another")("email", PII["email"])
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for m1, m2 in ((10, 10), (7, 13), (1, 10)):
        seen = {f(x, m1, m2, b"t") for x in range(m1 * m2)}
        assert seen == set(range(m1 * m2)) and all(f(f(x, m1, m2, b"t"), m1, m2, b"t", True) == x for x in range(m1 * m2))


# -- HTML --------------------------------------------------------------------------------------
def test_blocks_and_decoding():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/x>Home</a></nav><article><h1>A &amp; B</h1><p><b>One<br>two\n  three<p>Four</p></article><!-- c --><div>x < y</div>"
    assert [b.text for b in html_text.blocks(page)] == ["Home", "A & B", "One two three", "Four", "x < y"]
    for odd in ("", "   ", "<", "<p", "</p>", "<p attr='x>y", "<a " * 200, "<div>" * 3000 + "z"):
        html_text.blocks(odd)


def test_crf_on_held_out_pages(spark):
    crf = html_text.train()
    pages = html_text.labelled_pages(120, seed=123)
    same = total = 0
    for h, main in pages:
        bs = html_text.blocks(h)
        want = [int(b.text in main) for b in bs]
        got = crf.decode(html_text.block_features(bs)) if bs else []
        same, total = same + sum(a == b for a, b in zip(want, got, strict=True)), total + len(want)
    assert same / total > 0.97
    df = spark.createDataFrame([(1, "u", pages[0][0], "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<script>x</script>", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df, crf=crf).collect()}
    assert got[1].text and got[2].text == got[3].text == got[4].text == ""
    assert html_text.report(df.limit(0)).count() == 0


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    crf = html_text.Crf()
    crf.node, crf.edge = rng.normal(size=crf.node.shape), rng.normal(size=(2, 2))
    feats = [[int(x) for x in rng.integers(0, html_text.HASH, 4)] for _ in range(7)]
    s = crf.scores(feats)
    best = max(product((0, 1), repeat=7), key=lambda y: sum(s[k, y[k]] for k in range(7)) + sum(crf.edge[a, b] for a, b in zip(y, y[1:])))
    assert crf.decode(feats) == list(best)


def test_reading_a_page_takes_time_in_proportion_to_its_length():
    n = 150_000
    pages = ["<b>" * n + "</i>" * n, "<a " * n, "<button>x" * n, "<div>x" * n, "<b>" * n + "<hr>" * n, '<a ">" ' * n, "<!x" * n, "<" * n, "<p><b>" * n, '<div class="' + "ab " * n + '">' + "<p>x</p>" * n, "&amp" * n, "<ul><li>x" * n]
    for page in pages:  # the sum of squares of these lengths would take hours
        began = time.time()
        html_text.block_features(html_text.blocks(page))
        assert time.time() - began < 60, page[:20]
    assert [b.text for b in html_text.blocks("<p>a<button>x</button>z<i title='>'>y</i><b title=\"1>2'\">w</b><i title='>u")] == ["azywu"]


def test_tag_ends():
    end = html_text.TagEnds("<a b='>'>x<a \">y<a>" + " " * 400 + "<a '" + "-" * 400 + ">'>z")
    assert end(2) == (8, True) and end(12) == (14, False)


def test_an_article_is_found_in_many_layouts():
    from hand_pages import LAYOUTS

    crf = html_text.train()
    for name, (page, want) in LAYOUTS.items():
        assert html_text.main_text(f"<html><head><title>Flood</title></head><body>{page}</body></html>", crf).split("\n") == want, name



def test_hand_labelled_pages_of_other_styles():
    from hand_pages import PAGES

    crf, right, total = html_text.train(), 0, 0
    for page, main in PAGES:
        bs = html_text.blocks(page)
        assert set(main) <= {b.text for b in bs}
        got = crf.decode(html_text.block_features(bs))
        right, total = right + sum(y == (b.text in main) for b, y in zip(bs, got, strict=True)), total + len(bs)
    assert right / total >= 0.95


def brute_main_text(page, crf):
    """The same text by the library's parser, features by name and all labellings."""
    from html.parser import HTMLParser
    from itertools import product

    found, stack, text = [], [], []

    class Reader(HTMLParser):
        def block(self):
            whole = " ".join("".join(t for t, _ in text).split())
            if whole:
                found.append(html_text.Block(whole, tuple(m for _, ms in stack for m in ms), sum(len(t) for t, a in text if a)))
            text.clear()

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK_TAGS:
                self.block()
            marks = [tag] if tag in html_text.BLOCK_TAGS or tag == "a" else []
            for k, v in attrs:
                if k in ("class", "id", "role"):
                    marks += [w if k == "role" else f".{w}" for w in "".join(c if "a" <= c <= "z" else " " for c in (v or "").lower()).split()]
            stack.append((tag, marks))

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK_TAGS:
                self.block()
            while stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if not any(t in ("script", "style", "head") for t, _ in stack):
                text.append((data, any(t == "a" for t, _ in stack)))

    r = Reader()
    r.feed(page), r.close(), r.block()
    if not found:
        return ""
    score = [sum((crf.node[s] for s in f), np.zeros(2)) for f in html_text.block_features(found)]
    best = max(product((0, 1), repeat=len(found)), key=lambda y: sum(score[k][v] for k, v in enumerate(y)) + sum(crf.edge[a, b] for a, b in zip(y, y[1:])))
    return "\n".join(b.text for b, v in zip(found, best, strict=True) if v)


def test_extraction_equals_brute_force(spark):
    crf = html_text.train()
    part = lambda k: f"<div class='menu'><a href='/{k}'>Link {k}</a> and more</div><article id=\"main text\"><h1>Title {k} &amp; more</h1><p>First  sentence of <b>the</b> page. It has\nwords, and caf&eacute;.</p><ul><li>One item</li><li>Two &lt;items&gt;</li></ul></article><aside role='complementary'><p>Also read {k} here</p></aside><script>var x = '<p>no</p>';</script><footer>&copy; {k} Inc.</footer>"
    pages = [part(k) for k in range(4)] + [f"<html><head><title>t</title></head><body>{part(9)}</body></html>", "plain text alone.", "<p></p>", "", None, part(1)]
    rows = [(k, "u", h, "x") for k, h in enumerate(pages)] + [(0, "u", pages[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.report(df).collect())
    assert got == sorted((k, t := brute_main_text(h or "", crf), len(t)) for k, _, h, _ in rows) and "café" in got[0][1] and "<items>" in got[0][1]


def test_language_counts_and_bound_take_all_rows(spark):
    rows = [(k, "ab" * 50, "x") for k in range(3200)] + [(5000 + k, "cd" * 30, "y") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = np.concatenate([langid.ngrams([t.encode()]) for _, t, g in rows if g == "x"])
    want = langid.grow({"x": tuple(a.astype(t) for a, t in zip(np.unique(codes, return_counts=True), (np.int64, float), strict=True)), "y": tuple(a.astype(t) for a, t in zip(np.unique(langid.ngrams([t.encode() for _, t, g in rows if g == "y"]), return_counts=True), (np.int64, float), strict=True))})
    got = langid.train(df)
    assert got.langs == want.langs and np.array_equal(got.cell, want.cell) and np.array_equal(got.bits_of, want.bits_of) and np.array_equal(got.escape, want.escape)
    values = np.random.default_rng(6).random(2001) * 3
    rates = spark.createDataFrame([(float(v),) for v in values] + [(1.5,)] * 700 + [(40.0,)] * 3, "rate double").repartition(5)
    every = [*values, *[1.5] * 700, *[40.0] * 3]
    for q in (0.0, 0.3, 0.5, 0.999, 1.0):
        assert np.isclose(langid.quantile(rates, q), np.quantile(every, q), rtol=1e-12)
    assert langid.quantile(rates.limit(0), 0.5) is None


def test_a_worker_holds_little_beside_its_tables():
    """Tasks of all operators run in the same workers, so what one keeps or takes at once lessens the room of the next."""
    import random
    import tracemalloc

    from entaila.llm import hashing

    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randint(4, 9))) for _ in range(400)) for _ in range(1000)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    code, n = np.unique(langid.ngrams(raw[:50]), return_counts=True)
    trees, b = langid.grow({"en": (code, n), "fr": (code, n)}), bpe.Bpe()
    tracemalloc.start()
    try:

        def taken(f):
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            out = f()
            now, peak = tracemalloc.get_traced_memory()
            return out, now - before, peak - before

        _, kept, _ = taken(lambda: hashing.spans_hash(hashing.prefix_sums(data), np.array([0, 5]), np.array([9, len(data)])).tolist())
        assert kept < 1 << 20
        bits, _, peak = taken(lambda: trees.bits(raw))
        assert peak < 15 * len(data)
        ids, kept, _ = taken(lambda: sum(map(len, b.encode_batch(texts))))
        assert ids > len(texts) and kept < 300 * len(b.cache)
    finally:
        tracemalloc.stop()
    assert (bits == np.concatenate([trees.bits([r]) for r in raw])).all()
    assert bpe.Bpe().encode_batch(["", texts[0]]) == [[], b.encode_batch(texts[:1])[0]] and b.encode_batch([]) == [] and trees.bits([]).shape == (0, 2)


def test_few_segments_of_the_index_meet_in_a_file_or_batch(spark, monkeypatch):
    """Segments are large: neither Parquet's writer, nor a reader, nor a batch for Python holds many of them."""
    from entaila.llm import common, phrase_index

    monkeypatch.setattr(common, "BATCH_ROWS", 1)  # a segment a text
    docs = spark.createDataFrame([(k, f"the {k} that") for k in range(40)], "doc_id long, text string").coalesce(1)
    index = phrase_index.build_index(docs)
    assert index.count() == 40 and max(r["count"] for r in index.groupBy(F.input_file_name()).count().collect()) <= phrase_index.FILE_SEGMENTS
    sizes = lambda: sorted(r.n for r in index.select("segment").mapInPandas(lambda it: (pdf.assign(n=len(pdf))[:1] for pdf in it), "segment long, n long").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    with common.batch_rows(spark, phrase_index.BATCH_SEGMENTS):
        assert sizes()[-1] <= phrase_index.BATCH_SEGMENTS
    assert sizes()[-1] > phrase_index.BATCH_SEGMENTS
    found = {r.doc_id: r.pairs for r in phrase_index.near(index, "the", "that", 2).collect()}
    assert found == dict.fromkeys(range(40), 1)
