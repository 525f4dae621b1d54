import gzip
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from entaila.functions.columns import f_and, f_implies, pmean_error
from entaila.operators import evaluate, features, logic, models, report, resolve
from entaila.sources import files
from entaila.streaming import counts


def senses(spark):
    return spark.createDataFrame([("pike_fish", "n", "s1", 1), ("pike", "n", "s2", 1), ("pike", "v", "s3", 2), ("fish", "n", "s4", 1), ("fish", "n", "s2", 2), ("run", "v", "s5", 1)], "lemma string, pos string, synset string, rank long")


def test_candidates(spark):
    specs = spark.createDataFrame([("Pike Fish",), ("pike-cod fish",), ("run",), ("zzz",)], "spec string")
    got = {}
    for r in resolve.candidates(specs, senses(spark)).orderBy("ord").collect():
        got.setdefault(r.spec, []).append(r.synset)
    assert got == {"Pike Fish": ["s1"], "pike-cod fish": ["s2", "s4"]}
    anyway = resolve.candidates_or_any(specs, senses(spark)).filter("spec = 'run'").collect()
    assert [r.synset for r in anyway] == ["s5"]


def test_pick_word_steps_and_ties(spark):
    steps = spark.createDataFrame([(1, 0, ["x", "a", "b"], "a"), (1, 1, ["c"], "a"), (2, 0, ["x"], None), (2, 1, ["c", "d"], None), (3, 0, [], None)], "id long, step int, words array<string>, banned string")
    vocab = spark.createDataFrame([(w, 1) for w in "abcd"], "word string, cnt long")
    m = spark.createDataFrame([("a", 9), ("b", 1), ("c", 2), ("d", 2)], "w string, r long")
    assert {r.id: (r.word, r.step) for r in resolve.pick_word(steps, m, vocab).collect()} == {1: ("b", 0), 2: ("c", 1), 3: (None, None)}
    with pytest.raises(ValueError):
        resolve.pick_word(steps, m, vocab, "best")


def test_words_of_specs_and_of_chains(spark):
    lemmas = spark.createDataFrame([("fish.n.01", "Cold_fish"), ("dog.n.01", "dog")], "synset string, lemma string")
    specs = spark.createDataFrame([("Big  Dog", "dog.n.01"), ("fish.n.01", "fish.n.01"), ("no one", None), ("x.n.09", "x.n.09")], "spec string, synset string")
    words = lambda use: {r.spec: r.words for r in resolve.spec_words(specs, lemmas, use).collect()}
    assert words("spec") == {"Big  Dog": ["big", "dog"], "fish.n.01": ["cold", "fish"], "no one": ["no", "one"], "x.n.09": []}
    assert words("lemma")["Big  Dog"] == ["dog"] and words("lemma")["no one"] == ["no", "one"]
    with pytest.raises(ValueError):
        resolve.spec_words(specs, lemmas, "id")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d")], "child string, parent string")
    own = spark.createDataFrame([("a", ["q"]), ("z", ["w"])], "id string, words array<string>")
    up = spark.createDataFrame([("b", ["x"]), ("c", ["w"]), ("d", ["w", "v"])], "node string, words array<string>")
    steps = resolve.chain_steps(own, resolve.backoff_chain(edges), up).withColumn("banned", F.lit(None).cast("string"))
    vocab, marginal = spark.createDataFrame([("w",), ("v",)], "word string"), spark.createDataFrame([("v", 9), ("w", 2)], "w string, r long")
    assert {r.id: (r.word, r.step) for r in resolve.pick_word(steps, marginal, vocab).collect()} == {"a": ("v", 2), "z": ("w", 0)}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = evaluate.binary_metrics(df).first()
    assert (r.acc, r.prec_1, r.rec_1, r.f1_1, r.f1_macro, r.sup_1) == (1.0, 0.0, 0.0, 0.0, 0.5, 0)


def test_paired_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1), (3.0, 5.0, 1), (3.0, None, 1), (4.0, float("nan"), 0)], "a double, b double, y int")
    r = evaluate.paired(df, "a", "b", "y").first()
    assert r.n == 3 and math.isclose(r.spearman, 0.5) and math.isclose(r.mean_diff, -2 / 3) and r.auc_a == 1.0 and r.auc_b == 0.5 and r.wilcoxon == 1.5
    few = evaluate.paired(df.limit(2), "a", "b", "y").first()
    assert few.n == 2 and few.spearman is None and few.auc_a is None
    assert few.t_p is None and few.wilcoxon_p is None and math.isclose(r.wilcoxon_p, evaluate.wilcoxon_p(1.5, 3, 6.0)) and math.isclose(r.t_p, evaluate.t_p(r.t, 2))


def test_p_values_equal_tables():
    for t, df, p in ((12.7062047, 1, 0.05), (2.22813885, 10, 0.05), (3.16927267, 10, 0.01), (1.98397152, 100, 0.05), (0.0, 5, 1.0)):
        assert math.isclose(evaluate.t_p(t, df), p, abs_tol=1e-8) and math.isclose(evaluate.t_p(-t, df), p, abs_tol=1e-8)
    assert evaluate.t_p(60.0, 400) < 1e-100 and evaluate.t_p(None, 3) is None
    for w, n, p in ((0, 6, 2 / 64), (8, 10, 0.048828125), (3, 8, 0.0390625), (52, 20, 0.048441), (18, 8, 1.0)):
        assert math.isclose(evaluate.wilcoxon_p(w, n), p, abs_tol=1e-6)
    for n in (5, 9):  # every set of signs
        sums = [sum(k + 1 for k in range(n) if s >> k & 1) for s in range(1 << n)]
        assert all(math.isclose(evaluate.wilcoxon_p(w, n), min(1, 2 * sum(x <= w for x in sums) / 2**n)) for w in range(n * (n + 1) // 4 + 1))
    assert math.isclose(evaluate.wilcoxon_p(10.5, 60, 120.0), math.erfc((915 - 10.5) / math.sqrt(60 * 61 * 121 / 24 - 2.5) / math.sqrt(2))) and evaluate.wilcoxon_p(0, 0) is None


def test_paired_statistics_of_common_values(spark):
    rng = np.random.default_rng(5)
    a, b, y = rng.integers(0, 4, 300).astype(float), rng.integers(0, 3, 300).astype(float), rng.integers(0, 2, 300)
    r = evaluate.paired(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist(), strict=True)), "a double, b double, y int"), "a", "b", "y").first()
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    d = (a - b)[a != b]
    w = rank(np.abs(d))
    ties = sum(k**3 - k for k in np.unique(np.abs(d), return_counts=True)[1].tolist())
    auc = lambda v: np.mean([(p > q) + (p == q) / 2 for p in v[y == 1] for q in v[y == 0]])
    assert np.allclose([r.spearman, r.wilcoxon, r.auc_a, r.auc_b], [np.corrcoef(rank(a), rank(b))[0, 1], min(w[d > 0].sum(), w[d < 0].sum()), auc(a), auc(b)])
    assert r.n_used == len(d) and math.isclose(r.wilcoxon_p, evaluate.wilcoxon_p(r.wilcoxon, len(d), ties))


def test_fuzzy_logic(spark):
    x, y = F.lit(0.5), F.lit(0.25)
    assert tuple(spark.range(1).select(f_and(x, y), f_implies(x, y)).first()) == (0.125, 0.625)
    h = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 1.0), ("b", "a", 0.0), ("b", "b", 0.0)], "x string, y string, h double")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "a", 0), ("a", "q", 1)], "x string, y string, label int")
    assert {r.label: r.sat for r in logic.data_axioms(pairs, h).collect()} == {1: 1.0, 0: 1.0}
    assert h.limit(0).agg(pmean_error(F.col("h"))).first()[0] is None


def test_reports(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, 5.0), ("v", 1, 3.0)], "k string, e long, m double")
    assert sorted(tuple(r) for r in report.last_rows(df, "k", "e").collect()) == [("u", 2, 5.0), ("v", 1, 3.0)]
    assert sorted(tuple(r) for r in report.first_present(df, "k", "m", "e").collect()) == [("u", 5.0), ("v", 3.0)]
    assert df.select(report.row_mean("e", "m")).collect()[0][0] == 1.0
    assert report.keep(df, ["m", "zzz"]).columns == ["m"]
    with pytest.raises(ValueError):
        evaluate.leaderboard(df)


def test_features(spark):
    kv = spark.createDataFrame([("a", [1.0, 2.0])], "key string, vec array<double>")
    p = spark.createDataFrame([("a", "a", 7), ("a", "b", 8)], "hypo string, hyper string, s int")
    got = features.with_scalar(features.joined_vectors(p, kv), "s").orderBy("s").collect()
    assert got[0].features == [1.0, 2.0, 1.0, 2.0, 7.0] and got[1].features is None and not got[1].hit


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("hypo,hyper\n a , b \n,c\nonly\nd,e\n")
    assert sorted(tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.csv")).collect()) == [("a", "b"), ("d", "e")]
    (tmp_path / "p.tsv").write_text("hypo\thyper\nx y\tz\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("x y", "z")]
    (tmp_path / "v.txt").write_text("2 3\na 1.0 2.0 3.0\nb 0.5 0 -1\n")
    assert {r.key: r.vec for r in files.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"a": [1.0, 2.0, 3.0], "b": [0.5, 0.0, -1.0]}
    (tmp_path / "c.txt").write_bytes("aé".encode() * 2)
    assert files.read_corpus(spark, str(tmp_path / "c.txt"), 5).first().text == "aéa"
    for k, raw in enumerate((b"a\xef\xbf\xbdb\xff", "x\ufffdé漢🙂".encode(), b"\xf0\x9fA\xe2\x82\xe2\x82\xac\xc0\x80\xed\xa0\x80z", "🙂".encode()[:3])):
        (tmp_path / f"raw{k}.bin").write_bytes(raw)
        assert files.read_corpus(spark, str(tmp_path / f"raw{k}.bin")).first().text == raw.decode(errors="ignore")
    (tmp_path / "named.csv").write_text("label,hypo,hyper,source\n1,dog,animal,x\n0, cat ,stone,y\n")
    assert {(r.hypo, r.hyper, r.label, r.source) for r in files.read_pairs(spark, str(tmp_path / "named.csv")).collect()} == {("dog", "animal", 1, "x"), ("cat", "stone", 0, "y")}
    (tmp_path / "half.csv").write_text("hypo,other\na,b\n")
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(tmp_path / "half.csv"))
    (tmp_path / "one.txt").write_text("a 1.0\nb 2.5\n")
    assert {r.key: r.vec for r in files.read_vectors(spark, str(tmp_path / "one.txt")).collect()} == {"a": [1.0], "b": [2.5]}
    kv = spark.createDataFrame([("x y", [1.0, -2.0]), ("z", [0.5, 0.25])], "key string, vec array<double>")
    files.write_vectors(kv, str(tmp_path / "kv"))
    assert {r.key: r.vec for r in files.read_vectors(spark, str(tmp_path / "kv" / "vectors")).collect()} == {"x_y": [1.0, -2.0], "z": [0.5, 0.25]}
    assert spark.read.text(str(tmp_path / "kv" / "header")).first().value == "2 2" and spark.read.json(str(tmp_path / "kv" / "vocab")).count() == 2
    x = spark.createDataFrame([("a", "b", 1)], "w1 string, w2 string, x long")
    files.write_counts(str(tmp_path / "cc"), x, spark.createDataFrame([("a", 1)], "word string, cnt long"), window="5-19")
    _, vocab, meta = files.read_counts(spark, str(tmp_path / "cc"))
    assert vocab.count() == 1 and meta == {"min_count": "5", "window": "5-19", "total": "1"}
    x.write.parquet(str(tmp_path / "bare" / "cooc"))
    with pytest.raises(ValueError):
        files.read_counts(spark, str(tmp_path / "bare"))
    assert {(r.word, r.cnt) for r in files.read_word_counts(spark, str(tmp_path / "cc")).collect()} == {("a", 1)}
    spark.createDataFrame([("a", 0), ("b", 1)], "word string, idx long").write.parquet(str(tmp_path / "wc" / "vocab"))
    assert files.read_word_counts(spark, str(tmp_path / "wc")) is None
    with pytest.raises(ValueError):
        files.read_word_counts(spark, str(tmp_path / "wc"), strict=True)
    spark.createDataFrame([(0, 7), (1, 9)], "idx long, cnt long").write.parquet(str(tmp_path / "wc" / "counts"))
    assert {(r.word, r.cnt) for r in files.read_word_counts(spark, str(tmp_path / "wc"), strict=True).collect()} == {("a", 7), ("b", 9)}
    files.write_codewords(spark.createDataFrame([("n", [1, 2])], "node string, steps array<int>"), str(tmp_path / "cw"), "entity", "log", precision=6)
    cw, settings = files.read_codewords(spark, str(tmp_path / "cw"))
    assert cw.first().steps == [1, 2] and settings == {"root": "entity", "weights": "log", "base_interval": False, "precision": 6}
    (tmp_path / "m.csv").write_text("i,j,v\na,b,0.5\n")
    (tmp_path / "m.txt").write_text("a 0 2.5\nb 1 0\n")
    assert [tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()] == [("a", "b", 0.5)]
    assert sorted(tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m.txt")).collect()) == [("a", "1", 2.5), ("b", "0", 1.0)]
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(tmp_path / "m.npy"))
    lab = spark.createDataFrame([(1, "test", "direct", 1), (1, "train", "union", 0)], "pair_id long, split string, target string, y int")
    files.write_bundle(str(tmp_path / "b"), {"m": x}, lab)
    assert files.targets(spark, str(tmp_path / "b")) == ["direct"] and files.read_matrix(spark, str(tmp_path / "b"), "m").count() == 1
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.csv").write_text("epoch,sat\n0,0.5\n")
    (tmp_path / "h" / "b.csv").write_text("epoch,loss\n1,0.2\n")
    (tmp_path / "h" / "c.csv").write_text("")
    assert files.read_histories(spark, str(tmp_path / "h" / "*.csv")).count() == 2
    whole = gzip.compress(b"epoch,sat\n" + b"1,0.5\n" * 50_000)
    (tmp_path / "h" / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    assert files.read_histories(spark, str(tmp_path / "h" / "*"), tolerant=True).filter("file not like '%cut%'").count() == 2
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        files.read_histories(spark, str(tmp_path / "h" / "*")).count()


def test_learners(spark):
    rows = [(k, [float(k % 7), float(k % 2)], k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, features array<double>, label int")
    got = models.logistic(df, df, standardise=True)
    assert got.filter("y_pred = label").count() == 60
    assert models.perceptron(df, df, 6000) is None
    assert models.elu_network(df, df, 6000) is None
    twice = models.elu_network(df, df, 2, epochs=3000).collect()
    assert sum(r.y_pred == r.label for r in twice) >= 58
    both = df.withColumn("other", 1 - df["label"])
    g = models.grid(both, both, {"f": "features"}, ["label", "other"]).collect()
    assert [(r.target, r.clf) for r in g] == [("label", "logreg"), ("label", "mlp"), ("other", "logreg"), ("other", "mlp")] and g[0].acc == 1.0


def test_network_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net = models.EluNetwork(3, seed=1)
    x, y = rng.normal(size=(8, 3)), rng.integers(0, 2, 8).astype(float)
    loss = lambda: -np.mean(y * np.log(net.forward(x)[-1]) + (1 - y) * np.log(1 - net.forward(x)[-1]))
    before = [p.copy() for layer in net.layers for p in layer]
    want = []
    for p in (p for layer in net.layers for p in layer):
        g = np.zeros_like(p)
        for k in np.ndindex(*p.shape):
            p[k] += 1e-6
            up = loss()
            p[k] -= 2e-6
            g[k] = (up - loss()) / 2e-6
            p[k] += 1e-6
        want.append(g)
    net.fit(x, y, epochs=1, batch=8, rate=1e-3)  # Adam's first step is the rate, against the gradient's sign
    for p, b, g in zip((p for layer in net.layers for p in layer), before, want, strict=True):
        big = np.abs(g) > 1e-4
        assert np.allclose((p - b)[big], -1e-3 * np.sign(g)[big], rtol=1e-2)


def test_sweep_keeps_the_errors(spark):
    pairs = spark.createDataFrame([(k, f"n{k}", "up" if k % 2 else "down", k % 2, [float(k % 2)]) for k in range(24)], "pair_id long, hypo string, hyper string, label int, extra array<double>")
    kv = spark.createDataFrame([(f"n{k}", [1.0, 0.0]) for k in range(20)] + [("up", [0.0, 1.0]), ("down", [0.0, -1.0])], "key string, vec array<double>")

    def broken():
        raise RuntimeError("no such file")

    rows = models.sweep({"good": lambda: kv, "empty": lambda: kv.limit(0), "bad": broken}, pairs.filter("pair_id % 3 > 0"), pairs.filter("pair_id % 3 = 0"), {"extra": "extra"}, mlp=False).collect()
    good = [r for r in rows if r.run_tag == "good"]
    assert {(r["matrix"], r["clf"]) for r in good} == {(m, c) for m in ("vectors", "extra") for c in ("logreg", "mlp")}
    assert all(r.vector_dim == 2 and r.kv_size == 22 and r.seconds > 0 and 0.8 < r.coverage_train < 0.9 for r in good) and [r.acc for r in good if r["clf"] == "logreg"] == [1.0, 1.0]
    assert {r.run_tag: r.error for r in rows if r.error} == {"empty": "the model has no vectors", "bad": "no such file"}


def test_explained_variance(spark):
    x = np.random.default_rng(7).normal(size=(6, 6)) * (np.random.default_rng(8).random((6, 6)) < 0.6)
    m = spark.createDataFrame([(f"n{i}", f"n{j}", float(x[i, j])) for i, j in np.ndindex(6, 6) if x[i, j]], "i string, j string, v double")
    nodes = spark.createDataFrame([(f"n{k}", k) for k in range(6)], "node string, idx long")
    u, s, _ = np.linalg.svd(x)
    for d in (2, 6):
        got = models.explained_variance(m, models.svd(m, nodes, d)[0]).first().explained
        assert np.isclose(got, (u[:, :d] * s[:d]).var(0).sum() / x.var(0).sum())
    assert models.explained_variance(m.limit(0), models.svd(m, nodes, 2)[0]).first().explained is None


def test_bundles_go_to_learners_as_sparse_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    entries = lambda ids, far: [(k, c, 1.0) for k in ids for c in ({k % 2 * 3} if far is None else {k % 2 * 3, int(rng.integers(10, far))})]
    frame = lambda rows: spark.createDataFrame(rows, "pair_id long, col long, v double")
    matrices = {"narrow_train": frame(entries(range(60), None)), "narrow_test": frame(entries(range(100, 130), None)), "wide_train": frame(entries(range(60), 90_000)), "wide_test": frame([*entries(range(100, 129), 90_000), (999, 5, 1.0), (100, 99_999, 2.0)]), "lone_train": frame([(1, 1, 1.0)])}
    labels = [(k, "train", "label", k % 2) for k in range(60)] + [(k, "test", t, y) for k in range(100, 130) for t, y in (("direct", k % 2), ("union", 1))]
    files.write_bundle(str(tmp_path / "b"), matrices, spark.createDataFrame(labels, "pair_id long, split string, target string, y int"))
    got = {(r["matrix"], r["target"], r["clf"]): r for r in models.evaluate_bundle(spark, str(tmp_path / "b")).collect()}
    assert set(got) == {(m, t, c) for m in ("narrow", "wide") for t in ("direct", "union") for c in ("logreg", "mlp")}
    assert got["narrow", "direct", "logreg"].acc == got["narrow", "direct", "mlp"].acc == 1.0 and got["narrow", "union", "logreg"].acc == 0.5
    assert got["wide", "direct", "logreg"].acc > 0.9 and got["wide", "direct", "logreg"].width == 100_000 and got["wide", "union", "mlp"].acc is None and "wide" in got["wide", "union", "mlp"].note
    ids = spark.createDataFrame([(100,), (129,)], "pair_id long")
    rows = {r.pair_id: r.features for r in models.sparse_rows(matrices["wide_test"].union(frame([(100, 99_999, 0.5)])), ids, 100_000).collect()}
    assert set(rows) == {100, 129} and rows[100][99_999] == 2.5 and rows[129].size == 100_000 and rows[129].numNonzeros() == 0
    own = frame(entries(range(60), None))
    dense = spark.createDataFrame([(k, [1.0 - k % 2, 0.0, 0.0, float(k % 2)], k % 2) for k in range(60)], "pair_id long, features array<double>, y int")
    sparse = models.sparse_rows(own, dense.select("pair_id"), 4).join(dense.select("pair_id", "y"), "pair_id")
    probs = lambda df: [r.prob for r in models.logistic(df, df, "features", "y").orderBy("pair_id").collect()]
    assert np.allclose(probs(sparse), probs(dense), atol=1e-6)


def test_truth_and_breakdown(spark):
    e = spark.createDataFrame([(k, [float(k)]) for k in range(9)], "key long, vec array<double>")
    score = lambda u, v: (u[0] < v[0]).cast("double")
    below = lambda u, v: (u < v.T).astype(float)
    assert sorted(map(tuple, logic.block_truth(e, below, 2).collect())) == sorted(map(tuple, logic.truth(e, score).collect()))
    pairs = spark.createDataFrame([(1, 2, 1, "a"), (3, 2, 0, "b"), (1, 99, 1, "b")], "x long, y long, label int, split string")
    h = logic.pair_truth(pairs, e, score)
    assert {(r.x, r.y): r.h for r in h.collect()} == {(1, 2): 1.0, (3, 2): 0.0}
    order = logic.structural_sums(e, below, 2)
    assert order.first()[:3] == (1.0, 1.0, 1.0)
    rows = logic.breakdown(pairs, h, order, ["split"]).collect()
    assert {(r.split, r.axiom) for r in rows} == {(s, a) for s in "ab" for a in ("transitivity", "irreflexivity", "asymmetry", "closure", "overall")} | {("a", "positive"), ("b", "negative")}
    assert tuple(logic.structural_sums(e.limit(0), below).first()) == (None,) * 4


@pytest.mark.parametrize("size", [3, 100])
def test_axioms_over_all_entities_equal_all_cases(spark, size):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(11, 3))
    score = lambda a, b: 1 / (1 + np.exp(-(a @ (b * [1.0, 2.0, -1.0]).T + a[:, :1])))
    got = logic.structural_sums(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "key long, vec array<double>"), score, size).first()
    h = score(v, v)
    rms = lambda e: 1 - np.sqrt((np.array(e) ** 2).mean())
    n = range(11)
    three = [h[x, y] * h[y, z] * (1 - h[x, z]) for x in n for y in n for z in n]
    some = [[1 - np.sqrt(np.mean([(1 - h[x, u] * h[u, z] * h[z, y]) ** 2 for u in n for z in n])) for y in n] for x in n]
    want = rms(three), rms(np.diag(h)), rms(h * h.T), rms(h * (1 - np.array(some)))
    assert np.allclose(got, want, atol=1e-12)


def test_axioms_take_what_they_need_and_equal_vectors_once(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(7, 2))[[0, 1, 2, 3, 4, 5, 6, 1, 1, 4]]
    met = []

    def score(a, b):
        met.append(len(a) * len(b))
        return 1 / (1 + np.exp(-(a @ (b * [1.0, 2.0]).T + a[:, :1])))

    e = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "key long, vec array<double>")
    h = score(v, v)
    rms = lambda e: 1 - np.sqrt((np.array(e) ** 2).mean())
    three = [h[x, y] * h[y, z] * (1 - h[x, z]) for x in range(10) for y in range(10) for z in range(10)]
    assert np.allclose(logic.structural_sums(e, score, 3, ("asymmetry", "irreflexivity")).first(), (rms(h * h.T), rms(np.diag(h))), atol=1e-12)
    assert np.allclose(logic.structural_sums(e, score, 3, ("transitivity",)).first(), (rms(three),), atol=1e-12)
    met.clear()
    assert np.allclose(logic.pair_sums(v, np.ones(10), v, np.ones(10), True, score)[1], ((h * h.T) ** 2).sum())
    assert met == [100]  # asymmetry meets each pair once, not once for each third entity


def test_pairs_of_blocks_are_not_sent(spark):
    e = spark.createDataFrame([(k, [float(k)] * 8) for k in range(40)], "key long, vec array<double>")
    got = logic.block_truth(e, lambda u, v: u @ v.T, 4)
    assert {r.h for r in got.collect()} == {8.0 * a * b for a in range(40) for b in range(40)} and got.count() == 1600
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan.split("Cartesian" if "Cartesian" in plan else "BroadcastNestedLoopJoin")[0].split("MapInPandas")[1]


def test_stream_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        spark.createDataFrame([(k, " ".join(["aa", "bb", "cc"] * 10))], "doc_id long, text string").coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = counts.to_table(counts.word_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    now = counts.latest(spark.read.parquet(str(tmp_path / "out")), "word")
    assert {r.word: r.cnt for r in now.collect()} == {"aa": 20, "bb": 20, "cc": 20}
    assert os.path.isdir(tmp_path / "out")


def test_least_squares_and_grids(spark):
    rows = [(float(k), "ab"[k % 2], 2.0 + 3.0 * k + (5.0 if k % 2 == 0 else 0.0) + (0.001 if k % 3 else -0.002)) for k in range(40)]
    got = {r.term: r.coef for r in models.ols(spark.createDataFrame(rows, "x double, g string, y double"), "y ~ x + g").collect()}
    assert math.isclose(got["x"], 3.0, abs_tol=0.01) and math.isclose(abs(got[next(t for t in got if t.startswith("g_"))]), 5.0, abs_tol=0.05) and "intercept" in got
    a = spark.createDataFrame([("cw", "mlp", 0.5)], "matrix string, clf string, f1_macro double")
    b = spark.createDataFrame([("cw+katz", "mlp", 0.75), ("zz+katz", "mlp", 0.1)], "matrix string, clf string, f1_macro double")
    assert [tuple(r) for r in models.compare_grids(a, b).collect()] == [("cw", "mlp", 0.5, 0.75, 0.25)]


def test_least_squares_with_aliased_terms(spark):
    rows = [(float(k % 7), "abc"[k % 3], 3.0 * (k % 7) + 5.0 * (k % 3) + (k % 3) * (k % 7) + 0.1 * (k % 5)) for k in range(600)]
    got = models.ols(spark.createDataFrame(rows, "x double, g string, y double"), "y ~ x + g + x:g").collect()
    known = [r for r in got if r.coef is not None]
    assert len(got) == 7 and len(known) == 6 and all(r.se > 0 and r.p is not None for r in known)  # the interactions add up to x
    v = np.array([[x, g == "a", g == "b", x * (g == "a"), x * (g == "b"), 1.0] for x, g, _ in rows], float)
    y = np.array([r[2] for r in rows])
    c = np.linalg.lstsq(v, y, rcond=None)[0]
    left = y - v @ c
    se = np.sqrt(left @ left / (len(y) - 6) * np.diag(np.linalg.inv(v.T @ v)))
    at = lambda name: next(r for r in got if r.term == name)
    assert math.isclose(at("intercept").coef + at("x").coef + sum(r.coef or 0 for r in got if r.term in ("g_a", "x:g_a")), c[-1] + c[0] + c[1] + c[3], rel_tol=1e-8)
    assert any(math.isclose(r.se, s, rel_tol=1e-6) for r in known for s in se)


def test_vector_lines_round_as_printf(spark):
    from entaila.sources.files import vector_lines

    kv = spark.createDataFrame([("a b", [1 / 128, 3 / 128, -1 / 128, 0.5]), ("none", [])], "key string, vec array<double>")
    assert sorted(r.value for r in vector_lines(kv).collect()) == ["a_b 0.007812 0.023438 -0.007812 0.500000", "none "]


def test_vectors_are_met_after_keys_are_chosen(spark):
    from entaila.operators import resolve

    kv = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, vec array<double>")
    nodes = spark.createDataFrame([("n1", "a_b"), ("n2", "x"), ("n3", "y"), ("top", "b")], "node string, lemma string")
    chain = spark.createDataFrame([("n2", 1, "n3"), ("n2", 2, "top"), ("n1", 1, "top")], "node string, step long, anc string")
    got = resolve.node_vectors(nodes, chain, kv)
    assert {r.node: (r.method, r.key, r.vec) for r in got.collect()} == {
        "n1": ("synset_lemma", "a", [1.0]), "n2": ("synset_hypernym_backoff", "b", [2.0]), "n3": ("oov", None, None), "top": ("synset_lemma", "b", [2.0]),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("vec" in line for line in plan.splitlines() if "Aggregate" in line)  # no aggregate holds vectors


def test_paired_grids_and_metrics_of_stored_scores(spark):
    import duckdb

    rows = [(k, int(k % 3 == 0), [float(k % 3 == 0) + 0.01 * (k % 7), float(k % 5)], [float(k % 2)], [float(k % 2), float(k % 3 == 0)], None) for k in range(240)]
    both = spark.createDataFrame(rows, "pair_id long, label int, good array<double>, poor array<double>, poorer array<double>, none array<double>")
    train, test = both.filter("pair_id < 160"), both.filter("pair_id >= 160")
    a = models.score_sets(train, test, {"good": "good", "poor": "poor", "none": "none"})
    b = models.score_sets(train, test, {"poor+katz": "poorer", "other+katz": "good"}, mlp=False)
    assert {(r.matrix, r.clf): r["count"] for r in a.groupBy("matrix", "clf").count().collect()} == {(m, c): 80 for m in ("good", "poor") for c in ("logreg", "mlp")}
    scored = a.toPandas()  # noqa: F841  read by the SQL
    want = {(m, c): x for m, c, x in duckdb.sql("SELECT matrix, clf, avg((y = y_pred)::INT) FROM scored GROUP BY 1, 2").fetchall()}
    assert {(m.matrix, m.clf): m.acc for m in evaluate.binary_metrics(a, "y", "y_pred", ["matrix", "clf"]).collect()} == want
    assert want["good", "logreg"] == 1.0 > want["poor", "logreg"]
    (r,) = models.paired_grids(a, b).collect()
    assert (r.matrix, r.clf, r.n) == ("poor", "logreg", 80) and r.acc_a == want["poor", "logreg"] and r.acc_b == 1.0 and r.auc_b == 1.0 > r.auc_a
    diff = [x - y for x, y in zip(*[[s.prob for s in t.filter("matrix like 'poor%' and clf = 'logreg'").orderBy("pair_id").collect()] for t in (a, b)], strict=True)]
    assert math.isclose(r.mean_diff, sum(diff) / 80, abs_tol=1e-12)
    with pytest.raises(ValueError):
        models.paired_grids(a, b.filter("matrix = 'other+katz'"))
    with pytest.raises(ValueError):
        models.score_sets(train, test, {"none": "none"})


def test_finding_and_writing(spark, tmp_path):
    (tmp_path / "r" / "deep").mkdir(parents=True)
    for name in ("r/b.model", "r/deep/a.model", "r/c.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.find_files(spark, str(tmp_path / "r")).collect()] == ["b.model", "a.model"]
    files.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["a", "b"]
    assert files.dump_name("enwik8") == "enwik8"
    with pytest.raises(ValueError):
        files.dump_name("other")
    v = spark.range(2).select(resolve.pseudo_vector(F.lit("k"), 4).alias("v")).collect()
    assert v[0].v == v[1].v and len(v[0].v) == 4 and len(set(v[0].v)) == 4


def test_byte_prefix_takes_every_page(spark, tmp_path):
    import hashlib

    from entaila import catalogue

    pages = ["a" * 400, "é" * 200, "a" + "é" * 200, "ab" + "語" * 150, "abc" + "😀" * 99, "short é", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r["head"] for r in catalogue.QUERIES["byte_prefix_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.md5(t.encode()[:300].decode(errors="ignore").encode()).hexdigest() for k, t in enumerate(pages)}


def test_datasets_of_train_and_test(spark, tmp_path):
    from entaila.operators import hierarchy

    path = hierarchy.paths(spark.createDataFrame([("a", "entity", "hyper"), ("b", "a", "hyper")], "child string, parent string, kind string"))
    x = spark.createDataFrame([("u", "v", 4), ("v", "u", 4)], "w1 string, w2 string, x long")
    vocab = spark.createDataFrame([("u", 9, 0), ("v", 8, 1)], "word string, cnt long, idx long")
    pairs = lambda rows: spark.createDataFrame(rows, "pair_id long, hypo string, hyper string, hypo_syn string, hyper_syn string")
    given = lambda k, rows: {"pairs": pairs(rows), "picked": spark.createDataFrame([(k, "u", "v")], "pair_id long, w1 string, w2 string"), "probs": spark.createDataFrame([(k, 4, 0.5, 1.0)], "pair_id long, freq long, joint double, cond double")}
    matrices, labels = features.build_datasets(given(1, [(1, "b", "a", "b", "a"), (2, "a", "entity", "a", "entity")]), given(3, [(3, "b", "entity", "b", "entity"), (4, "b", "none", None, None)]), path, x, vocab, 10)
    assert set(matrices) == {f"{m}_{s}" for m in ("interval", "interval_prob", "cooc", "rawfreq") for s in ("train", "test")}
    assert {r.pair_id for r in matrices["interval_test"].collect()} == {3} and sorted((r.col, r.v) for r in matrices["rawfreq_train"].collect()) == [(1, 4.0), (2, 4.0)]
    got = {(r.pair_id, r.split, r.target): r.y for r in labels.collect()}
    assert got == {(1, "train", "label"): 1, (2, "train", "label"): 1} | {(3, "test", t): int(t in ("rowpath", "union")) for t in ("direct", "rowpath", "colpath", "union")} | {(4, "test", t): 0 for t in ("direct", "rowpath", "colpath", "union")}
    files.write_bundle(str(tmp_path / "bundle"), matrices, labels)
    assert files.targets(spark, str(tmp_path / "bundle")) == ["colpath", "direct", "rowpath", "union"] and files.read_matrix(spark, str(tmp_path / "bundle"), "cooc_test").count() == 3


def test_rows_that_are_alike_are_decomposed_as_one(spark, monkeypatch):
    """US and the values are those of the whole matrix, with contrasts among the d largest too; the driver's matrix has a row a kind."""
    x = np.zeros((23, 26))
    for k in range(20):  # two kinds of leaves, with a column each and a shared one
        x[k, k], x[k, 20 + k % 2] = (0.9, 0.3) if k % 2 else (0.4, 0.7)
    x[20, 20:24], x[21, [20, 22, 25]] = [1, 2, 3, 4], [1, 1, 2]  # the last row is empty
    m = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(x[i, j])) for i, j in np.ndindex(*x.shape) if x[i, j]], "i string, j string, v double")
    nodes = spark.createDataFrame([(f"n{k:02d}", k) for k in range(26)], "node string, idx long")
    sizes, make = [], models.CoordinateMatrix
    monkeypatch.setattr(models, "CoordinateMatrix", lambda model: sizes.append(make(model)) or sizes[-1])
    want = np.linalg.svd(x)[1]
    for d in (2, 6, 15):
        vec, s = models.svd(m, nodes, d)
        us = np.array([r.vec for r in vec.orderBy("node").collect()])[:23]
        assert len(s) == d and np.allclose(s, want[:d])
        assert np.allclose(us.T @ us, np.diag(want[:d] ** 2)) and np.allclose(us.T @ x @ x.T @ us, np.diag(want[:d] ** 4))
    assert {a.numRows() for a in sizes} == {4}


def test_grids_compute_their_tables_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(k):
        met.add(1)
        return float(k % 5)

    df = spark.range(40).select(F.col("id").alias("pair_id"), F.array(seen("id"), F.col("id") * 0.5).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    got = models.grid(df.filter("pair_id < 30"), df.filter("pair_id >= 30"), {"all": "x"}, mlp=False).collect()
    assert {(r.matrix, r.clf, r.note) for r in got} == {("all", "logreg", ""), ("all", "mlp", "no rows, input too wide or not asked for")}
    assert met.value == 40


def test_the_unknown_vector_is_the_mean_over_all_keys(spark):
    n = 50_003  # the last keys in order alone have a value
    kv = spark.range(n).select(F.format_string("k%05d", "id").alias("key"), F.array(F.when(F.col("id") >= 50_000, 1.0).otherwise(0.0)).alias("vec"))
    assert np.isclose(resolve.unknown_vector(kv).first().vec[0], 3 / n)


def test_the_network_learns_from_all_rows(spark):
    kinds = 12  # each of 2,000 rows that are alike
    rows = spark.range(kinds * 2000).select((F.col("id") % kinds).alias("k")).select("k", F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda i: (i == F.col("k")).cast("double")).alias("features"), F.col("k").isin(0, 3, 4, 6, 9, 11).cast("int").alias("label"))
    got = models.elu_network(rows, rows.distinct(), kinds, epochs=6).collect()
    assert len(got) == kinds and all(abs(r.prob - r.label) < 0.2 for r in got)


def test_parts_hold_every_row_once(spark):
    rows = [(float(k % 5), k, int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, k long, label int").select(F.array("a", F.col("k") % 7).alias("features"), "label")
    parts, n = models.row_parts(df, 2, part_rows=50)
    held = [(tuple(x), y) for r in parts.collect() for x, y in zip(np.frombuffer(r.x).reshape(-1, 2), np.frombuffer(r.y), strict=True)]
    assert n == 6 and sorted(held) == sorted((tuple(map(float, r.features)), float(r.label)) for r in df.collect())
    # one epoch is the mean of the parts' own by their rows
    net, want, total = models.EluNetwork(2), 0, 0
    for r in parts.collect():
        x, y = np.frombuffer(r.x).reshape(-1, 2), np.frombuffer(r.y)
        want, total = want + len(y) * models.EluNetwork(2).fit(x, y, 1, seed=[0, 0, r.part]).state(), total + len(y)
    assert np.allclose(models.fit_parts(parts, n, net, 1).state(), want / total)
