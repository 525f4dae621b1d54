import random

import math

import pytest
from pyspark.sql import functions as F

from entaila.functions.columns import interval_overlap
from entaila.operators import graph, hierarchy, vectorize


@pytest.fixture(scope="module")
def diamond(spark):
    """entity -> a, b; a, b -> c; b -> i (instance)."""
    return spark.createDataFrame([("a", "entity", "hyper"), ("b", "entity", "hyper"), ("c", "a", "hyper"), ("c", "b", "hyper"), ("i", "b", "instance")], "child string, parent string, kind string")


@pytest.fixture(scope="module")
def path(diamond):
    return hierarchy.paths(diamond).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_intervals_of_a_diamond(path):
    got = {(r.node, "/".join(r.path)): (r.lo, r.hi) for r in path.collect()}
    assert got[("c", "entity/a/c")] == (0.0, 0.5) and got[("c", "entity/b/c")] == (0.5, 1.0)
    assert got[("i", "entity/b/i")] == got[("b", "entity/b")] == (0.5, 1.0)  # an instance step keeps the interval


def test_canonical_through_and_depths(spark, path):
    c = {r.node: r.path for r in hierarchy.canonical(path).collect()}
    assert c["c"] == ["entity", "a", "c"]
    want = spark.createDataFrame([("c", "b"), ("c", "i")], "node string, anc string")
    assert [(r.anc, r.lo) for r in hierarchy.through(path, want).collect()] == [("b", 0.5)]
    assert {r.node: r.max_depth for r in hierarchy.depths(path).collect()} == {"entity": 0, "a": 1, "b": 1, "c": 2, "i": 2}


def test_weighted_children_fill_the_parent(spark, diamond):
    w = spark.createDataFrame([("a", 3)], "node string, f long")
    got = {r.node: (r.lo, r.hi) for r in hierarchy.paths(diamond, w).filter("depth = 1").collect()}
    assert got == {"a": (0.0, 0.75), "b": (0.75, 1.0)}


def test_wu_palmer(spark, path):
    p = spark.createDataFrame([(1, "c", "i"), (2, "a", "b"), (3, "c", "c"), (4, "c", "nowhere")], "pair_id long, a string, b string")
    got = {r.pair_id: (r.lca, r.wup) for r in hierarchy.wu_palmer(p, path).collect()}
    assert got == {1: ("b", 0.5), 2: ("entity", 0.0), 3: ("c", 1.0), 4: (None, 0.0)}


def test_sibling_overlaps_and_touch(spark):
    k = spark.createDataFrame([("p", "x", 0.0, 0.5), ("p", "y", 0.5, 1.0), ("p", "z", 0.4, 0.6), ("q", "w", 0.0, 1.0)], "parent string, child string, lo double, hi double")
    assert [r[1:] for r in rows(hierarchy.overlapping_siblings(k))] == [("x", "z"), ("y", "z")]
    assert [r[1:] for r in rows(hierarchy.overlapping_siblings(k, allow_touch=False))] == [("x", "y"), ("x", "z"), ("y", "z")]


def test_vectors(spark):
    iv = spark.createDataFrame([("p", 0.25, 0.25), ("w", 0.125, 0.375)], "node string, lo double, hi double")
    assert rows(vectorize.midpoint(iv, n_bins=10)) == [("p", 2, 1.0), ("w", 2, 0.25)]
    sp = {(r.node, r.bin): round(r.mass, 9) for r in vectorize.spread(iv, n_bins=10).collect()}
    assert sp == {("w", 1): 0.075, ("w", 2): 0.1, ("w", 3): 0.075}
    assert vectorize.multiscale(iv).groupBy("node").count().first()[1] == 5
    d = vectorize.dense(vectorize.midpoint(iv, n_bins=10), "node", 10).filter("node = 'p'").first()
    assert d.features == [0.0, 0.0, 1.0] + [0.0] * 7
    for bad in (lambda: vectorize.multiscale(iv, n_bins=10), lambda: vectorize.multiscale(iv, mass="x"), lambda: hierarchy.root_type("zzz")):
        with pytest.raises(ValueError):
            bad()
    one = spark.range(1).select(interval_overlap(F.lit(0.0), F.lit(0.5), F.lit(0.25), F.lit(0.75)).alias("a"), interval_overlap(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert tuple(one) == (0.5, 0.0)


def test_closure_ends_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.src, r.dst): r.d for r in graph.closure(e).collect()}
    assert got[("a", "a")] == 3 and got[("a", "d")] == 3 and len(got) == 12
    assert graph.closure(e, max_depth=1).count() == 4
    assert graph.closure(e.limit(0)).count() == 0


def test_labels(spark):
    e = spark.createDataFrame([("x", "p"), ("y", "q"), ("q", "p")], "src string, dst string")
    p = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "x", "y"), (4, "x", "z")], "pair_id long, hypo string, hyper string")
    got = {r.pair_id: (r.direct, r.rowpath, r.colpath, r["union"]) for r in graph.train_labels(p, e).collect()}
    assert got == {1: (1, 1, 1, 1), 2: (0, 1, 0, 1), 3: (0, 0, 1, 1), 4: (0, 0, 0, 0)}


def test_katz_counts_repeated_edges_and_completes(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    k = {(r.i, r.j): r.v for r in graph.katz(graph.matrix(e), 0.1, 5).collect()}
    assert math.isclose(k[("a", "c")], 2 * 0.01) and math.isclose(k[("a", "d")], 2 * 0.001) and len(k) == 6
    full = graph.katz_complete(graph.matrix(e, True), rounds=2)
    assert {(r.i, r.j) for r in full.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}
    assert graph.katz_complete(graph.matrix(e, True), top=1).count() == 5
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    s = {(r.i, r.j): r.v for r in graph.katz_series(graph.matrix(e, True), nodes, 0.5).collect()}
    assert s[("a", "a")] == 1.0 and math.isclose(s[("a", "d")], 0.125)


def test_row_tools(spark):
    m = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 4.0), ("a", "z", 4.0), ("b", "x", 0.0)], "i string, j string, v double")
    assert rows(graph.row_top(m, 2)) == [("a", "y", 4.0), ("a", "z", 4.0), ("b", "x", 0.0)]
    assert math.isclose(sum(r.v**2 for r in graph.l2_rows(m).collect() if r.i == "a"), 1.0)
    assert rows(graph.transposed(m).limit(0)) == [] and graph.mapped(m, lambda v: v * 2).count() == 3


def test_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    got = {r.node: r.path for r in graph.shortest_paths(spark.createDataFrame([("a",)], "start string"), e).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}


def test_overlap_with_a_missing_interval_is_null(spark):
    from entaila.functions.columns import interval_overlap

    df = spark.createDataFrame([(0.0, 1.0, None, None), (0.0, 1.0, 0.5, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(interval_overlap(*map(F.col, "abcd"))).collect()] == [None, 2 * 0.5 / 1.5]


def test_closures_without_and_with_a_bound(spark):
    chain = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(12)], "src string, dst string")
    assert graph.closure(chain).filter("src = 'n000'").count() == 12 and graph.closure(chain, 5).filter("src = 'n000'").count() == 5
    start = spark.createDataFrame([("n000",)], "start string")
    assert graph.shortest_paths(start, chain).count() == 13 and graph.shortest_paths(start, chain, 5).count() == 6
    loop = spark.createDataFrame([("a", "entity", "hyper"), ("b", "a", "hyper"), ("a", "b", "hyper")], "child string, parent string, kind string")
    assert {tuple(r.path) for r in hierarchy.paths(loop).collect()} == {("entity",), ("entity", "a"), ("entity", "a", "b")}


def random_dag(spark, seed):
    r = random.Random(seed)
    names = ["entity", *(f"n{k}" for k in r.sample(range(20), 9))]
    rows = [(c, p, r.choice(("hyper", "hyper", "instance"))) for k, c in enumerate(names) for p in r.sample(names[:k], min(k, r.choice((1, 2, 3))))]
    return spark.createDataFrame(rows, "child string, parent string, kind string"), names


@pytest.mark.parametrize("seed", range(3))
def test_programme_by_level_equals_all_paths(spark, seed):
    edges, names = random_dag(spark, seed)
    listed, dag = hierarchy.paths(edges).cache(), hierarchy.dag(edges)
    flat = lambda df, *keys: {tuple(r[k] for k in keys): (tuple(r.path), r.depth, round(r.lo, 12), round(r.hi, 12), [tuple(s) for s in r.steps]) for r in df.collect()}
    assert flat(hierarchy.canonical(dag), "node") == flat(hierarchy.canonical(listed), "node")
    wanted = spark.createDataFrame([(a, b) for a in names for b in [*names, "none"]], "node string, anc string")
    assert flat(hierarchy.through(dag, wanted), "node", "anc") == flat(hierarchy.through(listed, wanted), "node", "anc")
    same = lambda f: sorted(map(tuple, f(dag).collect())) == sorted(map(tuple, f(listed).collect()))
    assert same(hierarchy.depths) and same(hierarchy.ancestors)


def test_diamonds_are_not_listed(spark):
    rows = []
    for k in range(14):  # 2^14 paths
        top = "entity" if k == 0 else f"t{k:02}"
        rows += [(f"{s}{k:02}", top, "hyper") for s in "ab"] + [(f"t{k + 1:02}", f"{s}{k:02}", "hyper") for s in "ab"]
    dag = hierarchy.dag(spark.createDataFrame(rows, "child string, parent string, kind string"))
    assert dag.best.count() == 1 + 14 * 3
    want = spark.createDataFrame([("t14", "b05")], "node string, anc string")
    got = hierarchy.through(dag, want).first()
    assert got.depth == 28 and got.path[11] == "b05" and [x[0] for x in got.path[1::2]] == ["b" if k == 5 else "a" for k in range(14)]


def test_closure_takes_few_rounds(spark, monkeypatch):
    rounds, inner = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or inner(df))
    chain = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(100)] + [("100", "000")], "src string, dst string")  # a cycle of 101
    got = {(r.src, r.dst): r.d for r in graph.closure(chain).collect()}
    assert got == {(f"{a:03}", f"{b:03}"): (b - a) % 101 or 101 for a in range(101) for b in range(101)} and len(rounds) <= 9
    assert {r.d for r in graph.closure(chain, 5).collect()} == {1, 2, 3, 4, 5}


def test_products_meet_hubs_in_slices(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 100)
    star = [(f"a{k}", "hub", float(k % 3)) for k in range(1000)] + [("hub", f"z{k}", 1.0) for k in range(5)] + [("a1", "b", 2.0), ("b", "z1", 3.0)]
    m = spark.createDataFrame(star, "i string, j string, v double")
    x, y = graph.sliced(m, m)
    assert max(r["count"] for r in x.groupBy("j", "s").count().collect()) < 200 and y.filter("i = 'hub'").count() == 50
    got = {(r.i, r.j): r.v for r in graph.times(m, m).collect()}
    want = {(f"a{k}", f"z{z}"): float(k % 3) for k in range(1000) for z in range(5)}
    want["a1", "z1"] += 6.0
    assert got == want


def test_pairs_meet_senses_of_each_kind_once(spark):
    """A name's many leaves under the same parents come in as one; those with something below, or named on both sides, stay."""
    from entaila.operators import resolve

    up = spark.createDataFrame([*((f"p{k}", f"t{k % 2}", 1) for k in range(40)), ("q", "p0", 1), ("q", "t0", 2)], "src string, dst string, d long")
    side = spark.createDataFrame([("x", f"p{k}", (0, 40 - k)) for k in range(40)] + [("y", "p7", (0, 1))], "spec string, synset string, o struct<sub:int,rank:long>")
    other = spark.createDataFrame([("z", "p5")], "spec string, synset string")
    lemmas = spark.createDataFrame([("p9", "nine")], "synset string, lemma string")
    got = {(r.spec, r.synset) for r in resolve.first_alike(side, other, lemmas, up).collect()}
    assert got == {("x", "p39"), ("x", "p38"), ("x", "p0"), ("x", "p5"), ("x", "p9"), ("y", "p7")}


def test_senses_are_cut_before_specs_meet_them(spark):
    """A hundred specs that share a word with 2,000 senses: the words' senses are not multiplied before the cut."""
    from entaila.operators import resolve

    senses = spark.createDataFrame([("red", "n", f"s{k:04d}", 2000 - k) for k in range(2000)] + [(f"red_x{k}", "n", f"own{k}", k) for k in range(100)], "lemma string, pos string, synset string, rank long")
    specs = spark.createDataFrame([(f"red x{k}",) for k in range(100)], "spec string")
    got = resolve.first_senses(specs, senses)
    assert got.groupBy("spec").count().select("count").distinct().collect() == [(5,)]
    assert {(r.synset, r.ord) for r in got.filter("spec = 'red x7'").collect()} == {("own7", 1), *((f"s{1999 - k}", k + 2) for k in range(4))}
    best = resolve.candidates(specs, senses)
    assert {(r.spec, r.synset, r.ord) for r in best.collect()} == {(f"red x{k}", f"own{k}", 1) for k in range(100)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(best).count("LeftSemi") == 2 and plan(got).count("Window [") == 2  # the stage and the first five are settled below the joins
