"""Feature rows of term pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import interval_overlap, interval_width
from ..functions.storage import cut
from . import graph, hierarchy, vectorize


def interval_features(pairs: DataFrame, path: DataFrame, children: DataFrame | None = None, k: int = 0, n_bins: int = 333, mode: str = "through", sp: DataFrame | None = None) -> DataFrame:
    """(pair_id, half, bin, v) of pairs (pair_id, hypo_syn, hyper_syn).

    Half `hyper`: the canonical interval, with those of the first k children;
    half `hypo`: the interval through the hypernym; or (`path`) the canonical
    intervals of all nodes on the shortest way up to it, from sp (start, node,
    path); or (`sum`) those of all paths from the root.
    Unresolved pairs have no rows, which stands for zeros.  path: a hierarchy's `Dag`,
    or its paths, which (`sum`) needs.
    """
    canon = hierarchy.canonical(path).select("node", "lo", "hi")
    ok = pairs.filter("hypo_syn is not null and hyper_syn is not null")
    hyper = ok.join(canon, F.col("hyper_syn") == F.col("node")).select("pair_id", "lo", "hi")
    if k and children is not None:
        kids = children.filter(F.col("idx") < k).select(F.col("parent").alias("hyper_syn"), "child")
        hyper = hyper.unionByName(ok.join(kids, "hyper_syn").join(canon, F.col("child") == F.col("node")).select("pair_id", "lo", "hi"))
    if mode == "through":
        want = ok.select(F.col("hypo_syn").alias("node"), F.col("hyper_syn").alias("anc")).distinct()
        found = hierarchy.through(path, want).select(F.col("node").alias("hypo_syn"), F.col("anc").alias("hyper_syn"), "lo", "hi")
        hypo = ok.join(found, ["hypo_syn", "hyper_syn"]).select("pair_id", "lo", "hi")
    elif mode == "path" and sp is not None:
        way = sp.select(F.col("start").alias("hypo_syn"), F.col("node").alias("hyper_syn"), "path")
        hypo = ok.join(way, ["hypo_syn", "hyper_syn"]).select("pair_id", F.explode("path").alias("node")).join(canon, "node").select("pair_id", "lo", "hi")
    elif mode == "sum":
        hypo = ok.join(path.select(F.col("node").alias("hypo_syn"), "lo", "hi"), "hypo_syn").select("pair_id", "lo", "hi")
    else:
        raise ValueError("mode must be through, path (with sp) or sum")
    half = lambda df, name: vectorize.summed(vectorize.midpoint(df, "pair_id", n_bins), "pair_id").select("pair_id", F.lit(name).alias("half"), "bin", F.col("mass").alias("v"))
    return half(hyper, "hyper").unionByName(half(hypo, "hypo"))


def weighted(features: DataFrame, probs: DataFrame) -> DataFrame:
    """The hyper half times cond, the hypo half times joint; missing probabilities are 0."""
    j = features.join(probs.select("pair_id", "joint", "cond"), "pair_id", "left")
    by = F.when(F.col("half") == "hyper", F.col("cond")).otherwise(F.col("joint"))
    return j.select("pair_id", "half", "bin", (F.col("v") * F.coalesce(by, F.lit(0.0))).alias("v")).filter("v <> 0")


def raw_rows(picked: DataFrame, x: DataFrame, vocab: DataFrame) -> DataFrame:
    """(pair_id, col, v): the count row of w1, and that of w2 shifted by the vocabulary's size."""
    size = vocab.agg(F.count(F.lit(1)).alias("size"))  # one row
    picked = cut(picked)
    asked = cut(picked.select(F.col("w1")).union(picked.select("w2")).filter("w1 is not null").distinct())  # stored, so that few words are sent to the counts
    at = x.join(asked, "w1", "left_semi").join(vocab.select(F.col("word").alias("w2"), "idx"), "w2").select(F.col("w1").alias("w"), "idx", F.col("x").alias("v"))
    a = picked.select("pair_id", F.col("w1").alias("w")).join(at, "w").select("pair_id", F.col("idx").alias("col"), "v")
    b = picked.select("pair_id", F.col("w2").alias("w")).join(at, "w").crossJoin(F.broadcast(size)).select("pair_id", (F.col("idx") + F.col("size")).alias("col"), "v")
    return a.unionByName(b)


def missing(picked: DataFrame, limit: int = 20) -> DataFrame:
    """The first pairs with a side that has no word."""
    return picked.filter("w1 is null or w2 is null").orderBy("pair_id").limit(limit)


def joined_vectors(pairs: DataFrame, kv: DataFrame, a: str = "hypo", b: str = "hyper") -> DataFrame:
    """`pairs` with hit and features: both sides' arrays in one; null without both."""
    v = lambda side: kv.select(F.col("key").alias(side), F.col("vec").alias(f"_{side}"))
    j = pairs.join(v(a), a, "left").join(v(b), b, "left")
    hit = F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull()
    return j.select(*pairs.columns, hit.alias("hit"), F.when(hit, F.concat(f"_{a}", f"_{b}")).alias("features"))


def endpoints(pairs: DataFrame, kv: DataFrame, dim: int, a: str = "hypo", b: str = "hyper") -> DataFrame:
    """`pairs` with hit (both sides have a vector) and features: both sides' arrays in one, zeros for a missing one."""
    v = lambda side: kv.select(F.col("key").alias(side), F.col("vec").alias(f"_{side}"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    j = pairs.join(v(a), a, "left").join(v(b), b, "left")
    hit = F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull()
    return j.select(*pairs.columns, hit.alias("hit"), F.concat(F.coalesce(f"_{a}", zeros), F.coalesce(f"_{b}", zeros)).alias("features"))


def with_scalar(features: DataFrame, col: str) -> DataFrame:
    return features.withColumn("features", F.concat("features", F.array(F.coalesce(F.col(col), F.lit(0)).cast("double"))))


def bounded_label(path_len: str = "path_len", most: int = 3):
    """1 if there is a path of at most `most` steps."""
    return F.when(F.coalesce(F.col(path_len), F.lit(1_000_000_000)) <= most, 1).otherwise(0)


def build_all(pairs: DataFrame, path: DataFrame, picked: DataFrame, probs: DataFrame, x: DataFrame, vocab: DataFrame, n_bins: int = 333) -> dict[str, DataFrame]:
    """The four matrices of resolved pairs (pair_id, hypo_syn, hyper_syn), as rows (pair_id, col, v).

    picked: (pair_id, w1, w2); probs: (pair_id, freq, joint, cond); vocab with idx.
    Columns of the hypo half follow those of the hyper half.
    """
    flat = lambda f: f.select("pair_id", (F.col("bin") + F.when(F.col("half") == "hypo", n_bins).otherwise(0)).cast("long").alias("col"), "v")
    iv = interval_features(pairs, path, n_bins=n_bins)
    cols = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("col"), F.col(c).cast("double").alias("v")) for k, c in enumerate(("freq", "joint", "cond"))]))
    return {
        "interval": flat(iv), "interval_prob": flat(weighted(iv, probs)),
        "cooc": probs.select("pair_id", cols.alias("x")).select("pair_id", "x.col", "x.v").filter("v is not null and v <> 0"),
        "rawfreq": raw_rows(picked, x, vocab).withColumn("v", F.col("v").cast("double")),
    }


def bundle_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    """(pair_id, split, target, y): the train pairs' own label (1 where none is given), and what the graph of the
    positive train pairs says of the test pairs: direct, rowpath, colpath, union."""
    own = F.coalesce(F.col("label"), F.lit(1)) if "label" in train.columns else F.lit(1)
    rows = train.select("pair_id", F.lit("train").alias("split"), F.lit("label").alias("target"), own.cast("int").alias("y"))
    got = graph.train_labels(test, graph.adjacency(train.withColumn("label", own)))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("int").alias("y")) for c in ("direct", "rowpath", "colpath", "union")]))
    return rows.unionByName(got.select("pair_id", F.lit("test").alias("split"), each.alias("e")).select("pair_id", "split", "e.*"))


def build_datasets(train: dict[str, DataFrame], test: dict[str, DataFrame], path: DataFrame, x: DataFrame, vocab: DataFrame, n_bins: int = 333) -> tuple[dict[str, DataFrame], DataFrame]:
    """(matrices by name/split, labels) of train and test, each given as the frames `pairs` (pair_id, hypo, hyper,
    hypo_syn, hyper_syn, label), `picked` and `probs` of build_all; to be stored by write_bundle."""
    out = {}
    for split, given in (("train", train), ("test", test)):
        found = build_all(given["pairs"].select("pair_id", "hypo_syn", "hyper_syn"), path, given["picked"], given["probs"], x, vocab, n_bins)
        out |= {f"{name}_{split}": m for name, m in found.items()}
    return out, bundle_labels(train["pairs"], test["pairs"])


def diagnostics(pairs: DataFrame, path: DataFrame, sp: DataFrame, data_sp: DataFrame | None = None) -> DataFrame:
    """What the hierarchy and a data graph say of every pair (pair_id, hypo_syn, hyper_syn); nulls if a side is null.

    ds_path and ds_len, wn_path and wn_len: the shortest way up in the data graph
    and in the hierarchy and its number of nodes; wup and lca; the common
    ancestors' number and first ten; the interval through the hypernym, its width
    and its overlap with the hypernym's canonical one; the first step of both ways
    and the overlap of the intervals through these.  sp, data_sp: (start, node, path).
    """
    p = pairs.filter("hypo_syn is not null and hyper_syn is not null").select("pair_id", F.col("hypo_syn").alias("a"), F.col("hyper_syn").alias("b"))
    anc = hierarchy.ancestors(path).filter("d > 0").groupBy("node").agg(F.collect_set("a").alias("up"))
    up = lambda s: anc.select(F.col("node").alias(s), F.col("up").alias(f"up_{s}"))
    route = lambda t, c: t.select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("path").alias(c))
    none = F.lit(None).cast("array<string>")
    j = hierarchy.wu_palmer(p, path).join(up("a"), "a", "left").join(up("b"), "b", "left").join(route(sp, "wn"), ["a", "b"], "left")
    j = j.withColumn("ds", none) if data_sp is None else j.join(route(data_sp, "ds"), ["a", "b"], "left")
    j = j.withColumn("ds_parent", F.get("ds", F.lit(1))).withColumn("wn_parent", F.get("wn", F.lit(1)))
    asked = j.select("a", F.explode(F.array_distinct(F.filter(F.array("b", "ds_parent", "wn_parent"), lambda x: x.isNotNull()))).alias("anc")).distinct()
    via = cut(hierarchy.through(path, asked.select(F.col("a").alias("node"), "anc")).select(F.col("node").alias("a"), "anc", "lo", "hi"))
    at = lambda c, n: via.select("a", F.col("anc").alias(c), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"))
    j = j.join(at("b", "through"), ["a", "b"], "left").join(at("ds_parent", "ds"), ["a", "ds_parent"], "left").join(at("wn_parent", "wn"), ["a", "wn_parent"], "left")
    j = j.join(hierarchy.canonical(path).select(F.col("node").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")), "b", "left")
    over = lambda x, y: F.coalesce(interval_overlap(*(F.col(f"{n}_{e}") for n in (x, y) for e in ("lo", "hi"))), F.lit(0.0))
    sets = [F.coalesce(c, F.array().cast("array<string>")) for c in ("up_a", "up_b")]
    common = F.array_sort(F.array_intersect(*sets))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    out = j.select(
        "pair_id", F.col("a").alias("hypo"), F.col("b").alias("hyper"), F.array_join("ds", ">").alias("ds_path"), F.array_join("wn", ">").alias("wn_path"), size("ds").alias("ds_len"), size("wn").alias("wn_len"),
        "wup", "lca", F.size(common).cast("long").alias("common_anc_count"), F.array_join(F.slice(common, 1, 10), ",").alias("common_anc_sample"), "through_lo", "through_hi",
        F.coalesce(interval_width(F.col("through_lo"), F.col("through_hi")), F.lit(0.0)).alias("interval_through_width"), over("through", "b").alias("overlap_through_vs_hypercanon"),
        "ds_parent", "wn_parent", F.when(F.col("ds_parent").isNotNull() & F.col("wn_parent").isNotNull(), over("ds", "wn")).otherwise(0.0).alias("parent_interval_overlap"),
    )
    return pairs.select("pair_id").join(out, "pair_id", "left")
