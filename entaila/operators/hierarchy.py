"""Hierarchy operators: paths, interval codes, depths, similarity.

Edges are (child, parent, kind).  Children that divide a parent's interval are
those of kind hyper, in order of name; a step along an instance edge keeps the
parent's interval.  Levels are joined one after the other and written to the
checkpoint folder, so neither depth nor row count is bound by a recursion limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import interval_overlap, rounded
from ..functions.storage import cut
from ..sources.tables import ROOT
from .graph import closure

# Aliases of the parts of speech, and their base intervals.
POS_ALIASES = {"all": None, "any": None, "n": "n", "noun": "n", "nouns": "n", "v": "v", "verb": "v", "verbs": "v", "a": "a", "adj": "a", "adjective": "a", "r": "r", "adv": "r", "adverb": "r", "prep": "r", "s": "s"}
POS_BASE = {"n": (0.0, 0.2), "v": (0.2, 0.4), "a": (0.4, 0.6), "r": (0.6, 0.8), "s": (0.8, 1.0)}


def root_type(name: str) -> str | None:
    """The part of speech that a root type names; None for all."""
    key = str(name).strip().lower()
    if key not in POS_ALIASES:
        raise ValueError(f"unknown root type: {name}")
    return POS_ALIASES[key]


def base_interval(pos: Column, only: str | None = None) -> tuple[Column, Column]:
    """(lo, hi) of a part of speech; with `only`, [0, 1) for it and null for others."""
    if only is not None:
        return F.when(pos == only, F.lit(0.0)), F.when(pos == only, F.lit(1.0))
    lo = hi = F.lit(None).cast("double")
    for p, (a, b) in POS_BASE.items():
        lo, hi = F.when(pos == p, F.lit(a)).otherwise(lo), F.when(pos == p, F.lit(b)).otherwise(hi)
    return lo, hi


def child_places(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(parent, child, idx, n, before, share): where a child lies in its parent's interval.

    Without weights every child has the same share; `weights` is (node, f), 1 where missing.
    """
    e = edges.filter(F.col("kind") == "hyper").select("parent", "child")
    by, whole = Window.partitionBy("parent").orderBy("child"), Window.partitionBy("parent")
    idx, n = (F.row_number().over(by) - 1).cast("long"), F.count(F.lit(1)).over(whole)
    if weights is None:
        return e.select("parent", "child", idx.alias("idx"), n.alias("n")).withColumn("before", F.col("idx").cast("double") / F.col("n")).withColumn("share", F.lit(1.0) / F.col("n"))
    e = e.join(weights.withColumnRenamed("node", "child"), "child", "left").withColumn("f", F.coalesce(F.col("f").cast("double"), F.lit(1.0)))
    upto, total = F.sum("f").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.sum("f").over(whole)
    return e.select("parent", "child", idx.alias("idx"), n.alias("n"), (F.coalesce(upto, F.lit(0.0)) / total).alias("before"), (F.col("f") / total).alias("share"))


_STEP = "struct<idx:bigint,n:bigint,p:double>"


def _steps(edges: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(child, parent, idx, n, before, share) of all edges; those that divide no interval have nulls."""
    places = child_places(edges, weights)
    return cut(edges.alias("e").join(places.alias("p"), (F.col("e.parent") == F.col("p.parent")) & (F.col("e.child") == F.col("p.child")) & (F.col("e.kind") == "hyper"), "left").select("e.child", "e.parent", "idx", "n", "before", "share"))


def _start(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(1).select(F.lit(root).alias("node"), F.array(F.lit(root)).alias("path"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.array().cast(f"array<{_STEP}>").alias("steps"))


def _onward(level: DataFrame, step: DataFrame) -> DataFrame:
    """The paths of `level` with one more step."""
    moved, width = F.col("n").isNotNull(), F.col("hi") - F.col("lo")
    return level.join(step, F.col("node") == F.col("parent")).filter(~F.array_contains("path", F.col("child"))).select(
        F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"), (F.col("depth") + 1).alias("depth"),
        F.when(moved, F.col("lo") + F.col("before") * width).otherwise(F.col("lo")).alias("lo"),
        F.when(moved, F.col("lo") + (F.col("before") + F.col("share")) * width).otherwise(F.col("hi")).alias("hi"),
        F.when(moved, F.concat("steps", F.array(F.struct((F.col("idx") + 1).alias("idx"), F.col("n"), F.col("share").alias("p")).cast(_STEP)))).otherwise(F.col("steps")).alias("steps"),
    )


def paths(edges: DataFrame, weights: DataFrame | None = None, root: str = ROOT, max_depth: int | None = None) -> DataFrame:
    """(node, path, depth, lo, hi, steps): one row for each path from the root.

    steps holds idx (from 1), n and share of every step that divides an interval.
    A path ends before a node that it has already; with `max_depth` it has at most
    so many steps.  All paths are listed: for single ones of a node see `dag`.
    """
    step = _steps(edges, weights)
    level = _start(edges.sparkSession, root)
    found = [level]
    while max_depth is None or len(found) <= max_depth:
        level = cut(_onward(level, step))
        if level.isEmpty():
            break
        found.append(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@dataclass
class Dag:
    """What canonical intervals, depths, ancestors and intervals through an ancestor need, without listing all paths.

    best: a row as of `paths` for each node and length of a path from the root, the
    first by name: at most nodes x lengths, where k diamonds have 2^k paths.  steps:
    (child, parent, idx, n, before, share) between nodes that the root reaches.  With
    `digits` intervals are rounded when they are asked for.
    """

    best: DataFrame
    steps: DataFrame
    digits: int | None = None

    def rounded(self, path: DataFrame) -> DataFrame:
        return path if self.digits is None else path.withColumn("lo", rounded("lo", self.digits)).withColumn("hi", rounded("hi", self.digits))


def dag(edges: DataFrame, weights: DataFrame | None = None, root: str = ROOT, digits: int | None = None) -> Dag:
    """A dynamic programme by level.

    The first path by name of k steps to a node goes on from the first path of k - 1
    steps to one of its parents, so a level has a row a node.  A path ends before a
    node that it has already, which matters for edges with cycles only.
    """
    step = _steps(edges, weights)
    level = _start(edges.sparkSession, root)
    found = [level]
    while True:
        more = _onward(level, step).groupBy("node").agg(F.min_by(F.struct("path", "depth", "lo", "hi", "steps"), F.struct(F.array_join("path", "/"), "lo", "hi")).alias("b"))
        level = cut(more.select("node", "b.*"))
        if level.isEmpty():
            break
        found.append(level)
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    met = best.select(F.col("node").alias("parent")).distinct()
    return Dag(best, cut(step.join(met, "parent", "left_semi")), digits)


def canonical(path: DataFrame | Dag) -> DataFrame:
    """The shortest path of every node, the first by name among equal ones."""
    if isinstance(path, Dag):
        return path.rounded(canonical(path.best))
    first = Window.partitionBy("node").orderBy("depth", F.array_join("path", "/"))
    return path.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def in_base(path: DataFrame, pos: Column) -> DataFrame:
    """Intervals moved into the base interval of the node's part of speech."""
    lo, hi = base_interval(pos)
    return path.withColumn("_b", lo).withColumn("_w", hi - lo).withColumn("hi", F.col("_b") + F.col("hi") * F.col("_w")).withColumn("lo", F.col("_b") + F.col("lo") * F.col("_w")).drop("_b", "_w")


def through(path: DataFrame | Dag, wanted: DataFrame) -> DataFrame:
    """For each (node, anc) of `wanted` the path on which anc lies deepest; no row if there is none.

    Among several the shortest, then the first by name.
    """
    if isinstance(path, Dag):
        return _through(path, wanted)
    j = path.join(wanted, "node").withColumn("at", F.array_position("path", F.col("anc"))).filter("at > 0")
    best = Window.partitionBy("node", "anc").orderBy(F.desc("at"), "depth", F.array_join("path", "/"))
    return j.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def _through(dag: Dag, wanted: DataFrame) -> DataFrame:
    """The longest path from the root to anc, and the shortest on from there to the node, each the first by name.

    The second is found from the nodes upwards, with the part of the ancestor's
    interval that it leads to.
    """
    kind = dict(dag.best.dtypes)["steps"]
    level = cut(wanted.select("node").distinct().select("node", F.col("node").alias("anc"), F.array("node").alias("path"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.array().cast(kind).alias("steps")))
    seen = level
    moved = F.col("n").isNotNull()
    while True:
        up = level.join(dag.steps, F.col("anc") == F.col("child"))
        one = F.array(F.struct((F.col("idx") + 1).alias("idx"), F.col("n"), F.col("share").alias("p"))).cast(kind)
        up = up.select(
            "node", F.col("parent").alias("anc"), F.concat(F.array("parent"), "path").alias("path"), F.when(moved, F.col("before") + F.col("lo") * F.col("share")).otherwise(F.col("lo")).alias("lo"),
            F.when(moved, F.col("before") + F.col("hi") * F.col("share")).otherwise(F.col("hi")).alias("hi"), F.when(moved, F.concat(one, "steps")).otherwise(F.col("steps")).alias("steps"),
        )
        new = up.groupBy("node", "anc").agg(F.min_by(F.struct("path", "lo", "hi", "steps"), F.struct(F.array_join("path", "/"), "lo", "hi")).alias("b")).select("node", "anc", "b.*")
        level = cut(new.join(seen.select("node", "anc"), ["node", "anc"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    longest = dag.best.groupBy("node").agg(F.max_by(F.struct("path", "depth", "lo", "hi", "steps"), "depth").alias("t")).select(F.col("node").alias("anc"), "t")
    j = seen.join(wanted.select("node", "anc").distinct(), ["node", "anc"], "left_semi").join(longest, "anc")
    wide = F.col("t.hi") - F.col("t.lo")
    out = j.select(
        "node", "anc", F.concat("t.path", F.slice("path", F.lit(2), F.size("path") - 1)).alias("path"), (F.col("t.depth") + F.size("path") - 1).alias("depth"),
        (F.col("t.lo") + F.col("lo") * wide).alias("lo"), (F.col("t.lo") + F.col("hi") * wide).alias("hi"), F.concat("t.steps", "steps").alias("steps"), (F.col("t.depth") + 1).alias("at"),
    )
    return dag.rounded(out)


def ancestors(path: DataFrame | Dag) -> DataFrame:
    """(node, a, d): every ancestor at its least distance; the node itself at 0."""
    if isinstance(path, Dag):
        up = closure(path.steps.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct())
        own = path.best.select("node", F.col("node").alias("a"), F.lit(0).cast("long").alias("d")).distinct()
        return own.unionByName(up.filter("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("a"), F.col("d").cast("long").alias("d")))
    up = path.select("node", "depth", F.posexplode("path").alias("k", "a"))
    return up.groupBy("node", "a").agg(F.min(F.col("depth") - F.col("k")).alias("d"))


def depths(path: DataFrame | Dag) -> DataFrame:
    rows = path.best if isinstance(path, Dag) else path
    return rows.groupBy("node").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def wu_palmer(pairs: DataFrame, path: DataFrame | Dag, use: str = "max_depth", reach: DataFrame | None = None) -> DataFrame:
    """`pairs` (a, b) with lca and wup = 2 d(lca) / (d(a) + d(b)); roots have depth 0.

    The lca is the deepest common ancestor, first by name; none, or a sum of 0, gives 0.
    reach: the path's `ancestors`, if there already.
    """
    anc, dep = ancestors(path) if reach is None else reach, depths(path).select("node", F.col(use).alias("dep"))
    of = lambda side: pairs.select("pair_id", F.col(side).alias("node")).join(anc, "node").select("pair_id", "a")
    common = of("a").join(of("b"), ["pair_id", "a"]).join(dep.withColumnRenamed("node", "a"), "a")
    lca = common.groupBy("pair_id").agg(F.min_by(F.struct("a", "dep"), F.struct(-F.col("dep"), F.col("a"))).alias("x"))
    d = lambda side: dep.select(F.col("node").alias(side), F.col("dep").alias(f"d_{side}"))
    j = pairs.join(d("a"), "a", "left").join(d("b"), "b", "left").join(lca, "pair_id", "left")
    both = F.coalesce(F.col("d_a") + F.col("d_b"), F.lit(0))
    return j.select(*pairs.columns, F.col("x.a").alias("lca"), F.when(F.col("x").isNull() | (both == 0), 0.0).otherwise(2.0 * F.col("x.dep") / both).alias("wup"))


def overlapping_siblings(kids: DataFrame, allow_touch: bool = True, cells: int = 1024) -> DataFrame:
    """(parent, a, b): children (parent, child, lo, hi) whose intervals overlap.

    Intervals are dealt to the cells of a grid that they touch, so only
    neighbours meet; a pair is reported in the first cell it shares.
    """
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) * cells), F.lit(0)), F.lit(cells)).cast("int")
    at = kids.select("parent", "child", "lo", "hi", cell("lo").alias("c0"), F.explode(F.sequence(cell("lo"), F.greatest(cell("lo"), cell("hi")))).alias("cell"))
    a, b = at.alias("a"), at.alias("b")
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    meet = a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.child") < F.col("b.child")) & (F.greatest("a.c0", "b.c0") == F.col("a.cell")))
    return meet.filter(lo < hi if allow_touch else lo <= hi).select(F.col("a.parent").alias("parent"), F.col("a.child").alias("a"), F.col("b.child").alias("b"))


def nested(pairs: DataFrame, path: DataFrame, slack: float = 1e-12) -> DataFrame:
    """`pairs` (pair_id, a, b) with nested: some interval of a lies in some interval of b."""
    iv = lambda side: path.select(F.col("node").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
    j = pairs.join(iv("a"), "a", "left").join(iv("b"), "b", "left")
    inside = (F.col("lo_b") <= F.col("lo_a") + slack) & (F.col("hi_a") <= F.col("hi_b") + slack)
    return j.groupBy(*pairs.columns).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("nested"))


def overlaps(pairs: DataFrame, canon: DataFrame) -> DataFrame:
    """`pairs` with the normalised overlap of the canonical intervals; 0 if one is missing."""
    iv = lambda side: canon.select(F.col("node").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
    j = pairs.join(iv("a"), "a", "left").join(iv("b"), "b", "left")
    return j.select(*pairs.columns, F.coalesce(interval_overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")), F.lit(0.0)).alias("overlap"))


def padded(canon: DataFrame) -> DataFrame:
    """(node, length, flat): codeword steps as idx, n, p, idx, ... filled with zeros to the longest."""
    longest = canon.agg(F.coalesce(F.max(F.size("steps")), F.lit(0)).alias("longest"))  # one row
    flat = F.flatten(F.transform("steps", lambda s: F.array(s["idx"].cast("double"), s["n"].cast("double"), s["p"])))
    pad = F.array_repeat(F.lit(0.0), 3 * (F.col("longest") - F.size("steps")).cast("int"))
    return canon.crossJoin(F.broadcast(longest)).select("node", F.size("steps").cast("long").alias("length"), F.concat(flat, pad).alias("flat"))


def token_weights(nodes: DataFrame, counts: DataFrame, row_sums: DataFrame | None = None) -> DataFrame:
    """(node, w_max, w_sum) from the counts of the words of each node's lemma; at least 1.

    A word without a count takes its co-occurrence row sum, if given.
    """
    words = nodes.select("node", F.explode(F.filter(F.split("lemma", "_"), lambda w: w != "")).alias("word"))
    j = words.join(counts, "word", "left")
    value = F.col("cnt")
    if row_sums is not None:
        j = j.join(row_sums.select(F.col("w").alias("word"), F.col("r")), "word", "left")
        value = F.coalesce("cnt", "r")
    got = j.groupBy("node").agg(F.max(value).alias("m"), F.sum(value).alias("s"))
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, 1).otherwise(F.col(c)).cast("long")
    return nodes.select("node").join(got, "node", "left").select("node", one("m").alias("w_max"), one("s").alias("w_sum"))
