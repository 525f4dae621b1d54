"""Graph operators: closure, train-derived labels, Katz sums, matrix algebra.

A matrix is a table of triplets (i, j, v); what is not there is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut


def adjacency(pairs: DataFrame, src: str = "hypo", dst: str = "hyper", label: str | None = "label") -> DataFrame:
    """(src, dst): distinct positive pairs, trimmed, without empty ends."""
    p = pairs.filter(F.col(label) == 1) if label and label in pairs.columns else pairs
    return p.select(F.trim(src).alias("src"), F.trim(dst).alias("dst")).filter("src <> '' and dst <> ''").distinct()


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, d): what is reached by one step or more, at its least distance.

    By doubling: with all pairs at most k steps apart, those k + 1 to 2k apart are
    pairs at exactly k steps followed by one of them, as a shortest path splits at its
    k-th node.  So there are about log2 of the depth rounds.  Only pairs not met
    before are kept, so cycles end.  With `max_depth` only what is within so many steps.
    """
    seen, k = cut(edges.select("src", "dst", F.lit(1).alias("d")).distinct()), 1
    while max_depth is None or k < max_depth:
        far = seen.filter(F.col("d") == k).select("src", F.col("dst").alias("_m"))
        near = seen.select(F.col("src").alias("_m"), "dst", (F.col("d") + k).alias("d"))
        more = far.join(near if max_depth is None else near.filter(F.col("d") <= max_depth), "_m").groupBy("src", "dst").agg(F.min("d").alias("d"))
        new = cut(more.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        seen, k = seen.unionByName(new), 2 * k
    return seen


def reach_labels(pairs: DataFrame, reach: DataFrame, a: str = "hypo", b: str = "hyper") -> DataFrame:
    """`pairs` with reachable: 1 if b is reached from a."""
    r = reach.select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(1).alias("_r")).distinct()
    return pairs.join(r, [a, b], "left").withColumn("reachable", F.coalesce("_r", F.lit(0))).drop("_r")


def train_labels(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, direct, rowpath, colpath, union): labels that the training graph gives to test pairs."""
    up = closure(edges)
    p = pairs.select("pair_id", F.col("hypo"), F.col("hyper"))
    mark = lambda df, name: df.select("pair_id", F.lit(1).alias(name)).distinct()
    direct = mark(p.join(edges, (F.col("hypo") == F.col("src")) & (F.col("hyper") == F.col("dst"))), "direct")
    row = mark(p.join(up, (F.col("hypo") == F.col("src")) & (F.col("hyper") == F.col("dst"))), "rowpath")
    own = up.select("src", "dst").unionByName(p.select(F.col("hyper").alias("src"), F.col("hyper").alias("dst")).distinct())
    parent = p.join(edges, F.col("hypo") == F.col("src")).select("pair_id", "hyper", F.col("dst").alias("parent"))
    col = mark(parent.join(own, (F.col("hyper") == F.col("src")) & (F.col("parent") == F.col("dst"))), "colpath")
    out = p.select("pair_id").join(direct, "pair_id", "left").join(row, "pair_id", "left").join(col, "pair_id", "left").fillna(0)
    return out.withColumn("union", F.greatest("direct", "rowpath", "colpath"))


def shortest_paths(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, path): the shortest upward path to every node reached, first by name; start itself in front.

    With `max_depth` only nodes within so many steps.
    """
    step = edges.select(F.col("src").alias("s"), F.col("dst").alias("t"))
    level = cut(starts.select(F.col("start"), F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    seen, k = level, 0
    while max_depth is None or k < max_depth:
        k += 1
        more = level.join(step, F.col("node") == F.col("s")).select("start", F.col("t").alias("node"), F.concat("path", F.array("t")).alias("path"))
        more = more.groupBy("start", "node").agg(F.min("path").alias("path"))
        level = cut(more.join(seen, ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


# -- matrices -----------------------------------------------------------------
def matrix(edges: DataFrame, binary: bool = False) -> DataFrame:
    """Edges as a matrix; repeated edges add up unless `binary`."""
    m = edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return m.withColumn("v", F.lit(1.0)) if binary else m


#: Rows of a matrix that meet at one inner index in a task, at most about.
SLICE = 10_000


def sliced(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a product with a column `s`: rows of a and b meet where a.j = b.i and s are the same.

    The rows of a at an inner index with more than `SLICE` of them (a hub's column) are
    dealt to slices by a hash, and b's rows there are sent to each slice.
    """
    n = a.groupBy(F.col("j").alias("_j")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SLICE)
    hubs = cut(n.select("_j", F.ceil(F.col("_n") / SLICE).cast("int").alias("_s")))  # at most a's rows / SLICE
    one = lambda m, key: m.join(hubs, F.col(key) == F.col("_j"), "left").withColumn("_s", F.coalesce("_s", F.lit(1))).drop("_j")
    x = one(a, "j").withColumn("s", F.pmod(F.xxhash64("i"), "_s").cast("int")).drop("_s")
    y = one(b, "i").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    return x, y


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: a join on the inner index, in slices where it is a hub, and a sum, map-side first."""
    x, y = (m.alias(n) for m, n in zip(sliced(a, b), "xy", strict=True))
    return x.join(y, (F.col("x.j") == F.col("y.i")) & (F.col("x.s") == F.col("y.s"))).groupBy(F.col("x.i").alias("i"), F.col("y.j").alias("j")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v"))


def plus(*ms: DataFrame) -> DataFrame:
    out = ms[0]
    for m in ms[1:]:
        out = out.unionByName(m)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def scaled(m: DataFrame, by: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * by)


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mapped(m: DataFrame, f: Callable) -> DataFrame:
    """A function of every entry that keeps 0; new zeros go."""
    return m.withColumn("v", f(F.col("v"))).filter("v <> 0")


def without_diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i <> j")


def beside(a: DataFrame, b: DataFrame, mark: str = "b.") -> DataFrame:
    """hstack: b's columns get a mark of their own."""
    return a.unionByName(b.withColumn("j", F.concat(F.lit(mark), "j")))


def below(a: DataFrame, b: DataFrame, mark: str = "b.") -> DataFrame:
    return a.unionByName(b.withColumn("i", F.concat(F.lit(mark), "i")))


def row_top(m: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k largest entries of every row, first by column among equal ones."""
    kept = m if least is None else m.filter(F.col("v") >= least)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), "j"))).filter(F.col("_n") <= k).drop("_n")


def l2_rows(m: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Rows of length 1; rows shorter than eps stay."""
    n = m.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    return m.join(n, "i").select("i", "j", (F.col("v") / F.when(F.col("_n") < eps, 1.0).otherwise(F.col("_n"))).alias("v"))


def katz(m: DataFrame, alpha: float = 0.01, k_max: int = 5) -> DataFrame:
    """Sum of alpha^k M^k for k = 1..k_max."""
    power, out = m, [scaled(m, alpha)]
    for k in range(2, k_max + 1):
        power = cut(times(power, m))
        if power.isEmpty():
            break
        out.append(scaled(power, alpha**k))
    return plus(*out)


def katz_complete(m: DataFrame, alpha: float = 0.01, k_max: int = 5, top: int | None = 10, least: float | None = None, rounds: int = 1) -> DataFrame:
    """Edges with those added that the Katz sums suggest, round by round."""
    now = m.select("i", "j").distinct().withColumn("v", F.lit(1.0))
    for _ in range(rounds):
        new = without_diagonal(katz(now, alpha, k_max)).join(now.select("i", "j"), ["i", "j"], "left_anti")
        new = new if least is None else new.filter(F.col("v") >= least)
        new = cut((row_top(new, top) if top else new).select("i", "j", F.lit(1.0).alias("v")))
        if new.isEmpty():
            break
        now = cut(now.unionByName(new))
    return now


def katz_series(m: DataFrame, nodes: DataFrame, alpha: float = 0.8, k_max: int = 10, tol: float = 1e-5, prune: int | None = 400) -> DataFrame:
    """I + sum of alpha^k M^k, each power cut to its largest entries a row; ends when little is added."""
    out = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("v"))
    power = out
    parts, mass = [out], float(nodes.count())
    for k in range(1, k_max + 1):
        power = times(power, m)
        power = cut(row_top(power, prune) if prune else power)
        add = scaled(power, alpha**k)
        s = add.agg(F.sum("v")).first()[0]
        if s is None:
            break
        parts.append(add)
        mass += s
        if mass > 0 and s / mass < tol:
            break
    return plus(*parts).filter("v <> 0")


def pair_scores(pairs: DataFrame, m: DataFrame, a: str = "hypo", b: str = "hyper") -> DataFrame:
    """`pairs` with score: the matrix entry of the trimmed pair, or 0."""
    e = m.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return pairs.join(e, (F.trim(a) == F.col("_i")) & (F.trim(b) == F.col("_j")), "left").withColumn("score", F.coalesce("_v", F.lit(0.0))).drop("_i", "_j", "_v")
