"""Metrics, paired comparisons and rank statistics, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def binary_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and class-1 precision, recall and F1, supports and rates; 0 where nothing is to divide by."""
    n = lambda a, b: F.sum(F.when((F.col(y) == a) & (F.col(p) == b), 1).otherwise(0)).alias(f"_{a}{b}")
    c = df.groupBy(*(by or [])).agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    tn, fp, fn, tp = (F.col(x) for x in ("_00", "_01", "_10", "_11"))
    p1, r1, p0, r0 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    total = tn + fp + fn + tp
    return c.select(
        *(by or []), _ratio(tp + tn, total).alias("acc"), ((p0 + p1) / 2).alias("prec_macro"), ((r0 + r1) / 2).alias("rec_macro"), ((f0 + f1) / 2).alias("f1_macro"), p1.alias("prec_1"), r1.alias("rec_1"), f1.alias("f1_1"),
        (tp + fn).alias("sup_1"), (tn + fp).alias("sup_0"), _ratio(tp + fn, total).alias("pos_rate"), _ratio(tp + fp, total).alias("pred_pos_rate"),
    )


def value_ranks(counts: DataFrame, col: str, n: str = "_n") -> DataFrame:
    """`counts`, a row for each value of `col` with its number of rows, with `rank`: their average rank.

    Values are dealt by range; a range's ranks begin after the rows of those before it.
    """
    c = cut(counts.repartitionByRange(col).withColumn("_part", F.spark_partition_id()))
    sizes = c.groupBy("_part").agg(F.sum(n).alias("_s"))
    before = sizes.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))  # a row for each range
    upto = F.sum(n).over(Window.partitionBy("_part").orderBy(col))
    return c.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + upto - (F.col(n) - 1) / 2).drop("_part", "_before")


def paired(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """One row: n, Spearman correlation, mean difference and its absolute, t and signed-rank statistics with their p, AUC of both.

    Only rows with both scores finite count; statistics are null for fewer than 3, and
    p of a signed-rank statistic without a difference.  Ranks and sums run on counts
    of values, so a common value is a row.
    """
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a)) & ~F.isnan(F.col(b)) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")))
    both = cut(ok.groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_n1"))).withColumn("_d", F.col("a") - F.col("b"))
    base = ok.select((F.col(a) - F.col(b)).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.avg(F.abs("_d")).alias("mean_abs_diff"), F.stddev_samp("_d").alias("_sd"))
    ranks = {c: cut(value_ranks(both.groupBy(c).agg(F.sum("_n").alias("_n"), F.sum("_n1").alias("_n1")), c)) for c in ("a", "b")}
    joined = both.join(ranks["a"].select("a", F.col("rank").alias("_ra")), "a").join(ranks["b"].select("b", F.col("rank").alias("_rb")), "b")
    middle = joined.agg(((F.sum("_n") + 1) / 2).alias("_m"))  # one row
    u, v = F.col("_ra") - F.col("_m"), F.col("_rb") - F.col("_m")
    sums = joined.crossJoin(F.broadcast(middle)).agg(F.sum(F.col("_n") * u * v).alias("_uv"), F.sum(F.col("_n") * u * u).alias("_uu"), F.sum(F.col("_n") * v * v).alias("_vv"))
    rho = sums.select(F.when((F.col("_uu") == 0) | (F.col("_vv") == 0), None).otherwise(F.col("_uv") / F.sqrt(F.col("_uu") * F.col("_vv"))).alias("spearman"))
    n1, n = F.sum("_n1"), F.sum("_n")
    auc = lambda c: ranks[c].agg(F.when((n1 == 0) | (n1 == n), None).otherwise((F.sum(F.col("_n1") * F.col("rank")) - n1 * (n1 + 1) / 2) / (n1 * (n - n1))).alias(f"auc_{c}"))
    plus = F.sum(F.when(F.col("_d") > 0, F.col("_n")).otherwise(0))
    s = value_ranks(both.filter("_d <> 0").groupBy(F.abs("_d").alias("_abs")).agg(F.sum("_n").alias("_n"), plus.alias("_plus")), "_abs")
    t3 = F.col("_n").cast("double")
    w = s.agg(
        F.coalesce(F.sum(F.col("_plus") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("_n") - F.col("_plus")) * F.col("rank")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_used"), F.coalesce(F.sum(t3 * t3 * t3 - t3), F.lit(0.0)).alias("_ties"),
    )
    few = F.col("n") < 3
    t = F.when((F.col("_sd") == 0) | F.col("_sd").isNull(), None).otherwise(F.col("mean_diff") / (F.col("_sd") / F.sqrt("n")))
    one = base.crossJoin(w).crossJoin(rho).crossJoin(auc("a")).crossJoin(auc("b")).withColumn("t", t).withColumn("wilcoxon", F.least("w_plus", "w_minus"))  # rows of one
    p = lambda f, *c: F.udf(lambda *x: f(*x), "double")(*c)  # of one row
    keep = lambda c, name: F.when(few, None).otherwise(c).alias(name)
    return one.select(
        "n", *[keep(F.col(c), c) for c in ("spearman", "mean_diff", "mean_abs_diff", "t")], keep(p(t_p, F.col("t"), F.col("n") - 1), "t_p"), keep(F.col("wilcoxon"), "wilcoxon"), keep(p(wilcoxon_p, F.col("wilcoxon"), F.col("n_used"), F.col("_ties")), "wilcoxon_p"), "n_used",
        keep(F.col("auc_a"), "auc_a"), keep(F.col("auc_b"), "auc_b"), keep(F.col("auc_a") - F.col("auc_b"), "auc_diff"),
    )


#: Signed-rank statistics of so many differences without ties have their exact distribution.
EXACT = 50


def wilcoxon_p(statistic: float | None, n: int, ties: float = 0.0) -> float | None:
    """Two-sided p of the smaller signed-rank sum of n differences; ties: sum of t^3 - t over groups of equal ones.

    Exact for few differences without ties: the number of subsets of the ranks 1..n with
    each sum, rank by rank.  Else the normal approximation with the ties' correction.
    """
    if statistic is None or n < 1:
        return None
    if n <= EXACT and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for s in range(rank * (rank + 1) // 2, rank - 1, -1):
                ways[s] += ways[s - rank]
        return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(statistic - n * (n + 1) / 4) / sd / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p(t: float | None, df: int) -> float | None:
    """Two-sided p of Student's t."""
    return None if t is None else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def leaderboard(df: DataFrame, order: tuple[str, ...] = ("auc", "f1", "f1_macro", "acc"), top: int = 10) -> DataFrame:
    """The best rows by the first metric of `order` that the table has; other columns settle ties."""
    metric = next((c for c in order if c in df.columns), None)
    if metric is None:
        raise ValueError(f"none of {order} is a column")
    return df.orderBy(F.desc_nulls_last(metric), *[c for c in df.columns if c != metric]).limit(top)
