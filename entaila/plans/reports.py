"""Queries that assemble report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import report
from ..sources.files import cut_text, vector_lines
from ..sources.tables import table
from .registry import query


@query("SELECT p_partkey, contains(lower(p_name), 'ring') AS has_ring, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'small') THEN 'small' WHEN contains(lower(p_name), 'bolt') THEN 'bolt' ELSE 'unknown' END AS kind FROM part")
def embed_type_rules(spark, d):
    """A flag and a kind by ordered rules on a name."""
    p = table(spark, d, "part")
    return p.select("p_partkey", report.contains("p_name", "RING").alias("has_ring"), report.first_rule("p_name", (("ring", "ring"), ("small", "small"), ("bolt", "bolt"))).alias("kind"))


@query("SELECT event_id, CASE WHEN regexp_extract(props, '\"k\": (\\d+)', 1) = '' THEN NULL ELSE regexp_extract(props, '\"k\": (\\d+)', 1)::INT END AS k, -1 AS missing FROM events")
def regex_infer(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", report.extract_int("props", r'"k": (\d+)').alias("k"), report.extract_int("props", r"Dim(\d+)", -1).alias("missing"))


@query("SELECT c_custkey AS key, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def schema_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return report.united(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal")))


@query("SELECT s_suppkey, s_name FROM supplier")
def keep_columns(spark, d):
    return report.keep(table(spark, d, "supplier"), ["s_suppkey", "accuracy", "s_name", "precision_macro"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_per_group(spark, d):
    return report.last_rows(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def group_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'N' AND l_discount = 0 AND l_tax = 0 THEN NULL ELSE (CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END + CASE WHEN l_discount = 0 THEN 0 ELSE l_discount END + CASE WHEN l_tax = 0 THEN 0 ELSE l_tax END) / ((l_returnflag <> 'N')::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT) END, 6) AS mean FROM lineitem")
def row_mean(spark, d):
    """The mean of quantity (of returned lines), discount and tax where they are not zero."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("b"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("c"))
    return t.select("l_orderkey", "l_linenumber", rounded(report.row_mean("a", "b", "c")).alias("mean"))


@query("SELECT user_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id")
def first_non_null(spark, d):
    t = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return report.first_present(t, "user_id", "value", "event_id")


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) + 0.0 AS delta FROM events GROUP BY user_id")
def pivot_delta(spark, d):
    p = report.pivot_delta(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click")
    return p.withColumns({c: rounded(c) for c in ("view", "click", "delta")})


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def sorted_head(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").dropna(subset=["o_totalprice"])
    return t.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def ols_simple(spark, d):
    f = report.line_fit(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")
    return f.select("l_returnflag", rounded("slope", 4).alias("slope"), rounded("intercept", 4).alias("intercept"), rounded("r2").alias("r2"), "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS error, count(value) AS n FROM events GROUP BY 1")
def point_stats(spark, d):
    p = report.points(table(spark, d, "events"), ["event_type"], "value")
    return p.withColumns({c: rounded(c) for c in ("mean", "error")})


@query("SELECT md5('v_' || vec_id || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ' ')) AS line FROM embeddings")
def vector_text(spark, d):
    kv = table(spark, d, "embeddings").select(F.concat(F.lit("v "), F.col("vec_id").cast("string")).alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return vector_lines(kv).select(F.md5("value").alias("line"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(left(html, 300), '')) AS c, unnest(range(len(string_split(left(html, 300), '')))) AS i FROM pages),
b AS (SELECT page_id, i, c, sum(strlen(c)) OVER (PARTITION BY page_id ORDER BY i) AS bytes FROM c)
SELECT page_id, md5(coalesce(string_agg(c, '' ORDER BY i) FILTER (bytes <= 300), '')) AS head FROM pages JOIN b USING (page_id) GROUP BY page_id""")
def byte_prefix_whole(spark, d):
    """The first 300 bytes of every page, a character cut in two left out."""
    return table(spark, d, "pages").select("page_id", F.md5(cut_text(F.col("html").cast("binary"), 300)).alias("head"))
