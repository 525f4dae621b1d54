"""Inputs of the operators, read or derived from the driver's tables.

The concept hierarchy is entity -> region -> nation -> supplier (and customer,
as instances), and entity -> type / brand -> part, where every part has two
parents.  Term pairs, senses and keyed vectors come from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "entity"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(doc_id, text) of documents, or of the turns of conversations."""
    t = table(spark, sf_dir, name)
    if name == "conversations":
        return t.select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "text")
    return t.select("doc_id", "text")


def _node(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}."), F.col(col).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, kind): the hierarchy; kind is hyper or instance."""
    region, nation, part = (table(spark, sf_dir, t) for t in ("region", "nation", "part"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    e = lambda df, child, parent, kind="hyper": df.select(child.alias("child"), parent.alias("parent"), F.lit(kind).alias("kind"))
    root = F.lit(ROOT)
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = e(region, _node("region", "r_name"), root)
    for more in (
        e(nations, _node("nation", "n_name"), _node("region", "r_name")),
        e(supplier, _node("supplier", "s_suppkey"), _node("nation", "n_name")),
        e(customer, _node("customer", "c_custkey"), _node("nation", "n_name"), "instance"),
        e(part.select("p_type").distinct(), _node("type", "p_type"), root),
        e(part.select("p_brand").distinct(), _node("brand", "p_brand"), root),
        e(part, _node("part", "p_partkey"), _node("type", "p_type")),
        e(part, _node("part", "p_partkey"), _node("brand", "p_brand")),
    ):
        out = out.unionByName(more)
    return out


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, a, b): every part with the next one by key."""
    key = table(spark, sf_dir, "part").select("p_partkey")
    nxt = key.select((F.col("p_partkey") - 1).alias("k"))
    return key.join(nxt, key["p_partkey"] == nxt["k"]).select(F.col("p_partkey").alias("pair_id"), _node("part", "p_partkey").alias("a"), F.concat(F.lit("part."), (F.col("p_partkey") + 1).cast("string")).alias("b"))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, hypo, hyper, label): suppliers with their nation (1), their region (1) and another nation (0)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    other = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("o_name"))
    s = s.join(other, F.pmod(F.col("s_nationkey") + 1 + F.col("s_suppkey") % 7, F.lit(25)) == F.col("k"))
    hypo = _node("supplier", "s_suppkey")
    row = lambda k, col, y: s.select((F.col("s_suppkey") * 3 + k).alias("pair_id"), hypo.alias("hypo"), col.alias("hyper"), F.lit(y).alias("label"))
    return row(0, _node("nation", "n_name"), 1).unionByName(row(1, _node("region", "r_name"), 1)).unionByName(row(2, _node("nation", "o_name"), 0))


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lemma, pos, synset, rank): parts as senses of their whole name and of each word of it."""
    part = table(spark, sf_dir, "part")
    name = F.translate(F.lower("p_name"), " ", "_")
    rows = part.select("p_partkey", F.explode(F.array_distinct(F.concat(F.array(name), F.split(name, "_")))).alias("lemma"))
    pos = F.when(F.col("p_partkey") % 5 == 4, "v").otherwise("n")
    return rows.select("lemma", pos.alias("pos"), _node("part", "p_partkey").alias("synset"), F.col("p_partkey").alias("rank"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vec): the embeddings, keyed by part name for the first and by number for the others."""
    e = table(spark, sf_dir, "embeddings")
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.translate(F.lower("p_name"), " ", "_").alias("name")).agg(F.min("p_partkey").alias("k"))
    vec = F.transform("embedding", lambda x: x.cast("double"))
    keyed = e.join(names.filter("k % 3 = 0"), F.col("vec_id") == F.col("k"), "left")
    return keyed.select(F.coalesce("name", F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("key"), vec.alias("vec"))
