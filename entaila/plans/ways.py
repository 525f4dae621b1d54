"""Terms of the places' hierarchy: senses, bias and the best way between them.

A phrase such as `NATION_3 Supplier` has all suppliers of the nation as senses, a
nation's name also its region, and suppliers' names differ in their part of speech,
so that distance, similarity, bias and order all come to decide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import norm_lemma
from ..functions.storage import cut
from ..operators import hierarchy, resolve
from ..sources.tables import edges, table
from . import sql
from .registry import query


def _suppliers(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").join(nation, "s_nationkey").join(region, "n_regionkey")


def _nations(spark, d):
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").join(region, "n_regionkey")


def _id(kind: str, col: str):
    return F.concat(F.lit(f"{kind}."), F.col(col).cast("string"))


def place_senses(spark, d):
    """(lemma, pos, synset, rank)."""
    s, n, r = _suppliers(spark, d), _nations(spark, d), table(spark, d, "region")
    row = lambda df, lemma, pos, synset, rank: df.select(lemma.alias("lemma"), pos.alias("pos"), synset.alias("synset"), rank.cast("long").alias("rank"))
    noun, verb, key = F.lit("n"), F.lit("v"), F.col("s_suppkey")
    out = row(s, norm_lemma(F.concat("n_name", F.lit(" Supplier"))), F.when(key % 5 == 4, verb).otherwise(noun), _id("supplier", "s_suppkey"), key)
    for more in (
        row(s, norm_lemma("s_name"), F.when(key % 3 == 0, verb).otherwise(noun), _id("supplier", "s_suppkey"), key),
        row(n, norm_lemma("n_name"), noun, _id("nation", "n_name"), F.lit(0)),
        row(n, norm_lemma("n_name"), noun, _id("region", "r_name"), F.lit(1)),
        row(r, norm_lemma("r_name"), noun, _id("region", "r_name"), F.lit(0)),
        row(r, F.lit("supplier"), noun, _id("region", "r_name"), F.col("r_regionkey")),
        row(spark.range(1), F.lit("thing"), noun, F.lit("entity"), F.lit(0)),
    ):
        out = out.unionByName(more)
    return out


def place_lemmas(spark, d):
    """(synset, lemma): a supplier with an even key is named by its nation."""
    s, n = _suppliers(spark, d), _nations(spark, d)
    named = F.when(F.col("s_suppkey") % 2 == 0, norm_lemma(F.concat("n_name", F.lit(" Supplier")))).otherwise(norm_lemma("s_name"))
    out = s.select(_id("supplier", "s_suppkey").alias("synset"), named.alias("lemma")).unionByName(n.select(_id("nation", "n_name").alias("synset"), norm_lemma("n_name").alias("lemma")))
    return out.unionByName(table(spark, d, "region").select(_id("region", "r_name").alias("synset"), norm_lemma("r_name").alias("lemma")))


def place_pairs(spark, d):
    """(pair_id, hypo, hyper): every supplier's name, and every nation's suppliers, with places below which they are and others."""
    s, n = _suppliers(spark, d), _nations(spark, d)
    other = table(spark, d, "nation").select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("o_name"))
    below = lambda key, by: F.pmod(F.col(key) + by, F.lit(25)).cast("int").alias("o")
    phrase = F.concat("n_name", F.lit(" Supplier")).alias("hypo")
    each = lambda *c: F.explode(F.array(*c)).alias("hyper")
    named = s.select(F.col("s_name").alias("hypo"), each("n_name", "r_name", F.lower("s_name"), F.lit("unheard of")))
    told = n.select(phrase, each("n_name", "r_name", F.lit("Thing"))).unionByName(n.select(F.col("n_name").alias("hypo"), F.col("n_name").alias("hyper")))
    moved = s.select(F.col("s_name").alias("hypo"), below("s_nationkey", F.lit(1) + F.col("s_suppkey") % 7))
    moved = moved.unionByName(n.select(phrase, "n_nationkey", F.explode(F.array(F.lit(1), F.lit(5), F.lit(7))).alias("k")).select("hypo", below("n_nationkey", F.col("k"))))
    out = named.unionByName(told).unionByName(moved.join(other, "o").select("hypo", F.col("o_name").alias("hyper")))
    return out.distinct().select(F.concat_ws("|", "hypo", "hyper").alias("pair_id"), "hypo", "hyper")


def _lm(x: str) -> str:
    return f"replace(regexp_replace(lower(trim({x})), '\\s+', '_', 'g'), '-', '_')"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, '_'), lambda t: t <> '')"


_PLACES = f"""WITH RECURSIVE {sql.EDGES}, sx AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), nx AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
sense AS (SELECT {_lm("n_name || ' Supplier'")} AS lemma, CASE WHEN s_suppkey % 5 = 4 THEN 'v' ELSE 'n' END AS pos, 'supplier.' || s_suppkey AS synset, s_suppkey AS rank FROM sx
  UNION ALL SELECT {_lm('s_name')}, CASE WHEN s_suppkey % 3 = 0 THEN 'v' ELSE 'n' END, 'supplier.' || s_suppkey, s_suppkey FROM sx UNION ALL SELECT {_lm('n_name')}, 'n', 'nation.' || n_name, 0 FROM nx
  UNION ALL SELECT {_lm('n_name')}, 'n', 'region.' || r_name, 1 FROM nx UNION ALL SELECT {_lm('r_name')}, 'n', 'region.' || r_name, 0 FROM region UNION ALL SELECT 'supplier', 'n', 'region.' || r_name, r_regionkey FROM region UNION ALL SELECT 'thing', 'n', 'entity', 0),
lem AS (SELECT 'supplier.' || s_suppkey AS hypo_syn, CASE WHEN s_suppkey % 2 = 0 THEN {_lm("n_name || ' Supplier'")} ELSE {_lm('s_name')} END AS lemma FROM sx UNION ALL SELECT 'nation.' || n_name, {_lm('n_name')} FROM nx UNION ALL SELECT 'region.' || r_name, {_lm('r_name')} FROM region),
pr AS (SELECT DISTINCT hypo || '|' || hyper AS pair_id, hypo, hyper FROM (SELECT s_name AS hypo, unnest([n_name, r_name, lower(s_name), 'unheard of']) AS hyper FROM sx
  UNION ALL SELECT s_name, o.n_name FROM supplier JOIN nation o ON o.n_nationkey = (s_nationkey + 1 + s_suppkey % 7) % 25 UNION ALL SELECT n_name || ' Supplier', unnest([n_name, r_name, 'Thing']) FROM nx UNION ALL SELECT n_name, n_name FROM nx
  UNION ALL SELECT n.n_name || ' Supplier', o.n_name FROM (SELECT n_name, n_nationkey, unnest([1, 5, 7]) AS k FROM nation) n JOIN nation o ON o.n_nationkey = (n.n_nationkey + n.k) % 25)),
spec AS (SELECT hypo AS spec FROM pr UNION SELECT hyper FROM pr), up AS (SELECT synset AS node, synset AS a, 0 AS d FROM (SELECT DISTINCT synset FROM sense) UNION SELECT node, parent, d + 1 FROM up JOIN edge ON child = a)"""

_RESOLVED = f"""{_PLACES}, sl AS (SELECT spec, {_lm('spec')} AS lm FROM spec),
tr AS (SELECT spec, 1 AS stage, 0 AS sub, lm AS lemma FROM sl UNION ALL SELECT spec, 2, 0, {_toks('lm')}[1] FROM sl WHERE len({_toks('lm')}) > 1 UNION ALL SELECT spec, 2, 1, {_toks('lm')}[-1] FROM sl WHERE len({_toks('lm')}) > 1),
ht AS (SELECT *, min(stage) OVER (PARTITION BY spec) AS f FROM tr JOIN sense USING (lemma)), cn AS (SELECT spec, synset, min((sub, rank)) AS o, min(pos) AS pos FROM ht WHERE stage = f GROUP BY spec, synset),
cd AS (SELECT spec, synset, row_number() OVER (PARTITION BY spec ORDER BY o, synset) AS ord FROM cn WHERE pos = 'n' OR spec NOT IN (SELECT spec FROM cn WHERE pos = 'n')),
bo AS (SELECT pair_id, a.synset AS hypo_syn, b.synset AS hyper_syn, a.ord AS ho, b.ord AS uo, {_toks(_lm('hypo'))} AS ht, {_toks(_lm('hyper'))} AS ut, {_toks('lemma')} AS lt FROM pr JOIN cd a ON a.spec = hypo JOIN cd b ON b.spec = hyper LEFT JOIN lem ON lem.hypo_syn = a.synset),
bi AS (SELECT *, coalesce(greatest((list_has_any(lt, ut)::INT * 0.05::DOUBLE + (len(ht) >= 2 AND list_has_any(lt, ut) AND list_has_any(ht, ut))::INT * 0.05::DOUBLE) - (len(ht) >= 2 AND list_contains(lt, ht[1]))::INT * 0.01::DOUBLE, 0.0), 0.0) AS bias FROM bo)"""


@query(f"{_RESOLVED} SELECT DISTINCT pair_id, hypo_syn, round(bias, 6) + 0.0 AS bias FROM bi")
def sense_bias(spark, d):
    """The bias of every sense of a pair's hyponym."""
    pairs = cut(place_pairs(spark, d))
    c = cut(resolve.candidates_or_any(pairs.select(F.col("hypo").alias("spec")).union(pairs.select("hyper")).distinct(), place_senses(spark, d)))
    known = c.select(F.col("spec").alias("hyper")).distinct()
    j = pairs.join(known, "hyper", "left_semi").join(c.select(F.col("spec").alias("hypo"), F.col("synset").alias("hypo_syn")), "hypo")
    j = j.join(place_lemmas(spark, d).withColumnRenamed("synset", "hypo_syn"), "hypo_syn", "left")
    bias = F.coalesce(resolve.lexical_bias(F.col("hypo"), F.col("hyper"), F.col("lemma")), F.lit(0.0))
    return j.select("pair_id", "hypo_syn", (F.round(bias, 6) + F.lit(0.0)).alias("bias"))


@query(f"""{_RESOLVED}, dp AS (SELECT node, max(d) AS dep FROM up WHERE a = 'entity' GROUP BY node),
cm AS (SELECT hypo_syn, hyper_syn, max(dep - x.d) AS top FROM (SELECT DISTINCT hypo_syn, hyper_syn FROM bi) JOIN up x ON x.node = hypo_syn JOIN up y ON y.node = hyper_syn AND y.a = x.a JOIN dp ON dp.node = hypo_syn GROUP BY 1, 2),
ti AS (SELECT bi.*, up.d AS d, CASE WHEN p.dep + q.dep > 0 THEN 2 * top::DOUBLE / (p.dep + q.dep) ELSE 0 END AS wup, CASE WHEN hypo_syn = hyper_syn THEN 3 WHEN up.d IS NOT NULL THEN 1 ELSE 2 END AS tier FROM bi JOIN cm USING (hypo_syn, hyper_syn) JOIN dp p ON p.node = hypo_syn JOIN dp q ON q.node = hyper_syn LEFT JOIN up ON up.node = hypo_syn AND up.a = hyper_syn),
sc AS (SELECT *, CASE tier WHEN 1 THEN d + bias WHEN 2 THEN bias - wup ELSE 0.0 END AS score FROM (SELECT *, min(tier) OVER (PARTITION BY pair_id) AS first FROM ti) WHERE tier = first),
be AS (SELECT pair_id, arg_min((hypo_syn, hyper_syn), (round(score, 9), ho, uo)) AS x FROM sc GROUP BY pair_id)
SELECT pair_id, x[1] AS hypo_syn, x[2] AS hyper_syn FROM pr LEFT JOIN be USING (pair_id)""")
def resolve_ways(spark, d):
    """The best senses of every pair of places: by distance and bias, else by similarity and bias, else the same sense twice."""
    path = hierarchy.dag(edges(spark, d))
    reach = cut(hierarchy.ancestors(path))
    up = reach.filter("d > 0").select(F.col("node").alias("src"), F.col("a").alias("dst"), "d")
    return resolve.resolve_pairs(cut(place_pairs(spark, d)), place_senses(spark, d), place_lemmas(spark, d), up, lambda p: hierarchy.wu_palmer(p, path, reach=reach))


@query(f"""{_PLACES}, uw AS (SELECT spec, lower(trim(spec)) AS low, list_filter(regexp_split_to_array(lower(trim(spec)), '[\\s_]+'), lambda t: t <> '') AS w FROM spec),
uv AS (SELECT spec, 0 AS variant, low AS lemma FROM uw UNION ALL SELECT spec, 1, array_to_string(w, '_') FROM uw UNION ALL SELECT spec, 2, w[1] FROM uw UNION ALL SELECT spec, 3, w[len(w)] FROM uw),
un AS (SELECT * FROM (SELECT spec, synset, row_number() OVER (PARTITION BY spec ORDER BY o, synset) AS ord FROM (SELECT spec, synset, min((variant, rank)) AS o FROM uv JOIN sense USING (lemma) WHERE pos = 'n' GROUP BY spec, synset)) WHERE ord <= 5),
be AS (SELECT pair_id, min((d, a.ord, b.ord, a.synset, b.synset)) AS x FROM pr JOIN un a ON a.spec = hypo JOIN un b ON b.spec = hyper JOIN up ON node = a.synset AND up.a = b.synset GROUP BY pair_id)
SELECT pair_id, x IS NOT NULL AS closure, x[1]::BIGINT AS path_len, x[4] AS hypo_syn, x[5] AS hyper_syn FROM pr LEFT JOIN be USING (pair_id)""")
def best_ways(spark, d):
    """The shortest way, of none to three steps, between any of the first senses of every pair of places."""
    return resolve.best_path(cut(place_pairs(spark, d)), place_senses(spark, d), hierarchy.ancestors(hierarchy.dag(edges(spark, d))))
