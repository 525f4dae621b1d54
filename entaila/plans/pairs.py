"""Queries over pairs: features, metrics, fuzzy logic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import f_and, f_implies, f_not, pmean_error as pmean, rounded
from ..functions.storage import cut
from ..operators import evaluate, features, graph, hierarchy, logic, models, resolve, text
from ..sources.tables import edges, table, term_pairs
from . import sql
from .concepts import _dag, _paths
from .corpus import _counts
from .registry import query
from .terms import _KV, _PICK, _word_pairs, keyed


def _part_types(spark, d):
    """(pair_id, hypo_syn, hyper_syn): every part with its type."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("pair_id"), F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("hypo_syn"), F.concat(F.lit("type."), "p_type").alias("hyper_syn"))


_IF = f"""WITH RECURSIVE {sql.paths()}, {sql.CANON}, pt AS (SELECT p_partkey AS pair_id, 'part.' || p_partkey AS a, 'type.' || p_type AS b FROM part),
iv AS (SELECT pair_id, 'hyper' AS half, round(lo, 9) AS lo, round(hi, 9) AS hi FROM pt JOIN canon ON node = b UNION ALL SELECT pair_id, 'hypo', round(lo, 9), round(hi, 9) FROM pt JOIN path ON node = a WHERE list_contains(path, b)),
fe AS (SELECT pair_id, half, least(greatest(floor(0.5 * (lo + hi) * 64), 0), 63)::INT AS bin, 1.0::DOUBLE AS v FROM iv)"""


def _features(spark, d):
    return features.interval_features(_part_types(spark, d), _dag(spark, d, 9), n_bins=64)


@query(f"{_IF} SELECT * FROM fe")
def interval_features(spark, d):
    return _features(spark, d).withColumn("v", rounded("v"))


def _rich_sql(hypo: str) -> str:
    return f"""WITH RECURSIVE {sql.paths()}, {sql.CANON}, pt AS (SELECT p_partkey AS pair_id, 'part.' || p_partkey AS a, 'type.' || p_type AS b FROM part),
iv AS (SELECT pair_id, 'hyper' AS half, round(lo, 9) AS lo, round(hi, 9) AS hi FROM pt JOIN canon ON node = b UNION ALL SELECT pair_id, 'hyper', round(c.lo, 9), round(c.hi, 9) FROM pt JOIN kid ON kid.parent = b AND kid.idx < 3 JOIN canon c ON c.node = kid.child UNION ALL SELECT pair_id, 'hypo', round(lo, 9), round(hi, 9) FROM pt JOIN {hypo}),
ms AS (SELECT pair_id, half, least(greatest(floor(0.5 * (lo + hi) * 64), 0), 63)::INT AS bin, sum(CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS m FROM iv GROUP BY 1, 2, 3)
SELECT pair_id, half, bin, round(m / sum(m) OVER (PARTITION BY pair_id, half), 6) AS v FROM ms"""


def _rich(spark, d, mode, sp=None):
    """Types with their first three children; parts by `mode`."""
    path = _paths(spark, d).withColumn("lo", rounded("lo", 9)).withColumn("hi", rounded("hi", 9))
    children = hierarchy.child_places(edges(spark, d)).select("parent", "child", "idx")
    return features.interval_features(_part_types(spark, d), path, children, 3, 64, mode, sp).withColumn("v", rounded("v"))


@query(_rich_sql("path ON node = a"))
def interval_features_sum(spark, d):
    """Types with their first three children, and parts over all their paths."""
    return _rich(spark, d, "sum")


@query(_rich_sql("canon ON node = a OR node = b"))
def interval_features_path(spark, d):
    """Types with their first three children, and all nodes from a part up to its type."""
    up = edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return _rich(spark, d, "path", graph.shortest_paths(_part_types(spark, d).select(F.col("hypo_syn").alias("start")), up))


@query(f"""{_IF}, li AS (SELECT l_partkey AS pair_id, count(*) AS c FROM lineitem GROUP BY 1), ty AS (SELECT p_type, sum(c) AS t FROM li JOIN part ON p_partkey = pair_id GROUP BY 1), al AS (SELECT sum(c) AS n FROM li),
pr AS (SELECT pair_id, c / n AS joint, c / t AS cond FROM li JOIN part ON p_partkey = pair_id JOIN ty USING (p_type), al)
SELECT pair_id, half, bin, round(v * coalesce(CASE WHEN half = 'hyper' THEN cond ELSE joint END, 0), 9) AS v FROM fe LEFT JOIN pr USING (pair_id) WHERE coalesce(CASE WHEN half = 'hyper' THEN cond ELSE joint END, 0) <> 0""")
def probweighted_features(spark, d):
    """Interval features weighted by how often a part is ordered, of all lines and of its type's."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pair_id")).agg(F.count(F.lit(1)).alias("c"))
    j = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), "p_type"), "pair_id")
    ty, al = j.groupBy("p_type").agg(F.sum("c").alias("t")), li.agg(F.sum("c").alias("n"))
    probs = j.join(ty, "p_type").crossJoin(F.broadcast(al)).select("pair_id", (F.col("c") / F.col("n")).alias("joint"), (F.col("c") / F.col("t")).alias("cond"))
    return features.weighted(_features(spark, d), probs).withColumn("v", rounded("v", 9))


@query(f"{_PICK}, f AS (SELECT p.*, r, t FROM pick p LEFT JOIN rs ON rs.w = w1, tot WHERE freq > 0) SELECT pick.pair_id, coalesce(f.freq, 0) AS freq, round(coalesce(f.freq / t, 0), 9) AS joint, round(coalesce(f.freq / r, 0), 9) AS cond FROM pick LEFT JOIN f USING (pair_id)")
def cooc_features(spark, d):
    """Count, joint and conditional probability of the words of a pair met together most; zeros without one."""
    from ..operators import cooc

    x, vocab = _counts(spark, d)
    p = resolve.pick_pair(_word_pairs(spark, d), x, vocab, least=1)
    got = cooc.pair_probabilities(p.filter("w1 is not null").select("pair_id", "w1", "w2"), x, vocab)
    j = p.select("pair_id").join(got, "pair_id", "left")
    return j.select("pair_id", F.coalesce("freq", F.lit(0)).alias("freq"), rounded(F.coalesce("joint", F.lit(0.0)), 9).alias("joint"), rounded(F.coalesce("cond", F.lit(0.0)), 9).alias("cond"))


@query(f"{_PICK}, vi AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS idx, count(*) OVER () AS n FROM voc) SELECT pair_id, idx AS col, x AS v FROM pick JOIN x ON x.w1 = pick.w1 JOIN vi ON w = x.w2 UNION ALL SELECT pair_id, idx + n, x FROM pick JOIN x ON x.w1 = pick.w2 JOIN vi ON w = x.w2")
def rawfreq_features(spark, d):
    x, vocab = _counts(spark, d)
    picked = resolve.pick_pair(_word_pairs(spark, d), x, vocab)
    return features.raw_rows(picked, x, text.numbered(vocab, "word"))


@query(f"{_PICK} SELECT pair_id, w1, w2 FROM pick WHERE w1 IS NULL OR w2 IS NULL ORDER BY pair_id LIMIT 20")
def oov_report(spark, d):
    x, vocab = _counts(spark, d)
    return features.missing(resolve.pick_pair(_word_pairs(spark, d), x, vocab)).select("pair_id", "w1", "w2")


_VP = f"""WITH RECURSIVE {_KV}, {sql.paths()}, {sql.ANCESTORS}, {sql.TERM_PAIRS}, nk AS (SELECT 'nation.' || n_name AS node, 'v' || n_nationkey AS key FROM nation UNION ALL SELECT 'region.' || r_name, 'v' || (100 + r_regionkey) FROM region UNION ALL SELECT 'supplier.' || s_suppkey, 'v' || (s_suppkey * 7) FROM supplier),
vv AS (SELECT node, vec FROM nk JOIN kv USING (key)), vp AS (SELECT tp.*, x.vec AS xa, y.vec AS xb, d FROM tp LEFT JOIN vv x ON x.node = hypo LEFT JOIN vv y ON y.node = hyper LEFT JOIN anc ON anc.node = hypo AND a = hyper)"""


def _place_vectors(spark, d):
    """(key, vec) of regions, nations and suppliers; suppliers beyond the embeddings have none."""
    kv = keyed(spark, d)
    row = lambda t, node, n: table(spark, d, t).select(node.alias("node"), F.concat(F.lit("v"), n.cast("string")).alias("key"))
    at = row("nation", F.concat(F.lit("nation."), "n_name"), F.col("n_nationkey")).unionByName(row("region", F.concat(F.lit("region."), "r_name"), F.col("r_regionkey") + 100)).unionByName(row("supplier", F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string")), F.col("s_suppkey") * 7))
    return at.join(kv, "key").select(F.col("node").alias("key"), "vec")


def _closure_pairs(spark, d):
    reach = hierarchy.ancestors(_dag(spark, d)).select(F.col("node").alias("hypo"), F.col("a").alias("hyper"), F.col("d").alias("path_len"))
    p = term_pairs(spark, d).join(reach, ["hypo", "hyper"], "left")
    return features.joined_vectors(p, _place_vectors(spark, d)).withColumn("y", features.bounded_label("path_len", 1))


@query(f"{_VP} SELECT pair_id, hypo, hyper, label, d IS NOT NULL AS closure, CAST(d AS BIGINT) AS path_len, CASE WHEN d <= 1 THEN 1 ELSE 0 END AS y, xa IS NOT NULL AND xb IS NOT NULL AS hit, round(CASE WHEN xa IS NOT NULL AND xb IS NOT NULL THEN list_sum(xa) + 2 * list_sum(xb) END, 6) AS total FROM vp")
def closure_dataset(spark, d):
    """Term pairs with closure label, distance, bounded label and the sum of their features."""
    half = lambda a, n: F.aggregate(F.slice("features", a, n), F.lit(0.0), lambda s, x: s + x)
    return _closure_pairs(spark, d).select("pair_id", "hypo", "hyper", "label", F.col("path_len").isNotNull().alias("closure"), F.col("path_len").cast("long").alias("path_len"), "y", "hit", rounded(half(1, 64) + 2 * half(65, 64)).alias("total"))


@query(f"{_VP} SELECT CAST(count(*) AS BIGINT) AS pairs, round(avg((xa IS NOT NULL AND xb IS NOT NULL)::INT), 6) AS coverage, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 6) AS pos_rate FROM vp")
def pair_coverage(spark, d):
    return _closure_pairs(spark, d).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(F.col("hit").cast("int"))).alias("coverage"), rounded(F.avg("y")).alias("pos_rate"))


def _katz(spark, d):
    """Truncated Katz sums of the hierarchy's edges."""
    return graph.katz(graph.matrix(edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))))


@query(f"""{_VP}, kz AS (SELECT node, a, sum(pow(0.01, d)) AS s FROM (SELECT node, path, unnest(path) AS a, depth + 1 - unnest(range(1, len(path) + 1)) AS d FROM path) WHERE d BETWEEN 1 AND 5 GROUP BY 1, 2)
SELECT pair_id, CAST(len(xa) + len(xb) + 1 AS BIGINT) AS width, round(coalesce(s, 0), 9) AS last FROM vp LEFT JOIN kz ON kz.node = hypo AND kz.a = hyper WHERE xa IS NOT NULL AND xb IS NOT NULL""")
def append_scalar(spark, d):
    """Pair features with the pair's Katz score as one more column."""
    f = features.with_scalar(graph.pair_scores(_closure_pairs(spark, d).filter("hit"), _katz(spark, d)), "score")
    return f.select("pair_id", F.size("features").cast("long").alias("width"), rounded(F.element_at("features", -1), 9).alias("last"))


@query(f"""WITH RECURSIVE {sql.paths()}, {sql.CANON}, {sql.TERM_PAIRS} SELECT pair_id, x.node IS NOT NULL AND y.node IS NOT NULL AS hit, CAST(len(x.steps) AS BIGINT) AS hypo_steps, CAST(len(y.steps) AS BIGINT) AS hyper_steps FROM tp LEFT JOIN canon x ON x.node = hypo LEFT JOIN canon y ON y.node = hyper""")
def codeword_pairs(spark, d):
    """Codewords of both sides of term pairs."""
    flat = hierarchy.padded(hierarchy.canonical(_dag(spark, d)))
    j = features.joined_vectors(term_pairs(spark, d), flat.select(F.col("node").alias("key"), F.col("flat").alias("vec")))
    n = lambda s: flat.select(F.col("node").alias(s), F.col("length").alias(f"{s}_steps"))
    return j.join(n("hypo"), "hypo", "left").join(n("hyper"), "hyper", "left").select("pair_id", "hit", "hypo_steps", "hyper_steps")


def _overlap_sql(x, y):
    return f"coalesce(CASE WHEN least({x}.hi, {y}.hi) <= greatest({x}.lo, {y}.lo) THEN 0 ELSE 2 * (least({x}.hi, {y}.hi) - greatest({x}.lo, {y}.lo)) / ({x}.hi - {x}.lo + {y}.hi - {y}.lo) END, 0)"


@query(f"""WITH RECURSIVE {sql.paths()}, {sql.CANON}, {sql.ANCESTORS}, up AS (SELECT child AS start, child AS node, [child] AS p FROM (SELECT DISTINCT child FROM edge WHERE child LIKE 'part.%') UNION ALL SELECT start, parent, list_append(p, parent) FROM up JOIN edge ON child = node),
sp AS (SELECT start, node, p FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(p), p) AS r FROM up) WHERE r = 1),
pt AS (SELECT p_partkey * 4 + c AS pair_id, 'part.' || p_partkey AS a, CASE c WHEN 0 THEN 'type.' || p_type WHEN 1 THEN 'entity' WHEN 2 THEN (SELECT 'brand.' || max(n.p_brand) FROM part n WHERE n.p_partkey = part.p_partkey + 1) END AS b, p_partkey % 2 = 0 AS even, 'type.' || p_type AS ty FROM part, range(4) AS r(c)),
ok AS (SELECT *, CASE WHEN even AND b = ty THEN a || '>' || b WHEN even AND b = 'entity' THEN a || '>' || ty || '>entity' END AS ds_path, CASE WHEN even AND (b = ty OR b = 'entity') THEN ty END AS ds_parent FROM pt WHERE b IS NOT NULL),
dep AS (SELECT node, max(depth) AS dep FROM path GROUP BY node),
lca AS (SELECT pair_id, arg_min(x.a, (-dep, x.a)) AS lca, max(dep) AS dl FROM ok JOIN anc x ON x.node = ok.a JOIN anc y ON y.node = ok.b AND y.a = x.a JOIN dep ON dep.node = x.a GROUP BY pair_id),
cm AS (SELECT pair_id, count(*) AS n, list(x.a ORDER BY x.a) AS l FROM ok JOIN anc x ON x.node = ok.a AND x.d > 0 JOIN anc y ON y.node = ok.b AND y.a = x.a AND y.d > 0 GROUP BY pair_id),
th AS (SELECT node, ac, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY node, ac ORDER BY pos DESC, depth, array_to_string(path, '/')) AS r FROM (SELECT node, path, depth, lo, hi, unnest(path) AS ac, unnest(range(len(path))) AS pos FROM path WHERE node LIKE 'part.%')) WHERE r = 1)
SELECT pt.pair_id, ok.a AS hypo, ok.b AS hyper, ds_path, array_to_string(p, '>') AS wn_path, CAST(len(string_split(ds_path, '>')) AS BIGINT) AS ds_len, CAST(len(p) AS BIGINT) AS wn_len,
 CASE WHEN ok.a IS NOT NULL THEN round(CASE WHEN lca IS NULL OR da.dep + db.dep = 0 THEN 0 ELSE 2.0 * dl / (da.dep + db.dep) END, 9) END AS wup, lca,
 CASE WHEN ok.a IS NOT NULL THEN coalesce(cm.n, 0)::BIGINT END AS common_anc_count, CASE WHEN ok.a IS NOT NULL THEN coalesce(array_to_string(list_slice(cm.l, 1, 10), ','), '') END AS common_anc_sample, round(t.lo, 6) AS through_lo, round(t.hi, 6) AS through_hi,
 CASE WHEN ok.a IS NOT NULL THEN round(coalesce(t.hi - t.lo, 0), 6) END AS interval_through_width, CASE WHEN ok.a IS NOT NULL THEN round({_overlap_sql('t', 'c')}, 6) + 0.0 END AS overlap_through_vs_hypercanon, ds_parent, p[2] AS wn_parent,
 CASE WHEN ok.a IS NOT NULL THEN CASE WHEN ds_parent IS NULL OR p[2] IS NULL THEN 0 ELSE round({_overlap_sql('u', 'v')}, 6) + 0.0 END END AS parent_interval_overlap
FROM pt LEFT JOIN ok USING (pair_id) LEFT JOIN sp ON sp.start = ok.a AND sp.node = ok.b LEFT JOIN lca USING (pair_id) LEFT JOIN cm USING (pair_id) LEFT JOIN dep da ON da.node = ok.a LEFT JOIN dep db ON db.node = ok.b
 LEFT JOIN th t ON t.node = ok.a AND t.ac = ok.b LEFT JOIN canon c ON c.node = ok.b LEFT JOIN th u ON u.node = ok.a AND u.ac = ds_parent LEFT JOIN th v ON v.node = ok.a AND v.ac = p[2]""")
def diagnostics(spark, d):
    """Everything that the hierarchy and a data graph (half of the parts with their types) say about every part and its
    type, the root, the next part's brand, and no hypernym at all."""
    e = edges(spark, d)
    path = _dag(spark, d, 12)
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("brand."), "p_brand").alias("nb"))
    kind = F.array(F.concat(F.lit("type."), "p_type"), F.lit("entity"), F.col("nb"), F.lit(None).cast("string"))
    pairs = part.join(nxt, "p_partkey", "left").select("p_partkey", F.posexplode(kind).alias("c", "hyper_syn")).select((F.col("p_partkey") * 4 + F.col("c")).alias("pair_id"), F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("hypo_syn"), "hyper_syn")
    starts = pairs.select(F.col("hypo_syn").alias("start")).distinct()
    up = e.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    data = up.filter("dst like 'type.%' and try_cast(substring(src, 6) as long) % 2 = 0").unionByName(up.filter("src like 'type.%'"))
    out = features.diagnostics(pairs, path, graph.shortest_paths(starts, up), graph.shortest_paths(starts, data))
    return out.withColumns({c: rounded(c, 9 if c == "wup" else 6) for c, t in out.dtypes if t == "double"})


@query(f"""{_IF}, {_PICK.removeprefix("WITH ")},
pr AS (SELECT pair_id, freq::DOUBLE AS freq, freq / t AS joint, CASE WHEN coalesce(r, 0) = 0 THEN 0 ELSE freq / r END AS cond FROM pick LEFT JOIN rs ON rs.w = w1, tot WHERE w1 IS NOT NULL),
al AS (SELECT 'interval' AS matrix, v FROM fe UNION ALL SELECT 'interval_prob', v * CASE WHEN half = 'hyper' THEN cond ELSE joint END FROM fe JOIN pr USING (pair_id) UNION ALL SELECT 'cooc', unnest([freq, joint, cond]) FROM pr UNION ALL SELECT 'rawfreq', x.x FROM pick JOIN x ON x.w1 = pick.w1 UNION ALL SELECT 'rawfreq', x.x FROM pick JOIN x ON x.w1 = pick.w2)
SELECT matrix, count(*) AS n, round(sum(v), 6) AS total FROM al WHERE v <> 0 GROUP BY matrix""")
def feature_bundle(spark, d):
    """Rows and sum of every matrix, for parts and types whose words are those of benchmark items."""
    x, vocab = _counts(spark, d)
    from ..operators import cooc

    picked = resolve.pick_pair(_word_pairs(spark, d), x, vocab)
    probs = cooc.pair_probabilities(picked.select("pair_id", "w1", "w2"), x, vocab).select("pair_id", "freq", "joint", "cond")
    ms = features.build_all(_part_types(spark, d), _dag(spark, d), picked, probs, x, text.numbered(vocab, "word"))
    out = None
    for name, m in ms.items():
        r = m.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("v")).alias("total")).select(F.lit(name).alias("matrix"), "n", "total")
        out = r if out is None else out.unionByName(r)
    return out


def _bundle_pairs(spark, d):
    p = table(spark, d, "part")
    hypo, top = F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("hypo"), F.concat(F.lit("type."), "p_type")
    row = lambda df, n, a, b, *more: df.select((F.col("p_partkey") * 4 + n).alias("pair_id"), a, b.alias("hyper"), *more)
    types = p.groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey"))
    train = row(p, 0, hypo, top, (F.col("p_partkey") % 3 > 0).cast("int").alias("label")).unionByName(row(types, 3, top.alias("hypo"), F.lit("entity"), F.lit(None).cast("int").alias("label")))
    test = row(p, 1, hypo, F.lit("entity")).unionByName(row(p.filter("p_partkey % 5 = 0"), 2, hypo, top))
    return train, test


@query()
def bundle_evaluation(spark, d):
    """The four matrices of the pairs of `bundle_labels`, stored and read again as sparse rows, for all targets."""
    from ..operators import cooc
    from ..functions.storage import folder
    from ..sources.files import write_bundle

    x, vocab = _counts(spark, d)
    words = _word_pairs(spark, d).withColumnRenamed("pair_id", "item")
    given = []
    for pairs in _bundle_pairs(spark, d):
        p = cut(pairs.withColumn("hypo_syn", F.col("hypo")).withColumn("hyper_syn", F.col("hyper")))
        picked = cut(resolve.pick_pair(p.select("pair_id", F.floor(F.col("pair_id") / 4).alias("item")).join(words, "item").drop("item"), x, vocab))
        probs = cooc.pair_probabilities(picked.select("pair_id", "w1", "w2"), x, vocab).select("pair_id", "freq", "joint", "cond")
        given.append({"pairs": p, "picked": picked, "probs": probs})
    matrices, labels = features.build_datasets(*given, _dag(spark, d), x, text.numbered(vocab, "word"))
    path = folder(spark)
    write_bundle(path, matrices, labels)
    return models.evaluate_bundle(spark, path, mlp=False)


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 > 0 AS pos FROM part),
t AS (SELECT min(p_partkey) AS k FROM part GROUP BY p_type),
te AS (SELECT k * 4 + 1 AS pair_id, 0 AS direct, pos::INT AS rowpath, 0 AS colpath FROM p UNION ALL SELECT k * 4 + 2, pos::INT, pos::INT, pos::INT FROM p WHERE k % 5 = 0)
SELECT k * 4 AS pair_id, 'train' AS split, 'label' AS target, pos::INT AS y FROM p UNION ALL SELECT k * 4 + 3, 'train', 'label', 1 FROM t
UNION ALL SELECT pair_id, 'test', 'direct', direct FROM te UNION ALL SELECT pair_id, 'test', 'rowpath', rowpath FROM te UNION ALL SELECT pair_id, 'test', 'colpath', colpath FROM te UNION ALL SELECT pair_id, 'test', 'union', greatest(direct, rowpath, colpath) FROM te""")
def bundle_labels(spark, d):
    """Train pairs: every part with its type (two thirds positive), types with the root (no label); test pairs: parts with the root and some with their type."""
    return features.bundle_labels(*_bundle_pairs(spark, d))


# -- evaluation ------------------------------------------------------------------------
def _scores(spark, d):
    """Labelled documents with two scores of length; the prediction is a rule on the first."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("a"), F.size(F.split("text", " ")).cast("double").alias("b"), (F.col("n_chars") > 1000).cast("int").alias("p"), "lang")


_SC = "WITH s AS (SELECT doc_id, quality AS y, n_chars::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b, (n_chars > 1000)::INT AS p, lang FROM labels JOIN documents USING (doc_id))"
_BM = """SELECT {k} round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, round((dp1 + dp0) / 2, 6) AS prec_macro, round((dr1 + dr0) / 2, 6) AS rec_macro, round((df1 + df0) / 2, 6) AS f1_macro, round(dp1, 6) AS prec_1, round(dr1, 6) AS rec_1, round(df1, 6) AS f1_1, tp + fn AS sup_1, tn + fp AS sup_0, round((tp + fn) / (tp + tn + fp + fn), 6) AS pos_rate, round((tp + fp) / (tp + tn + fp + fn), 6) AS pred_pos_rate
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS dp1, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS dp0, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS dr1, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS dr0, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS df1, CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END AS df0
 FROM (SELECT {k} count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM s {g}))"""


def _six(df):
    return df.withColumns({c: rounded(c) for c, t in df.dtypes if t == "double"})


@query(f"{_SC} {_BM.format(k='', g='')}")
def binary_metrics(spark, d):
    return _six(evaluate.binary_metrics(_scores(spark, d), "y", "p"))


@query(f"{_SC} {_BM.format(k='lang,', g='GROUP BY lang')}")
def metrics_by_group(spark, d):
    return _six(evaluate.binary_metrics(_scores(spark, d), "y", "p", ["lang"]))


_RK = f"{_SC}, r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s)"


@query(f"{_RK} SELECT lang, round((sum(CASE WHEN y = 1 THEN ra ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT *  REPLACE (rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2 AS ra) FROM r) GROUP BY lang HAVING sum(y) > 0 AND sum(y) < count(*)")
def auc_rank(spark, d):
    """The area under the ROC curve of text length for quality, by language."""
    s = _scores(spark, d)
    by = s.groupBy("lang", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("a")
    r = by.withColumn("r", F.sum("n").over(w) - (F.col("n") - 1) / 2).groupBy("lang").agg(F.sum(F.col("r") * F.col("n1")).alias("s"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    return r.filter("n1 > 0 and n1 < n").select("lang", rounded((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * (F.col("n") - F.col("n1")))).alias("auc"))


@query(f"""{_RK}, g AS (SELECT *, rank() OVER (ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY abs(a - b)) - 1) / 2 AS rr FROM r WHERE a <> b),
w AS (SELECT least(sum(CASE WHEN a > b THEN rr ELSE 0 END), sum(CASE WHEN a < b THEN rr ELSE 0 END)) AS wx, count(*)::DOUBLE AS u FROM g), ti AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM g GROUP BY abs(a - b))),
m AS (SELECT count(*) AS n, corr(ra, rb) AS spearman, avg(a - b) AS md, avg(abs(a - b)) AS mad, stddev_samp(a - b) AS sd, (sum(CASE WHEN y = 1 THEN ra ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS aa, (sum(CASE WHEN y = 1 THEN rb ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS ab FROM r),
z AS (SELECT least(abs(wx - u * (u + 1) / 4) / sqrt(u * (u + 1) * (2 * u + 1) / 24 - ties / 48), 9.0) AS z, atan(abs(md / (sd / sqrt(n))) / sqrt(n - 1)) AS top, n - 1 AS df FROM w, ti, m),
si AS (SELECT z, top, df, i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 60000.0 AS c FROM z, range(20001) t(i)),
pv AS (SELECT 1 - sqrt(2 / pi()) * sum(c * z * exp(-pow(z * i / 20000.0, 2) / 2)) AS wp, 1 - 2 * exp(lgamma((max(df) + 1) / 2.0) - lgamma(max(df) / 2.0)) / sqrt(pi()) * sum(c * top * pow(cos(top * i / 20000.0), df - 1)) AS tp FROM si)
SELECT n, round(spearman, 6) AS spearman, round(md, 6) AS mean_diff, round(mad, 6) AS mean_abs_diff, round(md / (sd / sqrt(n)), 6) AS t, round(greatest(tp, 0), 6) + 0.0 AS t_p, round(wx, 6)::DOUBLE AS wilcoxon, round(greatest(wp, 0), 6) + 0.0 AS wilcoxon_p, u::BIGINT AS n_used, round(aa, 6) AS auc_a, round(ab, 6) AS auc_b, round(aa - ab, 6) + 0.0 AS auc_diff FROM m, w, pv""")
def paired_stats(spark, d):
    """Number of characters against number of words as scores of quality."""
    return _six(evaluate.paired(_scores(spark, d), "a", "b", "y"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS acc, c_mktsegment FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def leaderboard(spark, d):
    t = table(spark, d, "customer").select(F.col("c_acctbal").alias("acc"), "c_custkey", "c_mktsegment")
    return evaluate.leaderboard(t).select("c_custkey", rounded("acc").alias("acc"), "c_mktsegment")


# -- learners (rows only) ------------------------------------------------------------------
def _parts(df):
    """Three quarters of the pairs and the rest."""
    return df.filter(F.pmod(F.xxhash64("pair_id"), F.lit(4)) > 0), df.filter(F.pmod(F.xxhash64("pair_id"), F.lit(4)) == 0)


def _split(spark, d):
    return _parts(_closure_pairs(spark, d).filter("hit").select("pair_id", "hypo", "hyper", "label", "y", "features"))


@query()
def logreg(spark, d):
    """Predictions of a logistic regression for a held-out quarter of the term pairs."""
    return models.logistic(*_split(spark, d), standardise=True).drop("features")


@query()
def model_grid(spark, d):
    """Two learners on the vectors and on their first halves, for the pairs' label and for the bounded one."""
    half = lambda df: df.withColumn("short", F.concat(F.slice("features", 1, 32), F.slice("features", 65, 32)))
    train, test = map(half, _split(spark, d))
    return models.grid(train, test, {"vectors": "features", "short": "short"}, ["label", "y"])


@query()
def grid_comparison(spark, d):
    """The grid without and with the pair's Katz score as one more column."""
    katz = _katz(spark, d)
    train, test = _split(spark, d)
    more = lambda df: features.with_scalar(graph.pair_scores(df, katz), "score")
    return models.compare_grids(models.grid(train, test, {"vectors": "features"}, mlp=False), models.grid(more(train), more(test), {"vectors+katz": "features"}, mlp=False))


@query()
def feature_grids(spark, d):
    """Five feature sets of the term pairs, plain and with the Katz score: metrics of both learners and the paired statistics of their scores.

    Sets: vectors in the ball, codewords, the Katz score alone, a decomposition of the
    Katz matrix, and the places' vectors, or pseudo-vectors for places without one.
    """
    from ..operators import training

    e = edges(spark, d).join(table(spark, d, "customer").select(F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("child")), "child", "left_anti")
    e = cut(e.filter(~F.col("child").startswith("part.")).select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    pairs = cut(graph.pair_scores(term_pairs(spark, d), _katz(spark, d)).withColumn("katz", F.array("score")))
    keys = pairs.select(F.col("hypo").alias("key")).union(pairs.select("hyper")).distinct()
    flat = hierarchy.padded(hierarchy.canonical(_dag(spark, d))).select(F.col("node").alias("key"), F.col("flat").alias("vec"))
    node = lambda df: cut(df.select(F.col("node").alias("key"), "vec"))
    found = {
        "ball": (node(training.ball_embeddings(e, dim=16, epochs=10, burn_in=2)), 16),
        "codeword": (cut(flat.join(keys, "key", "left_semi")), flat.agg(F.max(F.size("vec"))).first()[0]),
        "katz_svd": (node(models.svd(*_katz_matrix(spark, d, e), 25)[0]), 25),
        "places": (cut(resolve.entity_vectors(keys, _place_vectors(spark, d), 64)), 64),
    }
    for name, (kv, dim) in found.items():
        pairs = features.endpoints(pairs, kv, dim).drop("hit").withColumnRenamed("features", name)
    names = [*found, "katz"]
    longer = lambda c: F.concat(c, F.array(F.coalesce("score", F.lit(0.0))))
    train, test = _parts(cut(pairs.withColumns({f"{c}+katz": longer(c) for c in names})))
    sets = lambda end: {f"{c}{end}": f"{c}{end}" for c in names}
    return _six(models.paired_grids(models.score_sets(train, test, sets("")), models.score_sets(train, test, sets("+katz"))))


@query()
def model_sweep(spark, d):
    """Vectors of two sizes and a model without any: learners on each, on the Katz score and on the codewords."""
    pairs = graph.pair_scores(_closure_pairs(spark, d).drop("hit", "features"), _katz(spark, d)).withColumn("katz", F.array("score"))
    flat = hierarchy.padded(hierarchy.canonical(_dag(spark, d))).select(F.col("node").alias("key"), F.col("flat").alias("vec"))
    width = flat.agg(F.max(F.size("vec"))).first()[0]
    pairs = features.endpoints(pairs, flat, width).drop("hit").withColumnRenamed("features", "codeword")
    kv = _place_vectors(spark, d)
    sized = lambda n: kv.select("key", F.slice("vec", 1, n).alias("vec"))
    found = {"places_16": lambda: sized(16), "places_64": lambda: sized(64), "none": lambda: kv.limit(0)}
    return models.sweep(found, *_parts(pairs), {"katz": "katz", "codeword": "codeword"}, "y")


@query()
def ols_formula(spark, d):
    """Extended price by quantity, return flag and their interaction."""
    return models.ols(table(spark, d, "lineitem"), "l_extendedprice ~ l_quantity + l_returnflag + l_quantity:l_returnflag")


def _katz_matrix(spark, d, e=None):
    """(matrix, nodes): the normalised PPMI of the Katz series of the whole hierarchy, or of edges (src, dst)."""
    from ..operators import cooc

    e = edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")) if e is None else e
    m = graph.matrix(e, True)
    nodes = text.numbered(m.select(F.col("i").alias("node")).union(m.select("j")).distinct(), "node")
    return graph.l2_rows(cooc.positive(graph.katz_series(m, nodes))), nodes


@query()
def svd_embedding(spark, d):
    """US of the matrix, eight columns of it."""
    return models.svd(*_katz_matrix(spark, d), 8)[0]


@query("""WITH t AS (SELECT a.n_name AS i, b.n_name AS j, count(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2),
nn AS (SELECT n_name AS node, lead(n_name) OVER (ORDER BY n_nationkey) AS following FROM nation)
SELECT node, coalesce(CAST((SELECT sum(v * v) FROM t WHERE i = node) AS BIGINT), 0) AS norm, CASE WHEN following IS NOT NULL THEN coalesce(CAST((SELECT sum(x.v * y.v) FROM t x JOIN t y ON x.j = y.j WHERE x.i = node AND y.i = following) AS BIGINT), 0) END AS inner, CAST((SELECT sum(v * v) FROM t) AS BIGINT) AS total FROM nn""")
def svd_trade(spark, d):
    """US of the order lines between customers' and suppliers' nations: what it keeps of the rows, and the squares of the singular values.

    All 25 columns are taken, so squared norms and inner products with the following
    nation's row are those of the counts, whatever the signs and rotations.
    """
    from pyspark.sql import Window

    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    at = lambda name, key, col: table(spark, d, name).join(nation, F.col(col) == F.col("n_nationkey")).select(key, F.col("n_name"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(at("supplier", "s_suppkey", "s_nationkey").withColumnRenamed("n_name", "j"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.groupBy("l_orderkey", "j").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(at("customer", "c_custkey", "c_nationkey").withColumnRenamed("n_name", "i"), F.col("o_custkey") == F.col("c_custkey"))
    m = cut(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("i", "j").agg(F.sum("n").alias("v")))
    nodes = cut(nation.select(F.col("n_name").alias("node"), F.col("n_nationkey").cast("long").alias("idx")))
    vec, s = models.svd(m, nodes, 25)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    whole = lambda c, name: F.round(c).cast("long").alias(name)
    following = F.lead("vec").over(Window.orderBy("idx"))  # 25 nations
    return vec.join(nodes, "node").withColumn("next", following).select("node", whole(dot("vec", "vec"), "norm"), whole(dot("vec", "next"), "inner"), whole(F.lit(sum(x * x for x in s)), "total"))


@query()
def svd_explained(spark, d):
    """The share of the matrix's variance that the eight columns have."""
    m, nodes = map(cut, _katz_matrix(spark, d))
    return models.explained_variance(m, models.svd(m, nodes, 8)[0])


@query()
def ball_embedding(spark, d):
    """Vectors in the Poincare ball of all nodes of the hierarchy."""
    from ..operators import training

    return training.ball_embeddings(edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")), dim=50, epochs=50, burn_in=10)


@query()
def logic_history(spark, d):
    """Satisfaction by epoch of predicates and entities trained on the term pairs, for vectors of two sizes, without and with the Katz score."""
    from ..operators import training

    kv = _place_vectors(spark, d)
    p = graph.pair_scores(term_pairs(spark, d), _katz(spark, d)).withColumn("split", F.when(F.pmod("pair_id", F.lit(4)) == 0, "test").otherwise("train"))
    keys = p.select(F.col("hypo").alias("key")).union(p.select("hyper"))
    return training.logic_runs({"places_16": kv.select("key", F.slice("vec", 1, 16).alias("vec")), "places_64": kv}, p, keys, epochs=6)


# -- fuzzy logic -----------------------------------------------------------------------------
def _score(u, v):
    """A closed-form relation of two vectors, which is not symmetric."""
    return 1 / (1 + F.exp(-4 * F.aggregate(F.zip_with(u, F.transform(v, lambda x, i: x * (1 + i / 64.0)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def _score_blocks(u, v):
    """The same relation of all rows of two arrays."""
    return 1 / (1 + np.exp(-4 * u @ (v * (1 + np.arange(v.shape[1]) / 64.0)).T))


def _entities(spark, d):
    """(key, vec): every embedding by its number."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _h(spark, d):
    """Truth over all ordered pairs of embeddings."""
    return logic.block_truth(_entities(spark, d), _score_blocks)


def _structural(spark, d, *axioms):
    return logic.structural_sums(_entities(spark, d), _score_blocks, **({"axioms": axioms} if axioms else {}))


#: The truth of all pairs, and the axioms' sums over all entities as products of matrices (see operators/logic.py).
_E = """WITH e AS MATERIALIZED (SELECT vec_id AS key, list_transform(embedding, lambda c: c::DOUBLE) AS v, list_transform(embedding, lambda c, i: c::DOUBLE * (1 + (i - 1) / 64.0)) AS w FROM embeddings)"""
_HT = f"""{_E}, h AS MATERIALIZED (SELECT a.key AS x, b.key AS y, 1 / (1 + exp(-4 * list_inner_product(a.v, b.w))) AS h FROM e a, e b), n AS (SELECT count(*)::DOUBLE AS n FROM e)"""
_TR = "qq AS MATERIALIZED (SELECT a.x, b.y, sum(a.h * a.h * b.h * b.h) AS v FROM h a JOIN h b ON a.y = b.x GROUP BY 1, 2), tr AS (SELECT 1 - sqrt(sum(pow(1 - h, 2) * v) / max(n * n * n)) AS sat FROM h JOIN qq USING (x, y), n)"
_SY = "ir AS (SELECT 1 - sqrt(avg(pow(h, 2))) AS sat FROM h WHERE x = y), sy AS (SELECT 1 - sqrt(avg(pow(1 - (1 - a.h + a.h * (1 - b.h)), 2))) AS sat FROM h a JOIN h b ON a.x = b.y AND a.y = b.x)"
_CL = """hh AS MATERIALIZED (SELECT a.x, b.y, sum(a.h * b.h) AS v FROM h a JOIN h b ON a.y = b.x GROUP BY 1, 2), h3 AS (SELECT a.x, b.y, sum(a.v * b.h) AS v FROM hh a JOIN h b ON a.y = b.x GROUP BY 1, 2), q3 AS (SELECT a.x, b.y, sum(a.v * b.h * b.h) AS v FROM qq a JOIN h b ON a.y = b.x GROUP BY 1, 2),
wy AS (SELECT x, y, 1 - sqrt(1 - 2 * h3.v / (n * n) + q3.v / (n * n)) AS s FROM h3 JOIN q3 USING (x, y), n), cl AS (SELECT 1 - sqrt(avg(pow(1 - (1 - h + h * s), 2))) AS sat FROM h JOIN wy USING (x, y))"""
#: The labelled pairs and their truth alone.
_LP = """lp AS (SELECT a.key AS x, b.key AS y, CASE WHEN b.key = a.key + 1 THEN 1 ELSE 0 END AS label, CASE WHEN a.key % 4 = 0 THEN 'test' ELSE 'train' END AS split, 1 / (1 + exp(-4 * list_inner_product(a.v, b.w))) AS h FROM (SELECT *, unnest([key - 1, key + 1]) AS other FROM e) a JOIN e b ON b.key = a.other),
da AS (SELECT split, label, 1 - sqrt(avg(pow(1 - CASE WHEN label = 1 THEN h ELSE 1 - h END, 2))) AS sat FROM lp GROUP BY 1, 2)"""


def _label_pairs(spark, d):
    """(x, y, label, split): every embedding with the next (true) and the one before (false); every fourth is for testing."""
    n = table(spark, d, "embeddings").select(F.col("vec_id").alias("x"))
    p = n.select("x", (F.col("x") + 1).alias("y"), F.lit(1).alias("label")).unionByName(n.select("x", (F.col("x") - 1).alias("y"), F.lit(0).alias("label")))
    return p.join(n.select(F.col("x").alias("y")), "y").withColumn("split", F.when(F.col("x") % 4 == 0, "test").otherwise("train"))


@query(f"{_HT} SELECT x, y, round(h, 6) AS h FROM h")
def predicate_truth(spark, d):
    return _h(spark, d).withColumn("h", rounded("h"))


@query("WITH e AS (SELECT event_id, value / 1000 AS a, 1 - value / 2000 AS b FROM events WHERE value IS NOT NULL) SELECT event_id, round(a * b, 6) AS t_and, round(1 - a, 6) AS t_not, round(1 - a + a * b, 6) AS t_implies FROM e")
def fuzzy_connectives(spark, d):
    e = table(spark, d, "events").filter("value is not null").select("event_id", (F.col("value") / 1000).alias("a"), (1 - F.col("value") / 2000).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("event_id", rounded(f_and(a, b)).alias("t_and"), rounded(f_not(a)).alias("t_not"), rounded(f_implies(a, b)).alias("t_implies"))


@query("WITH t AS (SELECT event_type, 1 - sqrt(avg(pow(1 - value / 1000, 2))) AS sat FROM events GROUP BY 1) SELECT event_type, round(sat, 6) AS sat FROM t UNION ALL SELECT 'all', round(1 - sqrt(avg(pow(1 - sat, 2))), 6) FROM t")
def pmean_error(spark, d):
    """Satisfaction by event type, and the aggregate over the types."""
    t = table(spark, d, "events").groupBy("event_type").agg(pmean(F.col("value") / 1000).alias("sat"))
    return t.unionByName(t.agg(pmean(F.col("sat")).alias("sat")).select(F.lit("all").alias("event_type"), "sat")).withColumn("sat", rounded("sat"))


@query(f"{_HT}, {_TR} SELECT round(sat, 6) AS sat FROM tr")
def transitivity_sat(spark, d):
    return _six(_structural(spark, d, "transitivity").select(F.col("transitivity").alias("sat")))


@query(f"{_HT}, {_SY} SELECT round(sy.sat, 6) AS asymmetry, round(ir.sat, 6) AS irreflexivity FROM sy, ir")
def asymmetry_sat(spark, d):
    return _six(_structural(spark, d, "asymmetry", "irreflexivity"))


@query(f"{_HT}, {_TR}, {_CL} SELECT round(sat, 6) AS sat FROM cl")
def closure_sat(spark, d):
    return _six(_structural(spark, d, "closure").select(F.col("closure").alias("sat")))


@query(f"{_E}, {_LP} SELECT split, label, round(sat, 6) AS sat FROM da")
def data_axioms(spark, d):
    return _six(logic.data_axioms(_label_pairs(spark, d), logic.pair_truth(_label_pairs(spark, d), _entities(spark, d), _score), ["split"]))


@query(f"""{_HT}, {_TR}, {_SY}, {_CL}, {_LP}, al AS (SELECT split, axiom, sat FROM (SELECT 'transitivity' AS axiom, sat FROM tr UNION ALL SELECT 'irreflexivity', sat FROM ir UNION ALL SELECT 'asymmetry', sat FROM sy UNION ALL SELECT 'closure', sat FROM cl), (SELECT DISTINCT split FROM lp) UNION ALL SELECT split, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END, sat FROM da)
SELECT split, axiom, round(sat, 6) AS sat FROM al UNION ALL SELECT split, 'overall', round(1 - sqrt(avg(pow(1 - sat, 2))), 6) FROM al GROUP BY split""")
def axiom_breakdown(spark, d):
    """Every axiom's satisfaction by split, and overall."""
    pairs = _label_pairs(spark, d)
    return _six(logic.breakdown(pairs, logic.pair_truth(pairs, _entities(spark, d), _score), _structural(spark, d), ["split"]))


@query(f"{_E}, {_LP} SELECT 0::BIGINT AS epoch, split, label, x, y, round(CASE WHEN label = 1 THEN h ELSE 1 - h END, 6) AS sat FROM lp")
def pair_snapshots(spark, d):
    p = _label_pairs(spark, d)
    h = logic.pair_truth(p, _entities(spark, d), _score)
    shots = [logic.snapshots(p.filter(F.col("split") == name).drop("split"), h, 0, name) for name in ("train", "test")]
    return _six(shots[0].unionByName(shots[1]))
