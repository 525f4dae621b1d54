"""Queries over the hierarchy: paths, interval codes, vectors, closure, Katz sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import graph, hierarchy, vectorize
from ..sources.tables import edges, part_pairs, table, term_pairs
from . import sql
from .registry import query

_P = f"WITH RECURSIVE {sql.paths()}"
_PW = f"WITH RECURSIVE {sql.paths(True)}"
_IV = "round(lo, 9) + 0.0 AS lo, round(hi, 9) + 0.0 AS hi"


def _weights(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("f")).select(F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("node"), "f")


def _paths(spark, d, weighted=False):
    return hierarchy.paths(edges(spark, d), _weights(spark, d) if weighted else None)


def _dag(spark, d, digits=None):
    return hierarchy.dag(edges(spark, d), digits=digits)


def _iv(df, *cols):
    return df.select(*cols, rounded("lo", 9).alias("lo"), rounded("hi", 9).alias("hi"))


@query(f"{_P} SELECT node, array_to_string(path, '/') AS path, CAST(depth AS BIGINT) AS depth FROM path")
def all_paths(spark, d):
    return _paths(spark, d).select("node", F.array_join("path", "/").alias("path"), "depth")


@query(f"{_P} SELECT node, array_to_string(path, '/') AS path, {_IV} FROM path")
def interval_uniform(spark, d):
    return _iv(_paths(spark, d), "node", F.array_join("path", "/").alias("path"))


@query(f"{_PW} SELECT node, array_to_string(path, '/') AS path, {_IV} FROM path")
def interval_weighted(spark, d):
    return _iv(_paths(spark, d, True), "node", F.array_join("path", "/").alias("path"))


@query(f"{_P}, {sql.CANON} SELECT node, array_to_string(path, '/') AS path, {_IV} FROM canon")
def interval_canonical(spark, d):
    return _iv(hierarchy.canonical(_dag(spark, d)), "node", F.array_join("path", "/").alias("path"))


@query(f"{_P}, {sql.CANON} SELECT node, round(b + lo * 0.2, 9) AS lo, round(b + hi * 0.2, 9) AS hi FROM (SELECT *, CASE WHEN node LIKE 'part.%' THEN 0.2 WHEN node LIKE 'type.%' OR node LIKE 'brand.%' THEN 0.4 ELSE 0.0 END::DOUBLE AS b FROM canon)")
def interval_base(spark, d):
    """Canonical intervals in the base interval of the node's kind."""
    pos = F.when(F.col("node").startswith("part."), "v").when(F.col("node").startswith("type.") | F.col("node").startswith("brand."), "a").otherwise("n")
    return _iv(hierarchy.in_base(hierarchy.canonical(_dag(spark, d)), pos), "node")


@query(f"{_P} SELECT node, anc, {_IV} FROM (SELECT path.node, 'brand.' || p_brand AS anc, lo, hi, row_number() OVER (PARTITION BY path.node ORDER BY list_position(path, 'brand.' || p_brand) DESC, depth, array_to_string(path, '/')) AS r FROM path JOIN part ON node = 'part.' || p_partkey WHERE list_contains(path, 'brand.' || p_brand)) WHERE r = 1")
def interval_through(spark, d):
    """The interval of every part through its brand."""
    want = table(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"), F.concat(F.lit("brand."), "p_brand").alias("anc"))
    return _iv(hierarchy.through(_dag(spark, d), want), "node", "anc")


_WUP = f"""{_P}, {sql.ANCESTORS}, {sql.PART_PAIRS}, dep AS (SELECT node, max(depth) AS dep FROM path GROUP BY node),
lca AS (SELECT pair_id, arg_min(x.a, (-dep, x.a)) AS lca, max(dep) AS dl FROM pp JOIN anc x ON x.node = pp.a JOIN anc y ON y.node = pp.b AND y.a = x.a JOIN dep ON dep.node = x.a GROUP BY pair_id)
"""


@query(f"{_WUP} SELECT pp.*, lca, round(CASE WHEN lca IS NULL OR da.dep + db.dep = 0 THEN 0 ELSE 2.0 * dl / (da.dep + db.dep) END, 9) AS wup FROM pp LEFT JOIN lca USING (pair_id) LEFT JOIN dep da ON da.node = pp.a LEFT JOIN dep db ON db.node = pp.b")
def wup_similarity(spark, d):
    return hierarchy.wu_palmer(part_pairs(spark, d), _dag(spark, d)).withColumn("wup", rounded("wup", 9))


@query(f"{_P} SELECT node, CAST(min(depth) AS BIGINT) AS min_depth, CAST(max(depth) AS BIGINT) AS max_depth FROM path GROUP BY node")
def depths(spark, d):
    return hierarchy.depths(_dag(spark, d))


@query(f"WITH {sql.KIDS}, k AS (SELECT parent, child, round(idx::DOUBLE / n, 9) AS lo, round((idx + 1.0) / n, 9) AS hi FROM kid) SELECT x.parent, x.child AS a, y.child AS b FROM k x JOIN k y ON x.parent = y.parent AND x.child < y.child AND greatest(x.lo, y.lo) <= least(x.hi, y.hi)")
def sibling_overlaps(spark, d):
    """Children of one parent whose intervals touch or overlap."""
    k = hierarchy.child_places(edges(spark, d)).select("parent", "child", F.round(F.col("idx").cast("double") / F.col("n"), 9).alias("lo"), F.round((F.col("idx") + 1.0) / F.col("n"), 9).alias("hi"))
    return hierarchy.overlapping_siblings(k, allow_touch=False)


@query(f"""{_P}, q AS (SELECT a.p_partkey AS pair_id, 'part.' || a.p_partkey AS a, 'type.' || b.p_type AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT pair_id, a, b, coalesce(bool_or(y.lo <= x.lo + 1e-12 AND x.hi <= y.hi + 1e-12), false) AS nested FROM q LEFT JOIN path x ON x.node = a LEFT JOIN path y ON y.node = b GROUP BY 1, 2, 3""")
def nested_intervals(spark, d):
    """Every part against the type of the next part."""
    nxt = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("pair_id"), F.concat(F.lit("type."), "p_type").alias("t"))
    pairs = part_pairs(spark, d).join(nxt, "pair_id").select("pair_id", "a", F.col("t").alias("b"))
    return hierarchy.nested(pairs, _paths(spark, d))


@query(f"{_P}, {sql.CANON}, {sql.PART_PAIRS} SELECT pp.*, round(CASE WHEN least(x.hi, y.hi) <= greatest(x.lo, y.lo) THEN 0 ELSE 2 * (least(x.hi, y.hi) - greatest(x.lo, y.lo)) / (x.hi - x.lo + y.hi - y.lo) END, 6) + 0.0 AS overlap FROM pp JOIN canon x ON x.node = a JOIN canon y ON y.node = b")
def interval_overlap(spark, d):
    canon = _iv(hierarchy.canonical(_dag(spark, d)), "node")
    return hierarchy.overlaps(part_pairs(spark, d), canon).withColumn("overlap", rounded("overlap"))


_C9 = f"{_P}, {sql.CANON}, c AS (SELECT node, {_IV} FROM canon)"


def _canon9(spark, d):
    return _iv(hierarchy.canonical(_dag(spark, d)), "node")


@query(f"{_C9} SELECT node, least(greatest(floor(0.5 * (lo + hi) * 333), 0), 332)::INT AS bin, round(CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 9) AS mass FROM c")
def bins_midpoint(spark, d):
    return vectorize.midpoint(_canon9(spark, d)).withColumn("mass", rounded("mass", 9))


@query(f"{_C9} SELECT node, bin, round(mass, 9) AS mass FROM (SELECT node, b::INT AS bin, least((b + 1) / 333.0::DOUBLE, hi) - greatest(b / 333.0::DOUBLE, lo) AS mass FROM c, unnest(range(greatest(floor(lo * 333), 0)::INT, least(floor(hi * 333), 332)::INT + 1)) AS t(b) WHERE hi > lo) WHERE mass > 1e-9")
def bins_spread(spark, d):
    return vectorize.spread(_canon9(spark, d)).filter("mass > 1e-9").withColumn("mass", rounded("mass", 9))


@query(f"{_C9}, s AS (SELECT * FROM (VALUES (13, 0), (26, 13), (52, 39), (104, 91), (138, 195)) AS v(s, o)) SELECT node, (o + least(greatest(floor(0.5 * (lo + hi) * s), 0), s - 1))::INT AS bin, 1.0::DOUBLE AS mass FROM c, s")
def bins_multiscale(spark, d):
    return vectorize.multiscale(_canon9(spark, d))


@query(f"""{_P}, c AS (SELECT node, {_IV} FROM path), m AS (SELECT node, least(greatest(floor(0.5 * (lo + hi) * 333), 0), 332)::INT AS bin, sum(CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) AS mass FROM c GROUP BY 1, 2)
SELECT node, bin, round(mass / sum(mass) OVER (PARTITION BY node), 6) AS mass FROM m""")
def bins_path_sum(spark, d):
    return vectorize.summed(vectorize.midpoint(_iv(_paths(spark, d), "node"))).withColumn("mass", rounded("mass"))


@query(f"{_P}, {sql.CANON} SELECT node, array_to_string(steps, ' ') AS steps, CAST(len(steps) AS BIGINT) AS length, {_IV} FROM canon")
def codewords(spark, d):
    c = hierarchy.canonical(_dag(spark, d))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("/", s["idx"].cast("string"), s["n"].cast("string"))), " ")
    return _iv(c, "node", steps.alias("steps"), F.size("steps").cast("long").alias("length"))


@query(f"{_P}, {sql.CANON}, t AS (SELECT max(len(steps)) AS t FROM canon) SELECT node, CAST(len(steps) AS BIGINT) AS length, CAST(3 * t AS BIGINT) AS width, round(coalesce(list_sum(list_transform(steps, lambda s: split_part(s, '/', 1)::DOUBLE + split_part(s, '/', 2)::DOUBLE + 1.0 / split_part(s, '/', 2)::DOUBLE)), 0), 6) AS total FROM canon, t")
def codeword_padded(spark, d):
    p = hierarchy.padded(hierarchy.canonical(_dag(spark, d)))
    return p.select("node", "length", F.size("flat").cast("long").alias("width"), rounded(F.aggregate("flat", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), v AS (SELECT word, count(*) AS cnt FROM t GROUP BY word HAVING count(*) > 200)
SELECT 'part.' || p_partkey AS node, coalesce(max(cnt), 1) AS w_max, CAST(coalesce(sum(cnt), 1) AS BIGINT) AS w_sum FROM t LEFT JOIN v USING (word) GROUP BY p_partkey""")
def synset_weights(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"), F.translate(F.lower("p_name"), " ", "_").alias("lemma"))
    counts = nodes.select(F.explode(F.split("lemma", "_")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 200")
    return hierarchy.token_weights(nodes, counts)


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), v AS (SELECT word, count(*) AS cnt FROM t GROUP BY word), w AS (SELECT word, CASE WHEN length(word) > 4 THEN cnt END AS cnt, cnt * 2 AS r FROM v)
SELECT 'part.' || p_partkey AS node, max(coalesce(cnt, r)) AS w_max, CAST(sum(coalesce(cnt, r)) AS BIGINT) AS w_sum FROM t JOIN w USING (word) GROUP BY p_partkey""")
def backend_weights(spark, d):
    """Counts of long words; others take their row sum, here twice the count."""
    nodes = table(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"), F.translate(F.lower("p_name"), " ", "_").alias("lemma"))
    counts = nodes.select(F.explode(F.split("lemma", "_")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return hierarchy.token_weights(nodes, counts.filter("length(word) > 4"), counts.select(F.col("word").alias("w"), (F.col("cnt") * 2).alias("r")))


# -- graph ------------------------------------------------------------------------
def _graph(spark, d):
    return edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))


_E = f"WITH {sql.EDGES}, g AS (SELECT DISTINCT child AS src, parent AS dst FROM edge)"
_CL = f"WITH RECURSIVE {sql.EDGES}, g AS (SELECT DISTINCT child AS src, parent AS dst FROM edge), w AS (SELECT src, dst, 1 AS d FROM g UNION ALL SELECT w.src, g.dst, d + 1 FROM w JOIN g ON w.dst = g.src WHERE d < 50), cl AS (SELECT src, dst, min(d) AS d FROM w GROUP BY 1, 2)"


@query(f"WITH {sql.TERM_PAIRS} SELECT DISTINCT hypo AS src, hyper AS dst FROM tp WHERE label = 1")
def positive_adjacency(spark, d):
    return graph.adjacency(term_pairs(spark, d))


@query(f"{_CL} SELECT src, dst, CAST(d AS BIGINT) AS d FROM cl")
def closure(spark, d):
    return graph.closure(_graph(spark, d)).withColumn("d", F.col("d").cast("long"))


@query(f"{_CL}, {sql.TERM_PAIRS} SELECT tp.*, CASE WHEN cl.src IS NULL THEN 0 ELSE 1 END AS reachable FROM tp LEFT JOIN cl ON src = hypo AND dst = hyper")
def label_pairs(spark, d):
    return graph.reach_labels(term_pairs(spark, d), graph.closure(_graph(spark, d)))


_LAB = f"""{_CL}, {sql.TERM_PAIRS}, own AS (SELECT src, dst FROM cl UNION SELECT hyper, hyper FROM tp),
lab AS (SELECT pair_id, (EXISTS (SELECT 1 FROM g WHERE src = hypo AND dst = hyper))::INT AS direct, (EXISTS (SELECT 1 FROM cl WHERE src = hypo AND dst = hyper))::INT AS rowpath,
 (EXISTS (SELECT 1 FROM g JOIN own ON own.dst = g.dst WHERE g.src = hypo AND own.src = hyper))::INT AS colpath FROM tp)"""


@query(f"{_LAB} SELECT *, greatest(direct, rowpath, colpath) AS \"union\" FROM lab")
def labels_union(spark, d):
    """The direct, row-path, column-path and united labels of term pairs."""
    return graph.train_labels(term_pairs(spark, d), _graph(spark, d))


_TREE = f"""WITH RECURSIVE {sql.EDGES}, up AS (SELECT child AS start, child AS node, [child] AS path FROM (SELECT DISTINCT child FROM edge) UNION ALL SELECT start, parent, list_append(path, parent) FROM up JOIN edge ON child = node),
sp AS (SELECT start, node, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS r FROM up) WHERE r = 1)"""


@query(f"{_TREE} SELECT start, node, array_to_string(path, '>') AS path FROM sp")
def shortest_path(spark, d):
    g = _graph(spark, d)
    return graph.shortest_paths(g.select(F.col("src").alias("start")), g).select("start", "node", F.array_join("path", ">").alias("path"))


@query(f"{_TREE} SELECT start, node, CAST(len(path) - 1 AS BIGINT) AS d FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), node) AS r FROM sp WHERE node LIKE 'region.%' OR node LIKE 'brand.%') WHERE r = 1")
def nearest_target(spark, d):
    """The nearest region or brand above every node."""
    g = _graph(spark, d)
    sp = graph.shortest_paths(g.select(F.col("src").alias("start")), g).filter("node like 'region.%' or node like 'brand.%'")
    best = sp.groupBy("start").agg(F.min(F.struct((F.size("path") - 1).cast("long").alias("d"), F.col("node"))).alias("x"))
    return best.select("start", F.col("x.node").alias("node"), F.col("x.d").alias("d"))


_M = f"{_E}, m1 AS (SELECT src AS i, dst AS j, 1.0::DOUBLE AS v FROM g)"


def _powers(n: int) -> str:
    return "".join(f", m{k} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{k - 1} a JOIN m1 b ON a.j = b.i GROUP BY 1, 2)" for k in range(2, n + 1))


def _katz_sum(alpha: float, n: int) -> str:
    return " UNION ALL ".join(f"SELECT i, j, v * pow({alpha}, {k}) AS v FROM m{k}" for k in range(1, n + 1))


@query(f"{_M}{_powers(5)} SELECT i, j, round(sum(v), 9) AS v FROM ({_katz_sum(0.01, 5)}) GROUP BY 1, 2")
def katz_truncated(spark, d):
    return graph.katz(graph.matrix(_graph(spark, d), True)).withColumn("v", rounded("v", 9))


@query(f"""{_M}{_powers(5)}, k AS (SELECT i, j, sum(v) AS v FROM ({_katz_sum(0.01, 5)}) GROUP BY 1, 2),
new AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM k WHERE i <> j AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.i = k.i AND m1.j = k.j)) WHERE r <= 2)
SELECT i, j, 1.0::DOUBLE AS v FROM m1 UNION ALL SELECT i, j, 1.0 FROM new""")
def katz_complete(spark, d):
    return graph.katz_complete(graph.matrix(_graph(spark, d), True), top=2)


_SERIES = f"""{_M}, nd AS (SELECT i AS node FROM m1 UNION SELECT j FROM m1){_powers(4)}, se AS (SELECT i, j, sum(v) AS v FROM (SELECT node AS i, node AS j, 1.0::DOUBLE AS v FROM nd UNION ALL {_katz_sum(0.8, 4)}) GROUP BY 1, 2)"""


def _series(spark, d):
    m = graph.matrix(_graph(spark, d), True)
    nodes = m.select(F.col("i").alias("node")).union(m.select("j")).distinct()
    return graph.katz_series(m, nodes)


@query(f"{_SERIES} SELECT i, j, round(v, 6) AS v FROM se")
def katz_series(spark, d):
    return _series(spark, d).withColumn("v", rounded("v"))


_SP = f"{_SERIES}, sr AS (SELECT i, sum(v) AS r FROM se GROUP BY 1), sc AS (SELECT j, sum(v) AS c FROM se GROUP BY 1), st AS (SELECT sum(v) AS t FROM se), sp AS (SELECT i, j, ln((v * t + 1e-12) / (r * c + 1e-12)) AS v FROM se JOIN sr USING (i) JOIN sc USING (j), st)"


@query(f"{_SP} SELECT i, j, round(v - ln(5), 6) AS v FROM sp WHERE v > 0 AND v - ln(5) > 1e-9")
def katz_shifted_ppmi(spark, d):
    from ..operators import cooc

    return cooc.positive(_series(spark, d), 5.0).filter("v > 1e-9").withColumn("v", rounded("v"))


@query(f"{_SP}, p AS (SELECT * FROM sp WHERE v > 1e-9), n AS (SELECT i, sqrt(sum(v * v)) AS n FROM p GROUP BY 1) SELECT i, j, round(v / CASE WHEN n < 1e-12 THEN 1 ELSE n END, 6) AS v FROM p JOIN n USING (i)")
def l2_rows(spark, d):
    from ..operators import cooc

    return graph.l2_rows(cooc.positive(_series(spark, d)).filter("v > 1e-9")).withColumn("v", rounded("v"))


@query(f"{_SERIES} SELECT i, j, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS r FROM se WHERE v >= 0.6) WHERE r <= 2")
def row_topk(spark, d):
    return graph.row_top(_series(spark, d).withColumn("v", rounded("v", 9)), 2, 0.6).withColumn("v", rounded("v"))


@query(f"{_M}{_powers(5)}, {sql.TERM_PAIRS}, k AS (SELECT i, j, sum(v) AS v FROM ({_katz_sum(0.01, 5)}) GROUP BY 1, 2) SELECT tp.*, round(coalesce(v, 0), 9) AS score FROM tp LEFT JOIN k ON i = hypo AND j = hyper")
def katz_pairs(spark, d):
    return graph.pair_scores(term_pairs(spark, d), graph.katz(graph.matrix(_graph(spark, d), True))).withColumn("score", rounded("score", 9))


@query(f"WITH {sql.TERM_PAIRS}, w AS (SELECT hypo AS word FROM tp UNION SELECT hyper FROM tp) SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM w")
def vocab_union(spark, d):
    from ..operators import text

    p = term_pairs(spark, d)
    return text.numbered(p.select(F.col("hypo").alias("word")).union(p.select("hyper")).distinct(), "word")


@query(f"""{_M}, h AS (SELECT i, j, v FROM m1 UNION ALL SELECT i, 't.' || j, v * 2 FROM (SELECT j AS i, i AS j, v FROM m1) WHERE i <> j), a AS (SELECT i, j, v * v AS v FROM h WHERE v <> 0)
SELECT i, CAST(count(*) AS BIGINT) AS nnz, round(sum(v), 6) AS total FROM a GROUP BY i""")
def matrix_ops(spark, d):
    """The matrix beside twice its transpose, squared entry by entry: entries and sum of every row."""
    m = graph.matrix(_graph(spark, d), True)
    h = graph.beside(m, graph.without_diagonal(graph.scaled(graph.transposed(m), 2.0)), "t.")
    return graph.mapped(h, lambda v: v * v).groupBy("i").agg(F.count(F.lit(1)).alias("nnz"), rounded(F.sum("v")).alias("total"))
