"""DuckDB fragments that several oracles share."""

EDGES = """edge AS (
  SELECT 'region.' || r_name AS child, 'entity' AS parent, 'hyper' AS kind FROM region
  UNION ALL SELECT 'nation.' || n_name, 'region.' || r_name, 'hyper' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier.' || s_suppkey, 'nation.' || n_name, 'hyper' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || n_name, 'instance' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'type.' || p_type, 'entity', 'hyper' FROM part
  UNION ALL SELECT DISTINCT 'brand.' || p_brand, 'entity', 'hyper' FROM part
  UNION ALL SELECT 'part.' || p_partkey, 'type.' || p_type, 'hyper' FROM part
  UNION ALL SELECT 'part.' || p_partkey, 'brand.' || p_brand, 'hyper' FROM part)"""

#: child places: share of the parent's interval before the child, and its own.
KIDS = (
    EDGES
    + """, wt AS (SELECT 'part.' || l_partkey AS node, count(*) AS f FROM lineitem GROUP BY l_partkey),
kid AS (SELECT parent, child, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY parent) AS n,
  coalesce(f, 1)::DOUBLE AS f, coalesce(sum(coalesce(f, 1)) OVER (PARTITION BY parent ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fb, sum(coalesce(f, 1)) OVER (PARTITION BY parent)::DOUBLE AS ft
  FROM edge LEFT JOIN wt ON wt.node = child WHERE kind = 'hyper' WINDOW w AS (PARTITION BY parent ORDER BY child))"""
)


def paths(weighted: bool = False) -> str:
    before, share = ("k.fb / k.ft", "k.f / k.ft") if weighted else ("k.idx::DOUBLE / k.n", "1::DOUBLE / k.n")
    return (
        KIDS
        + f""", path AS (SELECT 'entity' AS node, ['entity'] AS path, 0 AS depth, 0::DOUBLE AS lo, 1::DOUBLE AS hi, []::VARCHAR[] AS steps
  UNION ALL SELECT e.child, list_append(p.path, e.child), p.depth + 1,
    CASE WHEN k.n IS NULL THEN p.lo ELSE p.lo + ({before}) * (p.hi - p.lo) END,
    CASE WHEN k.n IS NULL THEN p.hi ELSE p.lo + ({before} + {share}) * (p.hi - p.lo) END,
    CASE WHEN k.n IS NULL THEN p.steps ELSE list_append(p.steps, (k.idx + 1) || '/' || k.n) END
  FROM path p JOIN edge e ON e.parent = p.node LEFT JOIN kid k ON k.parent = e.parent AND k.child = e.child AND e.kind = 'hyper')"""
    )


CANON = """canon AS (SELECT node, path, depth, lo, hi, steps FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, array_to_string(path, '/')) AS r FROM path) WHERE r = 1)"""

#: ancestors of every node, itself included at distance 0
ANCESTORS = """anc AS (SELECT node, a, min(d) AS d FROM (SELECT node, unnest(path) AS a, depth + 1 - unnest(range(1, len(path) + 1)) AS d FROM path) GROUP BY node, a)"""

PART_PAIRS = """pp AS (SELECT a.p_partkey AS pair_id, 'part.' || a.p_partkey AS a, 'part.' || b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""

TERM_PAIRS = """sp AS (SELECT s_suppkey AS k, 'supplier.' || s_suppkey AS hypo, 'nation.' || n.n_name AS n1, 'region.' || r_name AS r1, 'nation.' || o.n_name AS n2
  FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey JOIN nation o ON o.n_nationkey = (s_nationkey + 1 + s_suppkey % 7) % 25),
tp AS (SELECT k * 3 AS pair_id, hypo, n1 AS hyper, 1 AS label FROM sp UNION ALL SELECT k * 3 + 1, hypo, r1, 1 FROM sp UNION ALL SELECT k * 3 + 2, hypo, n2, 0 FROM sp)"""

SENSES = """sense AS (SELECT DISTINCT lemma, CASE WHEN p_partkey % 5 = 4 THEN 'v' ELSE 'n' END AS pos, 'part.' || p_partkey AS synset, p_partkey AS rank
  FROM (SELECT p_partkey, unnest(list_concat([replace(lower(p_name), ' ', '_')], string_split(lower(p_name), ' '))) AS lemma FROM part))"""

VECTORS = """nm AS (SELECT replace(lower(p_name), ' ', '_') AS name, min(p_partkey) AS k FROM part GROUP BY 1),
kv AS (SELECT coalesce(name, 'v' || vec_id) AS key, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings LEFT JOIN (SELECT * FROM nm WHERE k % 3 = 0) ON vec_id = k)"""


def tokens(name: str = "documents") -> str:
    src = "SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations" if name == "conversations" else f"SELECT doc_id, text FROM {name}"
    return f"""tk AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM ({src}))"""


def cooc(name: str = "conversations", least: int = 5, first: int = 5, last: int = 19) -> str:
    return (
        tokens(name)
        + f""", ch AS (SELECT doc_id, s AS start, list_slice(ws, s + 1, s + 200) AS t FROM tk, unnest(range(0, len(ws), 100)) AS r(s) WHERE len(list_slice(ws, s + 1, s + 200)) > 20),
pos AS (SELECT doc_id, start, unnest(t) AS w, unnest(range(len(t))) AS p FROM ch),
voc AS (SELECT w, count(*) AS cnt FROM pos GROUP BY w HAVING count(*) >= {least}),
vp AS (SELECT pos.* FROM pos SEMI JOIN voc ON pos.w = voc.w),
fwd AS (SELECT a.w AS w1, b.w AS w2, count(*) AS c FROM vp a JOIN vp b ON a.doc_id = b.doc_id AND a.start = b.start AND b.p - a.p BETWEEN {first} AND {last} GROUP BY 1, 2),
x AS (SELECT w1, w2, CAST(2 * sum(c) AS BIGINT) AS x FROM (SELECT w1, w2, c FROM fwd UNION ALL SELECT w2, w1, c FROM fwd) GROUP BY 1, 2),
rs AS (SELECT w1 AS w, CAST(sum(x) AS BIGINT) AS r FROM x GROUP BY 1),
tot AS (SELECT CAST(sum(x) AS BIGINT) AS t FROM x)"""
    )
