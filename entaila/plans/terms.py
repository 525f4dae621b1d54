"""Queries that resolve terms to senses, words and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ball_distance, key_ladder as ladder_of, norm_lemma as norm, rounded
from ..functions.storage import cut
from ..operators import cooc, graph, hierarchy, resolve
from ..sources.tables import edges, senses, table
from . import sql
from .corpus import _counts
from .registry import query


def _specs(spark, d):
    """Part names in capitals with a hyphen, and their last words with a word that nothing has."""
    p = table(spark, d, "part")
    return p.select(F.upper(F.translate("p_name", " ", "-")).alias("spec")).union(p.select(F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" Thing")))).distinct()


_SPECS = "spec AS (SELECT upper(replace(p_name, ' ', '-')) AS spec FROM part UNION SELECT split_part(p_name, ' ', -1) || ' Thing' FROM part)"
_CAND = f"""{sql.SENSES}, {_SPECS}, sl AS (SELECT spec, replace(regexp_replace(lower(trim(spec)), '\\s+', '_', 'g'), '-', '_') AS lm FROM spec),
tr AS (SELECT spec, 1 AS stage, 0 AS sub, lm AS lemma FROM sl UNION ALL SELECT spec, 2, 0, split_part(lm, '_', 1) FROM sl WHERE contains(lm, '_') UNION ALL SELECT spec, 2, 1, split_part(lm, '_', -1) FROM sl WHERE contains(lm, '_')),
ht AS (SELECT *, min(stage) OVER (PARTITION BY spec) AS f FROM tr JOIN sense USING (lemma)),
cd AS (SELECT spec, synset, row_number() OVER (PARTITION BY spec ORDER BY o, synset) AS ord FROM (SELECT spec, synset, min((sub, rank)) AS o FROM ht WHERE stage = f AND pos = 'n' GROUP BY spec, synset))"""


@query("SELECT p_partkey, replace(regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g'), '-', '_') AS lemma, regexp_matches('part.' || p_name || '.' || p_partkey, '^[^.]*(\\.[^.]*)+\\.[0-9]+$') AS is_id, regexp_matches(p_brand, '^[^.]*(\\.[^.]*)+\\.[0-9]+$') AS brand_is_id FROM part")
def norm_lemma(spark, d):
    from ..functions.columns import is_synset_id

    p = table(spark, d, "part")
    return p.select("p_partkey", norm(F.col("p_name")).alias("lemma"), is_synset_id(F.concat(F.lit("part."), "p_name", F.lit("."), F.col("p_partkey").cast("string"))).alias("is_id"), is_synset_id("p_brand").alias("brand_is_id"))


@query(f"WITH {_CAND} SELECT spec, synset, ord FROM cd")
def sense_candidates(spark, d):
    return resolve.candidates(_specs(spark, d), senses(spark, d))


_UNION = f"""{sql.SENSES}, {_SPECS}, uw AS (SELECT spec, lower(trim(spec)) AS low, list_filter(regexp_split_to_array(lower(trim(spec)), '[\\s_]+'), lambda t: t <> '') AS w FROM spec),
uv AS (SELECT spec, 0 AS variant, low AS lemma FROM uw UNION ALL SELECT spec, 1, array_to_string(w, '_') FROM uw UNION ALL SELECT spec, 2, w[1] FROM uw UNION ALL SELECT spec, 3, w[len(w)] FROM uw),
un AS (SELECT spec, synset, row_number() OVER (PARTITION BY spec ORDER BY o, synset) AS ord FROM (SELECT spec, synset, min((variant, rank)) AS o FROM uv JOIN sense USING (lemma) WHERE pos = 'n' GROUP BY spec, synset))"""


@query(f"WITH {_UNION} SELECT * FROM un WHERE ord <= 5")
def sense_union(spark, d):
    return resolve.first_senses(_specs(spark, d), senses(spark, d))


# -- pairs of terms: part names against types -------------------------------------
#: Types are broadcast up to this number; more of them meet the names by blocks.
TYPES = 10_000


def _name_pairs(spark, d):
    """(pair_id, hypo, hyper): every part name with every type."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("hypo"), F.col("p_type").alias("t")).agg(F.min("p_partkey").alias("k"))
    types = p.select(F.concat(F.lit("type"), F.lower("t")).alias("hyper")).distinct()
    names = p.select("hypo").distinct()
    few = types.limit(TYPES + 1).count() <= TYPES
    return names.crossJoin(F.broadcast(types) if few else types).select(F.concat_ws("|", "hypo", "hyper").alias("pair_id"), "hypo", "hyper")


def _all_senses(spark, d):
    p = table(spark, d, "part")
    kinds = p.select(F.concat(F.lit("type"), F.lower("p_type")).alias("lemma"), F.lit("n").alias("pos"), F.concat(F.lit("type."), "p_type").alias("synset"), F.lit(0).cast("long").alias("rank")).distinct()
    return senses(spark, d).unionByName(kinds)


def _lemmas(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("synset"), F.translate(F.lower("p_name"), " ", "_").alias("lemma"))


_NP = f"""{sql.SENSES}, asn AS (SELECT * FROM sense UNION ALL SELECT DISTINCT 'type' || lower(p_type), 'n', 'type.' || p_type, 0 FROM part),
np AS (SELECT n.p_name || '|type' || lower(t.p_type) AS pair_id, n.p_name AS hypo, t.p_type AS kind FROM (SELECT DISTINCT p_name FROM part) n, (SELECT DISTINCT p_type FROM part) t),
hs AS (SELECT p_name AS hypo, synset, row_number() OVER (PARTITION BY p_name ORDER BY rank) AS o, lemma FROM (SELECT p_name, synset, rank, lemma, pos, bool_or(pos = 'n') OVER (PARTITION BY p_name) AS noun FROM (SELECT DISTINCT p_name FROM part) JOIN sense ON lemma = replace(lower(p_name), ' ', '_')) WHERE pos = 'n' OR NOT noun),
cr AS (SELECT pair_id, hypo, synset AS hypo_syn, 'type.' || kind AS hyper_syn, o, p_type = kind AS inside FROM np JOIN hs USING (hypo) JOIN part ON 'part.' || p_partkey = synset)"""


@query(f"""WITH {_NP}, t AS (SELECT *, max(inside::INT) OVER (PARTITION BY pair_id) AS any_in FROM cr)
SELECT pair_id, arg_min(hypo_syn, o) AS hypo_syn, arg_min(hyper_syn, o) AS hyper_syn FROM t WHERE inside::INT = any_in GROUP BY pair_id""")
def resolve_pairs(spark, d):
    e = edges(spark, d)
    path = hierarchy.dag(e)
    reach = cut(hierarchy.ancestors(path))
    up = reach.filter("d > 0").select(F.col("node").alias("src"), F.col("a").alias("dst"), "d")
    return resolve.resolve_pairs(_name_pairs(spark, d), _all_senses(spark, d), _lemmas(spark, d), up, lambda p: hierarchy.wu_palmer(p, path, reach=reach))


@query(f"""WITH {_NP}, uw AS (SELECT DISTINCT p_name AS spec, lower(trim(p_name)) AS low, list_filter(regexp_split_to_array(lower(trim(p_name)), '[\\s_]+'), lambda t: t <> '') AS w FROM part),
uv AS (SELECT spec, 0 AS variant, low AS lemma FROM uw UNION ALL SELECT spec, 1, array_to_string(w, '_') FROM uw UNION ALL SELECT spec, 2, w[1] FROM uw UNION ALL SELECT spec, 3, w[len(w)] FROM uw),
un AS (SELECT * FROM (SELECT spec, synset, row_number() OVER (PARTITION BY spec ORDER BY s, synset) AS o FROM (SELECT spec, synset, min((variant, rank)) AS s FROM uv JOIN sense USING (lemma) WHERE pos = 'n' GROUP BY spec, synset)) WHERE o <= 5),
f AS (SELECT pair_id, min((1, o, synset, 'type.' || kind)) AS x FROM np JOIN un ON spec = hypo JOIN part ON 'part.' || p_partkey = synset WHERE p_type = kind GROUP BY pair_id)
SELECT np.pair_id, x IS NOT NULL AS closure, CASE WHEN x IS NOT NULL THEN 1::BIGINT END AS path_len, x[3] AS hypo_syn, x[4] AS hyper_syn FROM np LEFT JOIN f USING (pair_id)""")
def best_path(spark, d):
    return resolve.best_path(_name_pairs(spark, d), _all_senses(spark, d), hierarchy.ancestors(hierarchy.dag(edges(spark, d))))


# -- words ---------------------------------------------------------------------------
_BW = """bw AS (SELECT item_id AS pair_id, list_slice(ws, 1, 4) AS h, list_slice(ws, 5, 8) AS u FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM benchmark)),
bh AS (SELECT pair_id, unnest(h) AS w1, unnest(range(len(h))) AS o1 FROM bw), bu AS (SELECT pair_id, unnest(u) AS w2, unnest(range(len(u))) AS o2 FROM bw)"""


def _word_pairs(spark, d):
    """Words 1-4 and 5-8 of every benchmark item."""
    from ..operators import text

    t = text.tokenised(table(spark, d, "benchmark"), id_col="item_id")
    return t.select(F.col("doc_id").alias("pair_id"), F.slice("tokens", 1, 4).alias("hypo_words"), F.slice("tokens", 5, 4).alias("hyper_words"))


_PICK = f"""WITH {sql.cooc()}, {_BW}, pk AS (SELECT pair_id, min((-coalesce(x, 0), o1, o2, w1, w2)) AS b FROM bh JOIN bu USING (pair_id) SEMI JOIN voc ON voc.w = w1 SEMI JOIN voc v2 ON v2.w = w2 LEFT JOIN x USING (w1, w2) GROUP BY pair_id),
pick AS (SELECT bw.pair_id, b[4] AS w1, b[5] AS w2, -b[1] AS freq FROM bw LEFT JOIN pk USING (pair_id))"""


@query(f"{_PICK} SELECT * FROM pick")
def token_pick(spark, d):
    x, vocab = _counts(spark, d)
    return resolve.pick_pair(_word_pairs(spark, d), x, vocab)


@query(f"""WITH {sql.cooc()}, {_BW}, c AS (SELECT pair_id, 0 AS step, o1 AS o, w1 AS w, u[1] AS banned FROM bh JOIN bw USING (pair_id) UNION ALL SELECT pair_id, 1, o2, w2, u[1] FROM bu JOIN bw USING (pair_id)),
k AS (SELECT pair_id, min((step, -coalesce(r, 0), o, c.w)) AS b FROM c SEMI JOIN voc ON voc.w = c.w LEFT JOIN rs ON rs.w = c.w WHERE c.w <> banned GROUP BY pair_id)
SELECT bw.pair_id AS id, b[4] AS word, b[1]::BIGINT AS step FROM bw LEFT JOIN k USING (pair_id)""")
def single_token_pick(spark, d):
    """A word of the first four, not the fifth; else one of the next four."""
    x, vocab = _counts(spark, d)
    p = _word_pairs(spark, d)
    banned = F.get("hyper_words", F.lit(0)).alias("banned")
    steps = p.select(F.col("pair_id").alias("id"), F.lit(0).alias("step"), F.col("hypo_words").alias("words"), banned).unionByName(p.select(F.col("pair_id").alias("id"), F.lit(1).alias("step"), F.col("hyper_words").alias("words"), banned))
    return resolve.pick_word(steps, cooc.marginals(x), vocab)


# -- vectors -------------------------------------------------------------------------
_KV = """fn AS (SELECT replace(lower(p_name), ' ', '_') AS key, min(p_partkey) AS k FROM part GROUP BY 1), ft AS (SELECT key, min(k) AS k FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS key, p_partkey AS k FROM part) GROUP BY 1),
ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
kv AS (SELECT 'v' || vec_id AS key, vec FROM ev UNION ALL SELECT key, vec FROM fn JOIN ev ON vec_id = k WHERE k % 3 = 0 UNION ALL SELECT key, vec FROM ft JOIN ev ON vec_id = k + 50 WHERE k % 2 = 0),
kd AS (SELECT key, unnest(vec) AS v, unnest(range(len(vec))) AS i FROM kv)"""


def keyed(spark, d):
    """(key, vec): embeddings by number; those of some whole part names and of some single words."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    p = table(spark, d, "part")
    name = p.groupBy(F.translate(F.lower("p_name"), " ", "_").alias("key")).agg(F.min("p_partkey").alias("k"))
    word = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("key"), "p_partkey").groupBy("key").agg(F.min("p_partkey").alias("k"))
    own = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), "vec")
    names = name.filter("k % 3 = 0").join(e, F.col("k") == F.col("vec_id")).select("key", "vec")
    return own.unionByName(names).unionByName(word.filter("k % 2 = 0").join(e, F.col("k") + 50 == F.col("vec_id")).select("key", "vec"))


def _total(df, *cols):
    """Vectors as their size and the sum weighted by place."""
    return df.select(*cols, F.size("vec").cast("long").alias("dim"), rounded(F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)).alias("check"))


_CHECK = "CAST(count(*) AS BIGINT) AS dim, round(sum(v * (i + 1)), 6) + 0.0 AS \"check\""


def _phrases(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("phrase")).union(p.select(F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" Thing")))).union(p.select(F.concat(F.lit("V"), F.col("p_partkey").cast("string")))).union(p.select("p_type")).distinct()


_PHRASES = "ph AS (SELECT p_name AS phrase FROM part UNION SELECT split_part(p_name, ' ', -1) || ' Thing' FROM part UNION SELECT 'V' || p_partkey FROM part UNION SELECT p_type FROM part)"


@query("SELECT p_partkey, array_to_string(list_filter([k[1], CASE WHEN k[2] = k[1] THEN NULL ELSE k[2] END], lambda z: z IS NOT NULL AND z <> ''), '|') AS two, k[3] AS under, k[5] AS plain FROM (SELECT p_partkey, [trim(p_brand), lower(trim(p_brand)), replace(lower(trim(p_name)), ' ', '_'), '', regexp_replace(lower(trim(p_brand)), '[^a-z0-9_\\s]', '', 'g')] AS k FROM part)")
def key_ladder(spark, d):
    """Raw and lower-case keys of the brand, the part name's key with underscores and the brand without signs."""
    p = table(spark, d, "part")
    b, n = ladder_of("p_brand"), ladder_of("p_name")
    return p.select("p_partkey", F.array_join(F.slice(b, 1, 2), "|").alias("two"), F.element_at(F.filter(n, lambda k: k.contains("_")), 1).alias("under"), F.element_at(b, -1).alias("plain"))


@query(f"WITH {_KV}, {_PHRASES}, t AS (SELECT phrase, i, avg(v) AS v FROM (SELECT phrase, unnest(regexp_split_to_array(lower(trim(phrase)), '[\\s_]+')) AS key FROM ph) JOIN kd USING (key) GROUP BY 1, 2) SELECT phrase, {_CHECK} FROM t GROUP BY phrase")
def token_average(spark, d):
    return _total(resolve.token_average(_phrases(spark, d), keyed(spark, d)), "phrase")


@query("SELECT node, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') AS keys FROM (SELECT 'part.' || p_partkey AS node, list_concat(['part.' || p_partkey, replace(lower(p_name), ' ', '_'), lower(p_name)], string_split(lower(p_name), ' ')) AS k FROM part)")
def synset_keys(spark, d):
    p = _lemmas(spark, d).withColumnRenamed("synset", "node")
    return p.select("node", F.array_join(resolve.node_keys(), "|").alias("keys"))


_CHAIN = f"{sql.EDGES}, f AS (SELECT child, min(parent) AS parent FROM edge GROUP BY 1), bc AS (SELECT child AS node, 1 AS step, parent AS anc FROM f UNION ALL SELECT node, step + 1, parent FROM bc JOIN f ON child = anc WHERE step < 6)"


@query(f"WITH RECURSIVE {_CHAIN} SELECT node, CAST(step AS BIGINT) AS step, anc FROM bc")
def backoff_chain(spark, d):
    return resolve.backoff_chain(edges(spark, d))


_CW = f"""WITH RECURSIVE {_CHAIN}, {sql.cooc()}, {_BW}, nw AS (SELECT 'part.' || pair_id AS node, h AS words FROM bw UNION ALL SELECT DISTINCT 'brand.' || p_brand, u FROM part JOIN bw ON pair_id = regexp_extract(p_brand, '(\\d+)', 1)::BIGINT UNION ALL SELECT 'entity', h FROM bw WHERE pair_id = (SELECT min(pair_id) FROM bw)),
st AS (SELECT 'part.' || p_partkey AS id, 0 AS step, coalesce(words, []) AS words FROM part LEFT JOIN nw ON node = 'part.' || p_partkey UNION ALL SELECT bc.node, step, words FROM bc JOIN nw ON nw.node = anc WHERE bc.node LIKE 'part.%' AND step <= 5),
wo AS (SELECT id, step, unnest(words) AS w, unnest(range(len(words))) AS o FROM st),
k AS (SELECT id, min((step, -coalesce(r, 0), o, wo.w)) AS b FROM wo SEMI JOIN voc ON voc.w = wo.w LEFT JOIN rs ON rs.w = wo.w GROUP BY id)"""


@query(f"{_CW} SELECT 'part.' || p_partkey AS id, b[4] AS word, b[1]::BIGINT AS step FROM part LEFT JOIN k ON id = 'part.' || p_partkey")
def chain_token_pick(spark, d):
    """A word of every part, or else of its first parents upwards; parts and brands have words of the benchmark item of their number."""
    x, vocab = _counts(spark, d)
    p, e, w = table(spark, d, "part"), edges(spark, d), cut(_word_pairs(spark, d))
    part = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    brand = p.select("p_brand").distinct().select(F.concat(F.lit("brand."), "p_brand").alias("node"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("pair_id"))
    first = w.orderBy("pair_id").limit(1).select(F.lit("entity").alias("node"), F.col("hypo_words").alias("words"))
    words = brand.join(w, "pair_id").select("node", F.col("hyper_words").alias("words")).unionByName(first)
    own = p.join(w, p["p_partkey"] == w["pair_id"], "left").select(part.alias("id"), F.coalesce("hypo_words", F.array().cast("array<string>")).alias("words"))
    steps = resolve.chain_steps(own, resolve.backoff_chain(e), words)
    return resolve.pick_word(steps.withColumn("banned", F.lit(None).cast("string")), cooc.marginals(x), vocab)


def _nodes(spark, d):
    """(node, lemma): parts by name, types and brands by their own; brands end in the word that types lack."""
    p = table(spark, d, "part")
    kinds = p.select(F.concat(F.lit("brand."), "p_brand").alias("node"), F.concat(F.lit("v"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("lemma")).distinct()
    return _lemmas(spark, d).withColumnRenamed("synset", "node").unionByName(kinds)


_NV = f"""{_KV}, nd AS (SELECT 'part.' || p_partkey AS node, replace(lower(p_name), ' ', '_') AS lemma, 'brand.' || p_brand AS anc FROM part UNION ALL SELECT DISTINCT 'brand.' || p_brand, 'v' || regexp_extract(p_brand, '(\\d+)', 1), NULL FROM part),
tk2 AS (SELECT node, 0 AS step, 1 AS o, lemma AS key FROM nd UNION ALL SELECT node, 0, 3, split_part(lemma, '_', 1) FROM nd UNION ALL SELECT node, 0, 4, split_part(lemma, '_', 2) FROM nd UNION ALL SELECT a.node, 1, 1, b.lemma FROM nd a JOIN nd b ON a.anc = b.node),
nv AS (SELECT node, min((step, o, key)) AS b FROM tk2 SEMI JOIN kv USING (key) GROUP BY node),
nw AS (SELECT nd.node, CASE WHEN b IS NULL THEN 'oov' WHEN b[1] = 0 THEN 'synset_lemma' ELSE 'synset_hypernym_backoff' END AS method, b[3] AS key FROM nd LEFT JOIN nv USING (node))"""


@query(f"WITH {_NV} SELECT node, method, nw.key, {_CHECK} FROM nw JOIN kd ON kd.key = nw.key GROUP BY 1, 2, 3")
def synset_lookup(spark, d):
    v = resolve.node_vectors(_nodes(spark, d), resolve.backoff_chain(edges(spark, d)), keyed(spark, d))
    return _total(v.filter("vec is not null"), "node", "method", "key")


@query(f"""WITH {_NV}, {_PHRASES}, pl AS (SELECT phrase, min((o, key)) AS b FROM (SELECT phrase, 0 AS o, phrase AS key FROM ph UNION ALL SELECT phrase, 1, lower(phrase) FROM ph UNION ALL SELECT phrase, 2, replace(lower(phrase), ' ', '_') FROM ph) SEMI JOIN kv USING (key) GROUP BY phrase),
ta AS (SELECT phrase, i, avg(v) AS v FROM (SELECT phrase, unnest(string_split(lower(phrase), ' ')) AS key FROM ph) JOIN kd USING (key) GROUP BY 1, 2),
fs AS (SELECT phrase, arg_min(node, (o, k)) AS node FROM (SELECT phrase, 1 AS o, p_partkey AS k, 'part.' || p_partkey AS node FROM ph JOIN part ON lower(p_name) = lower(phrase) WHERE p_partkey % 5 <> 4 UNION ALL SELECT phrase, 2, p_partkey, 'part.' || p_partkey FROM ph JOIN part ON list_contains(string_split(lower(p_name), ' '), split_part(lower(phrase), ' ', 1)) WHERE p_partkey % 5 <> 4) GROUP BY phrase),
un AS (SELECT i, avg(v) AS v FROM kd GROUP BY 1),
mt AS (SELECT ph.phrase, CASE WHEN b IS NOT NULL THEN 'direct_key' WHEN ph.phrase IN (SELECT phrase FROM ta) THEN 'token_average_surface' WHEN nw.method = 'synset_lemma' THEN 'wn_lemma' WHEN nw.method = 'synset_hypernym_backoff' THEN 'wn_hypernym_backoff' ELSE 'unk' END AS method, b[2] AS k1, nw.key AS k3 FROM ph LEFT JOIN pl USING (phrase) LEFT JOIN fs USING (phrase) LEFT JOIN nw ON nw.node = fs.node),
al AS (SELECT phrase, method, k1 AS key, i, v FROM mt JOIN kd ON kd.key = k1 WHERE method = 'direct_key' UNION ALL SELECT phrase, method, NULL, i, v FROM mt JOIN ta USING (phrase) WHERE method = 'token_average_surface' UNION ALL SELECT phrase, method, k3, i, v FROM mt JOIN kd ON kd.key = k3 WHERE method LIKE 'wn%' UNION ALL SELECT phrase, method, NULL, i, v FROM mt, un WHERE method = 'unk')
SELECT phrase, method, key, {_CHECK} FROM al GROUP BY 1, 2, 3""")
def oov_ladder(spark, d):
    v = resolve.ladder(_phrases(spark, d), keyed(spark, d), senses(spark, d), _nodes(spark, d), resolve.backoff_chain(edges(spark, d)))
    return _total(v, "phrase", "method", "key")


@query(f"""WITH {_NV}, pt AS (SELECT 'part.' || p_partkey AS key0, unnest(['part.' || p_partkey, 'brand.' || p_brand]) AS node FROM part),
w AS (SELECT key0, method, i, v FROM pt JOIN nw USING (node) JOIN kd ON kd.key = nw.key), a AS (SELECT key0, i, avg(v) AS v FROM w GROUP BY 1, 2), m AS (SELECT key0, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM w GROUP BY 1)
SELECT key0 AS key, methods, {_CHECK} FROM a JOIN m USING (key0) GROUP BY 1, 2""")
def path_mean(spark, d):
    """The mean over every part and its brand."""
    v = resolve.node_vectors(_nodes(spark, d), resolve.backoff_chain(edges(spark, d)), keyed(spark, d))
    node = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    paths = table(spark, d, "part").select(node.alias("key"), F.array(node, F.concat(F.lit("brand."), "p_brand")).alias("path"))
    return _total(resolve.path_means(paths, v.select("node", "method", "vec")), "key", "methods")


_CV = f"""WITH {_NV}, {sql.SENSES}, nm3 AS (SELECT DISTINCT p_name AS hypo FROM part),
pq AS (SELECT hypo, 'type' || lower(t) AS hyper, 'type.' || t AS top FROM nm3, (SELECT DISTINCT p_type AS t FROM part) UNION ALL SELECT hypo, 'entity', 'entity' FROM nm3),
nx AS (SELECT node, method, key FROM nw UNION ALL SELECT DISTINCT 'type.' || p_type, 'synset_lemma', 'v' || length(p_type) FROM part),
vr AS (SELECT hypo, 0 AS variant, lower(hypo) AS lemma FROM nm3 UNION ALL SELECT hypo, 1, replace(lower(hypo), ' ', '_') FROM nm3 UNION ALL SELECT hypo, 2, split_part(lower(hypo), ' ', 1) FROM nm3 UNION ALL SELECT hypo, 3, split_part(lower(hypo), ' ', -1) FROM nm3),
cs AS (SELECT * FROM (SELECT hypo, synset, row_number() OVER (PARTITION BY hypo ORDER BY o, synset) AS ord FROM (SELECT hypo, synset, min((variant, rank)) AS o FROM vr JOIN sense USING (lemma) WHERE pos = 'n' GROUP BY hypo, synset)) WHERE ord <= 5),
cl AS (SELECT hypo, hyper, min((CASE WHEN top = 'entity' THEN 2 ELSE 1 END, ord, synset)) AS x, any_value(top) AS top FROM pq JOIN cs USING (hypo) JOIN part ON 'part.' || p_partkey = synset WHERE top = 'entity' OR top = 'type.' || p_type GROUP BY hypo, hyper),
cp AS (SELECT pq.hypo, pq.hyper, pq.hypo || '|' || pq.hyper AS pair_id, cl.x IS NOT NULL AS closure, x[3] AS hypo_syn, cl.top AS hyper_syn, x[1]::BIGINT AS path_len, 'brand.' || p_brand AS brand FROM pq LEFT JOIN cl USING (hypo, hyper) LEFT JOIN part ON 'part.' || p_partkey = x[3]),
dk AS (SELECT hypo, min((o, key)) AS b FROM (SELECT hypo, 0 AS o, hypo AS key FROM nm3 UNION ALL SELECT hypo, 1, lower(hypo) FROM nm3 UNION ALL SELECT hypo, 2, replace(lower(hypo), ' ', '_') FROM nm3) SEMI JOIN kv USING (key) GROUP BY hypo),
ta AS (SELECT hypo, i, avg(v) AS v FROM (SELECT hypo, unnest(string_split(lower(hypo), ' ')) AS key FROM nm3) JOIN kd USING (key) GROUP BY 1, 2),
sf AS (SELECT nm3.hypo, CASE WHEN b IS NOT NULL THEN 'direct_key' WHEN nm3.hypo IN (SELECT hypo FROM ta) THEN 'token_average_surface' WHEN n.method = 'synset_lemma' THEN 'wn_lemma' WHEN n.method = 'synset_hypernym_backoff' THEN 'wn_hypernym_backoff' ELSE 'unk' END AS method, CASE WHEN b IS NOT NULL THEN b[2] WHEN nm3.hypo NOT IN (SELECT hypo FROM ta) THEN n.key END AS key
  FROM nm3 LEFT JOIN dk USING (hypo) LEFT JOIN cs ON cs.hypo = nm3.hypo AND cs.ord = 1 LEFT JOIN nx n ON n.node = cs.synset),
hm AS (SELECT cp.*, CASE WHEN n.key IS NOT NULL THEN n.method ELSE sf.method END AS m1, coalesce(n.key, sf.key) AS k1, n.key IS NULL AND sf.method = 'token_average_surface' AS avg1,
  CASE WHEN closure AND hyper <> 'entity' THEN 'synset_lemma' WHEN hyper <> 'entity' THEN 'wn_lemma' ELSE 'unk' END AS m2, CASE WHEN hyper <> 'entity' THEN 'v' || (length(hyper) - 4) END AS k2 FROM cp JOIN sf USING (hypo) LEFT JOIN nx n ON n.node = hypo_syn),
v1 AS (SELECT pair_id, i, v FROM hm JOIN kd ON kd.key = k1 WHERE NOT avg1 UNION ALL SELECT pair_id, i, v FROM hm JOIN ta USING (hypo) WHERE avg1),
v2 AS (SELECT pair_id, i, v FROM hm JOIN kd ON kd.key = k2),
fq AS (SELECT pair_id, round(sum(v * (i + 1)), 6) + 0.0 AS f FROM (SELECT pair_id, i, v FROM v1 UNION ALL SELECT pair_id, i + 64, v FROM v2) GROUP BY 1),
wy AS (SELECT pair_id, unnest(CASE WHEN hyper = 'entity' THEN [hypo_syn, brand] ELSE [hypo_syn, hyper_syn] END) AS node FROM cp WHERE closure),
wm AS (SELECT pair_id, i, avg(v) AS v FROM wy JOIN nx USING (node) JOIN kd ON kd.key = nx.key GROUP BY 1, 2),
wf AS (SELECT pair_id, i, sum(v) / 2 AS v FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) WHERE pair_id IN (SELECT pair_id FROM cp WHERE closure) AND pair_id NOT IN (SELECT pair_id FROM wm) GROUP BY 1, 2),
pm AS (SELECT pair_id, round(sum(v * (i + 1)), 6) + 0.0 AS f FROM (SELECT * FROM wm UNION ALL SELECT * FROM wf) GROUP BY 1)
SELECT hm.pair_id, hypo, hyper, closure, hypo_syn, hyper_syn, path_len, CASE WHEN NOT closure THEN NULL WHEN hyper = 'entity' THEN hypo_syn || ' -> ' || brand || ' -> entity' ELSE hypo_syn || ' -> ' || hyper_syn END AS path,
 closure OR m1 <> 'unk' AS vec_hypo, closure OR m2 <> 'unk' AS vec_hyper, closure AS vec_path_mean, m1 AS vec_hypo_method, m2 AS vec_hyper_method, k1 AS vec_hypo_key, k2 AS vec_hyper_key, coalesce(fq.f, 0) AS features, CASE WHEN closure THEN coalesce(pm.f, 0) END AS path_mean
FROM hm LEFT JOIN fq USING (pair_id) LEFT JOIN pm USING (pair_id)"""


@query(_CV)
def closure_vectors(spark, d):
    """Every part name with every type and with the root: closure, way, vectors and how they were found; vectors as sums weighted by place."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_name").alias("hypo")).distinct()
    pairs = cut(_name_pairs(spark, d).unionByName(names.select(F.concat("hypo", F.lit("|entity")).alias("pair_id"), "hypo", F.lit("entity").alias("hyper"))))
    known = _all_senses(spark, d).unionByName(names.sparkSession.range(1).select(F.lit("entity").alias("lemma"), F.lit("n").alias("pos"), F.lit("entity").alias("synset"), F.lit(0).cast("long").alias("rank")))
    nodes = _nodes(spark, d).unionByName(p.select(F.concat(F.lit("type."), "p_type").alias("node"), F.concat(F.lit("v"), F.length("p_type").cast("string")).alias("lemma")).distinct())
    e, kv = edges(spark, d), keyed(spark, d)
    chain = resolve.backoff_chain(e)
    best = cut(resolve.best_path(pairs, known, hierarchy.ancestors(hierarchy.dag(e))))
    sp = graph.shortest_paths(best.filter("closure").select(F.col("hypo_syn").alias("start")).distinct(), e.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    phrases = pairs.select(F.col("hypo").alias("phrase")).union(pairs.select("hyper")).distinct()
    got = resolve.closure_vectors(pairs, best, sp, cut(resolve.node_vectors(nodes, chain, kv)), resolve.ladder(phrases, kv, known, nodes, chain), 64)
    weigh = lambda c: rounded(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x))
    return got.withColumn("features", weigh("features")).withColumn("path_mean", weigh("path_mean"))


@query(f"WITH {_KV} SELECT CAST(i AS BIGINT) AS i, round(avg(v), 6) + 0.0 AS v FROM kd GROUP BY i")
def unknown_vector(spark, d):
    return resolve.unknown_vector(keyed(spark, d)).select(F.posexplode("vec").alias("i", "v")).select(F.col("i").cast("long").alias("i"), rounded("v").alias("v"))


@query("SELECT lemma, arg_min(synset, (t, o)) AS synset FROM (SELECT lower(p_name) AS lemma, CASE WHEN p_partkey % 4 = 0 THEN 'part.' || p_partkey END AS synset, 0 AS t, p_partkey AS o FROM part UNION ALL SELECT lower(p_name), 'part.' || p_partkey, 1, p_partkey FROM part) WHERE synset IS NOT NULL GROUP BY lemma")
def lemma_first_synset(spark, d):
    p = table(spark, d, "part")
    node = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    t = lambda c: p.select(F.lower("p_name").alias("lemma"), c.alias("synset"), F.col("p_partkey").alias("ord"))
    return resolve.first_synsets(t(F.when(F.col("p_partkey") % 4 == 0, node)), t(node))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 0.5) AS u FROM embeddings), p AS (SELECT a.vec_id, a.u, b.u AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, 1 + 2 * list_sum(list_transform(list_zip(u, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / ((1 - list_sum(list_transform(u, lambda x: x * x))) * (1 - list_sum(list_transform(v, lambda x: x * x)))) AS c FROM p)
SELECT vec_id, round(ln(c + sqrt(c * c - 1)), 6) AS distance FROM q""")
def poincare_distance(spark, d):
    """The distance in the unit ball between every embedding (halved) and the next."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 0.5).alias("u"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return e.join(nxt, "vec_id").select("vec_id", rounded(ball_distance(F.col("u"), F.col("v"))).alias("distance"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 0.5) AS u FROM embeddings), p AS (SELECT a.vec_id, a.vec_id % 2 AS label, a.u, b.u AS v FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 3),
q AS (SELECT label, 1 + 2 * list_sum(list_transform(list_zip(u, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / ((1 - list_sum(list_transform(u, lambda x: x * x))) * (1 - list_sum(list_transform(v, lambda x: x * x)))) AS c, v IS NOT NULL AS known FROM p)
SELECT label, count(*) AS pairs, count(*) FILTER (known) AS known, round(avg(ln(c + sqrt(c * c - 1))) FILTER (known), 6) AS mean FROM q GROUP BY label""")
def poincare_groups(spark, d):
    """Mean distances of positive and negative pairs; the last embeddings have no partner and no distance."""
    kv = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double") * 0.5).alias("vec"))
    pairs = kv.select(F.col("key").alias("hypo"), (F.col("key") + 3).alias("hyper"), (F.col("key") % 2).alias("label"))
    got = resolve.ball_distances(pairs, kv)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.count("distance").alias("known"), rounded(F.avg("distance")).alias("mean"))


@query(f"""WITH {_KV}, nm2 AS (SELECT DISTINCT replace(lower(p_name), ' ', '_') AS key FROM part),
pv AS (SELECT key, unnest(range(64)) AS i FROM nm2 WHERE key NOT IN (SELECT key FROM kv)),
pq AS (SELECT key, i, (('0x' || left(md5(key || '|' || i), 7))::BIGINT / 134217728.0::DOUBLE - 1) * 0.1 AS v FROM pv),
al AS (SELECT key, true AS hit, i, v FROM nm2 JOIN kd USING (key) UNION ALL SELECT key, false, i, v FROM pq)
SELECT key, hit, {_CHECK} FROM al GROUP BY 1, 2""")
def pseudo_vectors(spark, d):
    """A vector for every part name: its own, or one that follows from the name."""
    kv = keyed(spark, d)
    names = table(spark, d, "part").select(F.translate(F.lower("p_name"), " ", "_").alias("key")).distinct()
    got = resolve.entity_vectors(names, kv.join(names, "key", "left_semi"), 64)
    return _total(got.join(kv.select("key", F.lit(True).alias("h")), "key", "left").select("key", F.coalesce("h", F.lit(False)).alias("hit"), "vec"), "key", "hit")
