"""Queries over text: cleaning, chunks, vocabularies, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded, without_markup
from ..functions.storage import cut
from ..operators import cooc, packed, text
from ..sources.tables import corpus, table
from . import sql
from .registry import query


def _chunks(spark: SparkSession, d: str, name: str) -> DataFrame:
    return text.chunked(text.tokenised(corpus(spark, d, name)))


def _number_counts(spark: SparkSession, d: str, name: str = "conversations", least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts of word numbers, and the words; a text's words are numbered once, before it is cut into chunks."""
    tokens = text.tokenised(corpus(spark, d, name))
    known = cooc.numbered_words(text.vocabulary(text.chunked(tokens), least))
    return cut(cooc.number_counts(text.chunked(cooc.encoded(tokens, known)))), known  # both are read several times


def _counts(spark: SparkSession, d: str, name: str = "conversations", least: int = 5) -> tuple[DataFrame, DataFrame]:
    x, known = _number_counts(spark, d, name, least)
    return cooc.named(x, known), known.select("word", "cnt")


def _sql_in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\[\[([^\]|]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g'), '\{\{[^}]+\}\}', ' ', 'g'), '&[a-z]+;', ' ', 'g')) AS cleaned FROM pages""")
def clean_markup(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(without_markup("html")).alias("cleaned"))


@query(f"WITH {sql.tokens()} SELECT word, count(*) AS cnt FROM (SELECT unnest(ws) AS word FROM tk) GROUP BY word")
def token_counts(spark, d):
    return text.word_counts(text.tokenised(corpus(spark, d)))


@query(f"WITH {sql.tokens()}, ch AS (SELECT doc_id, s AS start, list_slice(ws, s + 1, s + 200) AS t FROM tk, unnest(range(0, len(ws), 100)) AS r(s)) SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(len(t) AS BIGINT) AS n_words, md5(array_to_string(t, ' ')) AS words FROM ch WHERE len(t) > 20")
def chunks(spark, d):
    return _chunks(spark, d, "documents").select("doc_id", F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("n_words"), F.md5(F.concat_ws(" ", "tokens")).alias("words"))


@query(f"WITH {sql.cooc('documents', 10)} SELECT w AS word, cnt, row_number() OVER (ORDER BY w) - 1 AS idx FROM voc")
def vocab_index(spark, d):
    return text.numbered(text.vocabulary(_chunks(spark, d, "documents"), 10), "word")


@query(f"WITH {sql.cooc('documents', 5)}, b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) AS lemma FROM benchmark) SELECT w AS word, cnt FROM voc SEMI JOIN b ON w = lemma")
def vocab_projection(spark, d):
    known = text.word_counts(text.tokenised(table(spark, d, "benchmark"), id_col="item_id")).select(F.col("word").alias("lemma"))
    return text.projected(text.vocabulary(_chunks(spark, d, "documents")), known)


@query(f"WITH {sql.tokens()} SELECT word, count(*) AS cnt FROM (SELECT unnest(ws) AS word FROM tk) WHERE word NOT IN ({_sql_in(cooc.STOPWORDS + cooc.JUNK)}) GROUP BY word")
def stopword_filter(spark, d):
    return text.without_words(text.word_counts(text.tokenised(corpus(spark, d))), cooc.STOPWORDS + cooc.JUNK)


@query(f"WITH {sql.cooc('documents', 10)} SELECT w1, w2, x FROM x")
def cooc_window(spark, d):
    tokens = text.tokenised(corpus(spark, d))
    known = cooc.numbered_words(text.vocabulary(text.chunked(tokens), 10))
    return cooc.named(cooc.text_counts(cooc.encoded(tokens, known)), known)


@query(f"WITH {sql.cooc()} SELECT w1, w2, x FROM x")
def cooc_band_join(spark, d):
    chunks = _chunks(spark, d, "conversations")
    return cooc.band_join_counts(chunks, text.vocabulary(chunks))


@query(f"WITH {sql.cooc()} SELECT w1, w2, x FROM x")
def cooc_upsert_merge(spark, d):
    """Counts of one half of the turns, stored packed, and those of the other merged into them."""
    tokens = text.tokenised(corpus(spark, d, "conversations"))
    known = cooc.numbered_words(text.vocabulary(text.chunked(tokens)))
    chunks = text.chunked(cut(cooc.encoded(tokens, known)))
    stored, new = (packed.packed_counts(chunks.filter(F.col("doc_id") % 2 == k)) for k in (0, 1))
    return cooc.named(cooc.merged_packed(cut(stored), new), known)


@query(f"WITH {sql.cooc()} SELECT w, r, t FROM rs, tot")
def cooc_marginals(spark, d):
    x, _ = _counts(spark, d)
    return cooc.marginals(x).crossJoin(F.broadcast(cooc.total(x)))


_PMI = "ln((x * t::DOUBLE + 1e-12) / (a.r::DOUBLE * b.r + 1e-12))"
_JOIN = "x JOIN rs a ON a.w = w1 JOIN rs b ON b.w = w2, tot"


@query(f"WITH {sql.cooc()} SELECT w1, w2, round(greatest({_PMI}, 0), 6) + 0.0 AS ppmi FROM {_JOIN}")
def ppmi(spark, d):
    x, known = _number_counts(spark, d)
    return cooc.named(cooc.ppmi(x, i="i", j="j", symmetric=True), known).withColumn("ppmi", rounded("ppmi"))


@query(f"WITH {sql.cooc()} SELECT w1, w2, round({_PMI}, 6) AS x FROM {_JOIN} WHERE {_PMI} > 0")
def ppmi_positive(spark, d):
    x, known = _number_counts(spark, d)
    return cooc.named(cooc.positive(x, None, "i", "j", "x", True), known).withColumn("x", rounded("x"))


@query(f"WITH {sql.cooc()} SELECT w1, w2, round(greatest({_PMI} - ln(5), 0), 6) + 0.0 AS ppmi FROM {_JOIN}")
def shifted_ppmi(spark, d):
    x, known = _number_counts(spark, d)
    return cooc.named(cooc.ppmi(x, 5.0, "i", "j", symmetric=True), known).withColumn("ppmi", rounded("ppmi"))


@query(f"""WITH {sql.cooc('documents', 10)}, p AS (SELECT w1, w2, round(greatest({_PMI}, 0), 6) AS v FROM {_JOIN}),
n AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY v DESC, w2) AS n FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY v DESC, w2) AS rank FROM n WHERE n <= 500 AND v > 0 AND w1 <> w2 AND length(w2) >= 2 AND w2 NOT IN ({_sql_in(cooc.JUNK + cooc.STOPWORDS)}))
SELECT w1, rank, w2, v AS value, cnt AS freq FROM f JOIN voc ON voc.w = w2 WHERE rank <= 10""")
def topk_associates(spark, d):
    """The ten best partners of every word of the corpus by PPMI."""
    tokens = text.tokenised(corpus(spark, d))
    known = cooc.numbered_words(text.vocabulary(text.chunked(tokens), 10))
    return cooc.best_associates(cut(cooc.encoded(tokens, known)), known, cuts=cooc.CUTS)


_PAIRS = """q AS (SELECT DISTINCT w1, w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i, list_extract(ws, i::INT) AS w1, list_extract(ws, i::INT + 1) AS w2 FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM benchmark) WHERE len(ws) > 1))"""


def _query_pairs(spark, d):
    """Neighbouring words of the benchmark."""
    t = text.tokenised(table(spark, d, "benchmark"), id_col="item_id").filter(F.size("tokens") > 1)
    return t.select(F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b"))).alias("p")).select(F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).distinct()


@query(f"WITH {sql.cooc()}, {_PAIRS} SELECT w1, w2, coalesce(x, 0) AS freq FROM q LEFT JOIN x USING (w1, w2)")
def pair_frequency(spark, d):
    return cooc.pair_counts(_query_pairs(spark, d), _counts(spark, d)[0])


@query(f"""WITH {sql.cooc()}, {_PAIRS}, j AS (SELECT q.*, x, r, t, a.w IS NOT NULL AND b.w IS NOT NULL AS ok FROM q LEFT JOIN x USING (w1, w2) LEFT JOIN voc a ON a.w = w1 LEFT JOIN voc b ON b.w = w2 LEFT JOIN rs ON rs.w = w1, tot)
SELECT w1, w2, CASE WHEN ok THEN coalesce(x, 0) END AS freq, CASE WHEN ok THEN round(coalesce(x, 0) / t, 9) END AS joint, CASE WHEN ok THEN round(CASE WHEN coalesce(r, 0) = 0 THEN 0.0 ELSE coalesce(x, 0) / r END, 9) END AS cond FROM j""")
def pair_probabilities(spark, d):
    x, vocab = _counts(spark, d)
    return cooc.pair_probabilities(_query_pairs(spark, d), x, vocab).withColumns({c: rounded(c, 9) for c in ("joint", "cond")})
