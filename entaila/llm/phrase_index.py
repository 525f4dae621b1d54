"""Benchmark decontamination on a distributed positional inverted index.

`build_index` reads the corpus once, cuts it into segments and stores, for every
segment, the lexicon and the sorted positions of each of its terms; segments are
rows of a table in the shared folder, so building and searching move no postings
between tasks.  A term is a 64-bit hash of its word.  `search` takes, for every
phrase, its terms from the rarest in the segment to the commonest and intersects
their position lists, each shifted by the term's offset; `near` counts places of two
words within a distance.

The phrases are searched in blocks of at most about `BLOCK_WORDS` words, which
bounds what is broadcast, all on the one index; a longer item is cut with an
overlap, so that each of its windows is in one block.

Words: A-Z lower-cased, runs of digits, letters and bytes over 0x7F.  Null and
empty texts have no words and no hits; items without words match nothing, and an
item_id of null is reported as the string `null`.  Items that repeat an id are
reported once.  Every document row is returned, repeated ones too: rows are told
apart by segment and place, at any number of blocks, so that spans and items of
rows that repeat an id stay with their own text.  A text of any length is one
document of its segment.  Empty tables give no
rows or no hits; other columns, of any names, are not read.  Documents in a
segment lie `GAP` places apart, so no phrase crosses documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, map_texts, ragged, shared_dir, stored, table
from .hashing import prefix_sums, spans_hash

WINDOW = 10
#: Free places between documents; also the longest phrase and distance.
GAP = 64
#: Words of items whose windows are broadcast at once; more are searched block by block.
BLOCK_WORDS = 200_000
#: Segments, each of some MB, that a file of the index and a batch sent to Python have at most.
FILE_SEGMENTS, BATCH_SEGMENTS = 8, 2

_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


def term(word: bytes) -> int:
    """The term of a word (lower case)."""
    sums = prefix_sums(np.frombuffer(word, np.uint8))
    return int(spans_hash(sums, np.array([0]), np.array([len(word)])).view(np.int64)[0])


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, words of each text): the words of all texts in order."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_TO) + b" ", np.uint8)
    letter = np.concatenate([[False], data != 32])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    begin, end = edge[::2], edge[1::2]
    stop = np.cumsum([len(r) + 1 for r in raw])
    n = np.diff(np.searchsorted(begin, stop), prepend=0)
    return spans_hash(prefix_sums(data), begin, end).view(np.int64), n


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (segment, docs, n_words, base, terms, counts, positions) of the corpus; terms are in order.

    A segment's number is that of the task that wrote it and a count; it is stored, so
    it tells rows apart that are equal in everything else.  Files have few segments: Parquet's
    writer holds 100 rows before it looks at their size, and a reader as many as a file has.
    """

    def make():
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def kernel(ids, texts):
            term, n = terms_of(texts)
            base = np.cumsum(n + GAP) - (n + GAP)
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            return {"segment": [next(number)], "docs": [ids], "n_words": [n.tolist()], "base": [base.tolist()], "terms": [terms.tolist()], "counts": [counts.tolist()], "positions": [_pack(ragged(base, n)[order], counts)]}

        return kernel

    return stored(map_texts(df, id_col, text_col, make, f"segment long, docs array<{dict(df.dtypes)[id_col]}>, n_words array<int>, base array<long>, terms array<long>, counts array<int>, positions binary"), FILE_SEGMENTS)


def _pack(pos: np.ndarray, counts: np.ndarray) -> bytes:
    """First position of each term, then steps; small numbers, which the column's codec packs."""
    steps = np.diff(pos, prepend=0)
    starts = np.cumsum(counts) - counts
    if len(pos):
        steps[starts] = pos[starts]
    return steps.astype(np.int32).tobytes()


def _unpack(raw: bytes, counts: np.ndarray) -> np.ndarray:
    steps = np.frombuffer(raw, np.int32).astype(np.int64)
    total = np.cumsum(steps)
    starts = np.cumsum(counts) - counts
    return total - np.repeat(total[starts] - steps[starts], counts) if len(steps) else total


class Phrases:
    """The distinct windows of the items, each with the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WINDOW):
        self.item_ids = [i for i, _ in items]
        code = {w: term(w) for _, ws in items for w in ws}
        owners: dict[tuple[int, ...], set[int]] = {}
        for k, (_, ws) in enumerate(items):
            ids = [code[w] for w in ws]
            for a in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[a : a + width]), set()).add(k)
        self.windows = list(owners)
        self.owner_lists = [sorted(owners[w]) for w in self.windows]
        self.terms = np.unique(np.array(list(code.values()), np.int64))

    def plan(self) -> dict:
        """Arrays for the tasks: terms and places of each window (-1 behind its end), and owners."""
        width = max(map(len, self.windows), default=0)
        terms, offs = np.zeros((len(self.windows), width), np.int64), np.full((len(self.windows), width), -1, np.int64)
        for row, w in enumerate(self.windows):
            terms[row, : len(w)], offs[row, : len(w)] = w, range(len(w))
        return {
            "terms": terms, "offs": offs, "len": np.array([len(w) for w in self.windows], np.int64),
            "own_n": np.array([len(o) for o in self.owner_lists], np.int64), "own": np.array([x for o in self.owner_lists for x in o], np.int64), "items": self.item_ids,
        }


def intersect(terms: np.ndarray, counts: np.ndarray, pos: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence in one segment.

    Windows with a term that the segment lacks are left out at once.  The terms of
    each other window are taken from the rarest in the segment to the commonest: the
    postings of the first give the candidate starts; every further term keeps those
    whose shifted position is in its own list.
    """
    if not len(terms) or not len(plan["terms"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    local = np.minimum(np.searchsorted(terms, plan["terms"]), len(terms) - 1)  # the term's place in the segment
    here = np.flatnonzero(((terms[local] == plan["terms"]) | (plan["offs"] < 0)).all(1))
    local, offs = local[here], plan["offs"][here]
    order = np.argsort(np.where(offs < 0, np.iinfo(np.int64).max, counts[local]), axis=1, kind="stable")
    local, offs = np.take_along_axis(local, order, 1), np.take_along_axis(offs, order, 1)
    starts = np.cumsum(counts) - counts
    postings = (np.repeat(np.arange(len(terms)), counts) << 40) + pos
    rare = local[:, 0]
    n = counts[rare]
    win = np.repeat(np.arange(len(here)), n)
    begin = pos[ragged(starts[rare], n)] - offs[win, 0]
    for r in range(1, offs.shape[1]):
        off = offs[win, r]
        want = (local[win, r] << 40) + begin + off
        at = np.minimum(np.searchsorted(postings, want), len(postings) - 1)
        ok = (postings[at] == want) | (off < 0)
        win, begin = win[ok], begin[ok]
    return here[win], begin


def _segment(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """(base, terms, counts, positions) of a segment's row."""
    base, terms, counts = (batch.column(c)[row].values.to_numpy() for c in ("base", "terms", "counts"))
    counts = counts.astype(np.int64)
    return base, terms, counts, _unpack(batch.column("positions")[row].as_buffer(), counts)


def search(index: DataFrame, phrases: Phrases, path: str) -> None:
    """Writes (segment, row, spans, item_ids) of the documents with hits to a folder.

    A row is a document's place in its segment; spans: (begin, end) of runs of hit words.
    """
    ddl = "segment long, row long, spans array<struct<begin: long, end: long>>, item_ids array<string>"
    schema = arrow_schema(ddl)
    p_shared = index.sparkSession.sparkContext.broadcast(phrases.plan())

    def run(batches):
        p = p_shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                base, terms, counts, pos = _segment(batch, row)
                win, begin = intersect(terms, counts, pos, p)
                if not len(win):
                    continue
                order = np.argsort(begin, kind="stable")
                first, far = begin[order], np.maximum.accumulate((begin + p["len"][win])[order])
                new = np.flatnonzero(np.append(True, first[1:] > far[:-1]))
                lo, hi = first[new], far[np.append(new[1:], len(far)) - 1]
                doc = np.searchsorted(base, begin, "right") - 1
                at = np.searchsorted(base, lo, "right") - 1  # runs do not cross documents, which lie apart
                begin_of = np.cumsum(p["own_n"]) - p["own_n"]
                owner = p["own"][ragged(begin_of[win], p["own_n"][win])]
                pair = np.unique(np.repeat(doc, p["own_n"][win]) * len(p["items"]) + owner)
                hit = np.unique(doc)
                spans: dict[int, list] = {d: [] for d in hit.tolist()}
                for d, x, y in zip(at.tolist(), (lo - base[at]).tolist(), (hi - base[at]).tolist(), strict=True):
                    spans[d].append({"begin": x, "end": y})
                items: dict[int, set] = {d: set() for d in spans}
                for x in pair.tolist():
                    items[x // len(p["items"])].add(p["items"][x % len(p["items"])])
                number = batch.column("segment")[row].as_py()
                cols = [[number] * len(hit), hit, list(spans.values()), [sorted(items[d]) for d in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], names=schema.names)

    with batch_rows(index.sparkSession, BATCH_SEGMENTS):
        index.select("segment", "base", "terms", "counts", "positions").mapInArrow(run, ddl).write.mode("append").parquet(path)
    p_shared.destroy()


def near(index: DataFrame, first: str, second: str, distance: int, id_col: str = "doc_id") -> DataFrame:
    """(id, pairs): pairs of places of two words at most `distance` words apart, in any order."""
    if not 0 < distance <= GAP:
        raise ValueError(f"distance must be 1 to {GAP}")
    two = [words(w) for w in (first, second)]
    if any(len(w) != 1 for w in two):
        raise ValueError("first and second must be one word each")
    ends_of = [term(w[0]) for w in two]
    ddl = f"`{id_col}` {dict(index.dtypes)['docs'][6:-1]}, pairs long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                base, terms, counts, pos = _segment(batch, row)
                docs = batch.column("docs")[row].values
                starts = np.cumsum(counts) - counts
                lists = []
                for t in ends_of:
                    k = int(np.searchsorted(terms, t))
                    lists.append(pos[starts[k] : starts[k] + counts[k]] if k < len(terms) and terms[k] == t else pos[:0])
                a, b = lists
                n = np.searchsorted(b, a + distance, "right") - np.searchsorted(b, a - distance, "left") - (1 if ends_of[0] == ends_of[1] else 0)
                doc = np.searchsorted(base, a, "right") - 1
                total = np.bincount(doc, n, minlength=len(docs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([docs.cast(schema[0].type), pa.array(total, schema[1].type)], names=schema.names)

    with batch_rows(index.sparkSession, BATCH_SEGMENTS):
        return stored(index.select("docs", "base", "terms", "counts", "positions").mapInArrow(run, ddl))


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of at most about `BLOCK_WORDS` words."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator()
    block, size, made = [], 0, False
    for r in rows:
        ws = words(r["t"])
        for a in range(0, max(1, len(ws) - WINDOW + 1), BLOCK_WORDS):
            piece = ws[a : a + BLOCK_WORDS + WINDOW - 1]
            if block and size + len(piece) > BLOCK_WORDS:
                yield Phrases(block)
                block, size, made = [], 0, True
            block.append((r["i"], piece))
            size += len(piece)
    if block or not made:
        yield Phrases(block)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, item_ids) of every document row against all items.

    One index serves all blocks of items: a block reads it once, writes its hits and
    gives back its broadcast.  Hits of all blocks are united by segment and row.
    """
    index, path = build_index(docs, id_col, text_col), shared_dir(docs.sparkSession)
    for phrases in item_blocks(items, item_col, item_text_col):
        search(index, phrases, path)
    hits = docs.sparkSession.read.schema("segment long, row long, spans array<struct<begin: long, end: long>>, item_ids array<string>").parquet(path)
    hits = hits.groupBy("segment", "row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("far"))
    fold = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(s["far"], x["begin"]), F.lit(0))).alias("n"), F.greatest(s["far"], x["end"]).alias("far"))
    found = hits.select("segment", "row", F.aggregate("spans", start, fold)["n"].alias("n_hit"), "item_ids")
    rows = index.select("segment", F.posexplode(F.arrays_zip("docs", "n_words")).alias("row", "d")).select("segment", F.col("row").cast("long").alias("row"), F.col("d.docs").alias("_id"), F.col("d.n_words").cast("long").alias("n_words"))
    all_rows = rows.join(found.hint("merge"), ["segment", "row"], "left")
    return all_rows.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits = decontaminate(docs, items)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words and distance of the query `proximity`.
NEAR_WORDS, NEAR_WITHIN = ("the", "that"), 5


def proximity(spark, sf_dir: str) -> DataFrame:
    """Pairs of places of the two words at most `NEAR_WITHIN` apart, for every document."""
    return near(build_index(table(spark, sf_dir, "documents")), *NEAR_WORDS, NEAR_WITHIN)


#: DuckDB SQL for the rows of `proximity`.
PROXIMITY_ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
n AS (SELECT a.doc_id, count(*) AS pairs FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.p - b.p) <= {NEAR_WITHIN} WHERE a.w = '{NEAR_WORDS[0]}' AND b.w = '{NEAR_WORDS[1]}' GROUP BY 1)
SELECT doc_id, coalesce(pairs, 0)::BIGINT AS pairs FROM d LEFT JOIN n USING (doc_id)
"""


#: DuckDB SQL for the rows of `query`.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w) AS n_item, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS p FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, ks.k, i, list_slice(w, i, i + ks.k - 1) AS p FROM d, ks, unnest(range(1, len(w) - ks.k + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, pos.k FROM pos JOIN win ON win.k = pos.k AND win.p = pos.p),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
