"""Language identification by prediction by partial matching (PPM).

For every language a tree of byte contexts of up to `ORDER` bytes holds the
counts of the next byte.  A byte's code length is taken from the longest known
context: -log2(count / (total + distinct)); a byte not seen there first pays
the escape -log2(distinct / (total + distinct)) and goes on in the next shorter
context, down to a uniform code of 256 values.  As the statistics are frozen,
the code length of every byte seen in a context is worked out once for all
languages, other bytes pay the context's escapes and are looked up in the next
shorter one; a text's exact code length for each language is then a sum of
look-ups, and the shortest wins.

The trees are learnt in one pass from all labelled texts, whole: tasks count
strings of `ORDER` + 1 bytes, and the driver gathers the sums, a row for each
different string of a language.  Contexts seen fewer than `MIN_CONTEXT` times are
left out, and more often seen ones too while the tables would be over
`TABLE_BYTES`; this bounds what is broadcast, for any number of languages.

`accepted` rejects texts in none of the learnt languages.  What they may cost is
learnt from all labelled texts that the trees have not seen (`bound`).

Null texts and texts without a letter are `und` with score 0; so is every text
if nothing is labelled.  Ties go to the language first in order.  The score is
the winner's share of the probability that the languages give to the text.
Very long texts are read whole.
Every row is returned, repeated ones too (they count each in the trees); an
empty table gives none; other columns, of any names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, crc, filter_texts, map_texts, slices, stored

ORDER = 3
MIN_CONTEXT = 4
TABLE_BYTES = 256 << 20
#: Different strings that a task holds before it gives up its counts, at most about.
HELD = 1 << 20
#: Bytes of text whose code lengths are in memory at once, and whose strings are counted at once, unless a single text is longer.
GROUP_BYTES = 1 << 20
UNKNOWN = "und"
#: Bits that tell nothing about the language: a key or a number of 16 random bytes.
FREE_BITS = 128
#: Share of unseen labelled texts below the bound, and the room above it.
COVERED, ROOM = 0.999, 1.1


@dataclass
class Trees:
    """Node 0 is the empty context; child[d] leads from depth d to depth d + 1."""

    langs: list[str]
    classes: np.ndarray  # byte -> class; 0: never seen
    child: list[np.ndarray]
    parent: np.ndarray  # node -> the next shorter context
    cell: np.ndarray  # node * class -> row of `bits_of`, -1: not seen there in any language
    bits_of: np.ndarray  # (row, language): bits
    escape: np.ndarray  # (node, language): bits

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for x in (*self.child, self.parent, self.cell, self.bits_of, self.escape))

    def costs(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(place, language): bits of a byte class after a context."""
        at = self.cell[node * self.width + c]
        if not len(self.bits_of):
            return np.full((len(node), len(self.langs)), 8, np.float32)
        out = self.bits_of[at]  # wrong where at < 0
        left = np.flatnonzero(at < 0)
        out[left] = 0
        node, c = node[left], c[left]
        while len(left):
            out[left] += self.escape[node]
            out[left[node == 0]] += 8
            go = node > 0
            left, node, c = left[go], self.parent[node[go]], c[go]
            at = self.cell[node * self.width + c]
            out[left[at >= 0]] += self.bits_of[at[at >= 0]]
            go = at < 0
            left, node, c = left[go], node[go], c[go]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): exact code lengths; each text's depend on it alone."""
        cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // GROUP_BYTES)) + 1
        return np.concatenate([self._bits(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)])

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        pad = bytes(ORDER)
        data = np.frombuffer(pad + pad.join(texts), np.uint8)
        c = self.classes[data]
        node = np.zeros(len(c) - ORDER, np.int32)
        for d, table in enumerate(self.child):
            node = table.ravel()[node * self.width + c[ORDER - 1 - d : len(c) - 1 - d]]
        vals = self.costs(node, c[ORDER:])
        size = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        start = np.cumsum(size + ORDER) - (size + ORDER)
        edges = np.stack([start[full], start[full] + size[full]], 1).ravel()
        last = edges[-1] >= len(vals)
        out[full] = np.add.reduceat(vals, edges[:-1] if last else edges, axis=0, dtype=np.float64)[::2]
        return out


def ngrams(texts: list[bytes]) -> np.ndarray:
    """Every byte of the texts with the ORDER bytes before it, as one number."""
    pad = bytes(ORDER)
    codes = []
    for t in texts:
        a = np.frombuffer(pad + t, np.uint8).astype(np.int64)
        code = np.zeros(len(t), np.int64)
        for k in range(ORDER + 1):
            code = (code << 8) | a[k : k + len(t)]
        codes.append(code)
    return np.concatenate(codes) if codes else np.zeros(0, np.int64)


def grow(counts: dict[str, tuple[np.ndarray, np.ndarray]], table_bytes: int = TABLE_BYTES) -> Trees:
    """Trees from (ngram codes, counts) by language, within `table_bytes`."""
    least = MIN_CONTEXT
    while (trees := _grow(counts, least)).n_bytes > table_bytes and len(trees.parent) > 1:
        least *= 2
    return trees


def _grow(counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int) -> Trees:
    langs = sorted(counts)
    seen = np.zeros(256, bool)
    for codes, _ in counts.values():
        seen[np.unique(codes & 255)] = True
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, seen.sum() + 1)
    A, L = int(seen.sum()) + 1, len(langs)
    # contexts of each depth, the nearest byte first: those that any language has often enough
    child, depth_nodes, total_nodes = [], [(np.zeros(1, np.int64), np.zeros(1, np.int64))], 1
    parent = [np.zeros(1, np.int32)]
    for d in range(ORDER):
        keys = []
        for codes, n in counts.values():
            ctx, inv = np.unique(_context(codes, d + 1), return_inverse=True)
            keys.append(ctx[np.bincount(inv, n) >= least])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        parents, pids = depth_nodes[-1]
        at = np.minimum(np.searchsorted(parents, keys >> 8), max(len(parents) - 1, 0))
        ok = parents[at] == keys >> 8 if len(parents) else np.zeros(len(keys), bool)
        keys, at = keys[ok], at[ok]
        ids = np.arange(total_nodes, total_nodes + len(keys))
        table = np.repeat(np.arange(total_nodes, dtype=np.int32)[:, None], A, 1)
        table[pids[at], classes[keys & 255]] = ids
        child.append(table)
        parent.append(pids[at].astype(np.int32))
        depth_nodes.append((keys, ids))
        total_nodes += len(keys)
    trees = Trees(langs, classes, child, np.concatenate(parent), np.full(total_nodes * A, -1, np.int32), np.zeros((0, L), np.float32), np.zeros((total_nodes, L), np.float32))
    for d, (keys, ids) in enumerate(depth_nodes):
        met = []  # of each language: places (node, class) seen, their counts
        for lang in langs:
            codes, n = counts[lang]
            ctx = _context(codes, d)
            at = np.minimum(np.searchsorted(keys, ctx), max(len(keys) - 1, 0))
            ok = keys[at] == ctx if len(keys) else np.zeros(len(ctx), bool)
            place, inv = np.unique(ids[at[ok]] * A + classes[codes[ok] & 255] if len(keys) else at[ok], return_inverse=True)
            met.append((place, np.bincount(inv, n[ok], len(place))))
        places = np.unique(np.concatenate([p for p, _ in met])) if met else np.zeros(0, np.int64)
        node, c = places // A, (places % A).astype(np.int32)
        rows = trees.costs(trees.parent[node], c).astype(np.float64) if d else np.full((len(places), L), 8.0)
        for k, (place, n) in enumerate(met):
            total, distinct = np.bincount(place // A, n, total_nodes), np.bincount(place // A, minlength=total_nodes)
            has = np.flatnonzero(total > 0)
            trees.escape[has, k] = -np.log2(distinct[has] / (total[has] + distinct[has]))
            rows[:, k] += trees.escape[node, k]
            rows[np.searchsorted(places, place), k] = -np.log2(n / (total + distinct)[place // A])
        trees.cell[places] = len(trees.bits_of) + np.arange(len(places))
        trees.bits_of = np.concatenate([trees.bits_of, rows.astype(np.float32)])
    return trees


def _context(codes: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` bytes before the last, the nearest byte first and highest."""
    out = np.zeros(len(codes), np.int64)
    for k in range(1, depth + 1):
        out = (out << 8) | ((codes >> (8 * k)) & 255)
    return out


def _labelled(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("txt"), F.col(lang_col).cast("string").alias("lg"))
    return rows.filter("lg is not null and txt is not null")


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of parts of the same kind added up."""
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Trees learnt from all labelled rows of `df`."""
    import pyarrow as pa

    schema = arrow_schema("lg string, code long, n long")

    def run(batches):
        held: dict[str, list] = {}

        def given():
            for lang, parts in sorted(held.items()):
                code, n = added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], schema=schema)
            held.clear()

        for batch in batches:
            for langs, texts in slices(batch.column(0), batch.column(1), GROUP_BYTES):
                for lang in sorted(set(langs)):
                    codes = ngrams([t.encode() for t, g in zip(texts, langs, strict=True) if g == lang]).astype(np.uint32)
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                if sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
                    held.update({lang: [added(parts)] for lang, parts in held.items()})
                    if 2 * sum(len(c) for [(c, _)] in held.values()) > HELD:
                        yield from given()
        yield from given()

    rows = _labelled(df, id_col, text_col, lang_col).select("lg", "txt")
    got = rows.mapInArrow(run, "lg string, code long, n long").groupBy("lg", "code").agg(F.sum("n").alias("n")).toArrow()  # different strings alone
    lang = got.column("lg").combine_chunks().dictionary_encode()
    of, code, n = lang.indices.to_numpy(), got.column("code").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((code, of))
    of, code, n = of[order], code[order], n[order].astype(np.float64)
    cuts = np.searchsorted(of, np.arange(len(lang.dictionary) + 1))
    return grow({name: (code[a:b], n[a:b]) for name, a, b in zip(lang.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True)})


def rate(bits: float, n: int) -> float:
    """Bits a byte beyond the free ones."""
    return max(bits - FREE_BITS, 0.0) / max(n, 1)


#: Cells a bit that `quantile` counts by, and the rate from which all are one cell.
CELLS, FAR = 4096, 16


def quantile(rows: DataFrame, q: float) -> float | None:
    """The q-quantile of `rate`, exact, with interpolation; None without rows.

    Rows are counted by cell, and only the cells with the places asked for are sorted,
    so no task holds all of them.
    """
    at = rows.select("rate", F.floor(F.least("rate", F.lit(FAR)) * CELLS).alias("cell"))
    sizes = sorted(map(tuple, at.groupBy("cell").count().collect()))  # at most CELLS * FAR + 1
    if not sizes:
        return None
    cells, upto = [c for c, _ in sizes], np.cumsum([n for _, n in sizes])
    place = q * (int(upto[-1]) - 1)

    def value(k: int) -> float:
        i = int(np.searchsorted(upto, k, "right"))
        left = k - (int(upto[i - 1]) if i else 0)
        by = at.filter(F.col("cell") == cells[i]).groupBy("rate").agg(F.count(F.lit(1)).alias("n"))
        return by.withColumn("upto", F.sum("n").over(Window.orderBy("rate"))).filter(F.col("upto") > left).agg(F.min("rate").alias("v")).first()["v"]

    low, high = int(np.floor(place)), int(np.ceil(place))
    a = value(low)
    return a if high == low else a + (place - low) * (value(high) - a)


def bound(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The rate up to which a text is in a learnt language, from all labelled rows, which the trees have not seen.

    All but a share of 1 - COVERED of them lie below it, with some room; without such
    rows the rate of a uniform code.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        def kernel(ids, texts):
            raw = [x.encode() for x in texts]
            return {"rate": [rate(float(b.min()), len(r)) for b, r in zip(shared.value.bits(raw), raw, strict=True)]}

        return kernel

    if not trees.langs:
        return 8.0
    rates = stored(map_texts(_labelled(df, id_col, text_col, lang_col), "id", "txt", make, "rate double"))
    top = quantile(rates, COVERED)
    return 8.0 if top is None else min(top * ROOM, 8.0)


def predict(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep`, id, lang_pred, score and bits_per_byte of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        import regex

        letter, t = regex.compile(r"\p{L}").search, shared.value

        def kernel(ids, texts):
            raw = [x.encode() for x in texts]
            bits = t.bits(raw) if t.langs else np.zeros((len(raw), 0))
            lang, score, rate = [], [], []
            for text, data, b in zip(texts, raw, bits, strict=True):
                if not len(b) or not letter(text):
                    lang.append(UNKNOWN), score.append(0.0), rate.append(0.0)
                    continue
                k = int(b.argmin())
                lang.append(t.langs[k]), rate.append(float(b[k]) / len(data))
                score.append(float(1 / np.exp2(np.maximum(b[k] - b, -1000)).sum()))
            return {id_col: ids, "lang_pred": lang, "score": score, "bits_per_byte": rate}

        return kernel

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, lang_pred string, score double, bits_per_byte double", keep)


def accepted(df: DataFrame, trees: Trees, most: float, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text is in a learnt language.

    Texts without a letter go, and those whose best language needs a rate over
    `most` (see `bound`).
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make() -> Callable[[list[str]], list[bool]]:
        import regex

        letter, t = regex.compile(r"\p{L}").search, shared.value

        def kernel(texts):
            raw = [x.encode() for x in texts]
            bits = t.bits(raw) if t.langs else np.zeros((len(raw), 0))
            return [bool(len(b)) and letter(x) is not None and rate(float(b.min()), len(r)) <= most for x, r, b in zip(texts, raw, bits, strict=True)]

        return kernel

    return filter_texts(df, text_col, make)


def in_learnt_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in a language learnt from those not held out, within the bound learnt from the others."""
    trees = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return accepted(docs, trees, bound(docs.filter(held_out(id_col)), trees, id_col, text_col, lang_col), text_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc(id_col) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's rows: learnt without the held-out rows, predicted for all."""
    trees = train(docs.filter(~held_out(id_col)), id_col)
    got = predict(docs, trees, id_col)
    return got.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "bits_per_byte")
