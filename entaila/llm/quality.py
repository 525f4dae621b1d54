"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting visits one feature after the other and adds a shallow
tree on that feature's bins to its look-up table; then pairs, chosen by how much
of the remaining gradient they explain, get two-cut trees on their bin grid.  A
text's score is a sum of table entries, one for each feature and pair, added
for all texts of a slice at once.

The model is fitted on the features of at most about `sample_rows` labelled
rows, drawn by a hash of the id; the features are computed from whole texts by
Spark tasks.  Without labelled rows every score is 0.5.  Null and empty texts
have features of 0.  Rows with a null label are not used; of several labels of
one document the least counts.  Every row is returned, repeated ones too (each
labelled copy of a repeated row is learnt from); equal texts get equal scores, and a
score of exactly 0.5 is predicted as 1.  Very long texts are read whole.  An empty
table gives none; other columns, of any names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, map_texts

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.12
FEATURES = (
    "log_chars", "log_words", "word_length", "unique_words", "repeats", "word_symbols", "symbols", "punctuation", "digits", "upper", "lines", "unique_lines", "top_word", "short_words", "letters",
)

_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 common punctuation, 5 other symbol, 6 white space, 7 over 0x7F
_KIND[33:127] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[ord(x) for x in ".,;:'\"?-()"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 6


def features(text: str) -> tuple[float, ...]:
    words = text.split()
    if not words:
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    n, lines = len(words), text.split("\n")
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:'\"?-()")
    size = sum(map(len, words)) / n
    return (
        np.log1p(len(text)), np.log1p(n), size, len(counts) / n, sum(map(eq, words, words[1:])) / n, ends / len(counts), kinds[5], kinds[4], kinds[3], kinds[1],
        len(lines) / n, len(set(lines)) / len(lines), max(counts.values()) / n, sum(c for w, c in counts.items() if len(w) < 4) / n, kinds[1] + kinds[2] + kinds[7],
    )


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for j in {k for p in self.pairs for k in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="nearest"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a shallow tree fitted to a gradient histogram."""
    lam = 1.0
    out = np.full(len(g), g.sum() / (h.sum() + lam))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam)
    gain[(hl < 1) | (hr < 1)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + lam):
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best two cuts of a bin grid, one on each side: leaf values and gain."""
    lam = 1.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        q = c[:-1, :-1]
        quads.append((q, c[:-1, -1:] - q, c[-1:, :-1] - q, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + q))
    gain = sum(a**2 / (b + lam) for a, b in zip(*quads, strict=True))
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [a[i, j] / (b[i, j] + lam) for a, b in zip(*quads, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam()
    rate = np.clip(y.mean(), 0.5 / len(y), 1 - 0.5 / len(y))
    m = Gam(bias=float(np.log(rate / (1 - rate))))
    m.edges = [_cut(x[:, j], BINS) for j in range(x.shape[1])]
    m.pair_edges = [_cut(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.bias)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p) + 1e-9

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = gradient()
            n = len(m.tables[j])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n), 2)
            m.tables[j] += step
            z += step[b]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.pair_edges)]

    def grid(a, b, v):
        w = len(m.pair_edges[b]) + 1
        return np.bincount(coarse[a] * w + coarse[b], v, (len(m.pair_edges[a]) + 1) * w).reshape(-1, w)

    g, h = gradient()
    gains = sorted(((-_grid_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    m.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    m.pair_tables = [np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(m.pairs):
            g, h = gradient()
            step = RATE * _grid_tree(grid(a, b, g), grid(a, b, h))[0]
            m.pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Gam:
    """A model of the labelled documents."""
    known = labels.select(F.col(label_id).alias("lid"), F.col(label_col).cast("int").alias("y")).filter("lid is not null and y in (0, 1)")
    total = known.count()
    if not total:
        return Gam()
    share = F.xxhash64(F.col("lid")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(1 << 30)
    sample = known.filter(share * total < sample_rows).groupBy("lid").agg(F.min("y").alias("y"))  # bounded by sample_rows
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).join(F.broadcast(sample), F.col("id") == F.col("lid")).select("id", "txt", "y")

    def make():
        return lambda ids, texts: {"id": ids, "x": [features(t) for t in texts]}

    got = map_texts(src, "id", "txt", make, f"id {dict(src.dtypes)['id']}, x array<double>", keep=("y",)).orderBy("id").toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def score(df: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep`, id and score (0 to 1) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda ids, texts: {id_col: ids, "score": m.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))}

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, score double", keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: learnt without the held-out third, scored for all."""
    out = F.coalesce(crc("doc_id") % 3 == 1, F.lit(False))
    model = train(docs, labels.filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
