"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1.  Every text's set of word shingles is hashed; texts with equal sets are one
    text, named by a digest of the set (`text_key`).
2.  In each of `TREES` trees a text has a string of MinHash values.  The first
    `shortest` values, folded into one key, are the shortest prefix ever used: at
    it a pair at the threshold meets with the target recall, whatever the data
    (`shortest_prefix`).  The `TAIL` values after it are kept one by one, 16 bits
    each.  The strings that share their shortest prefix with another, sorted by
    tree, prefix and tail, are the prefix tries (`forest`).
3.  Texts meet first in the trie nodes of full depth.  All their pairs are
    compared exactly there, and the similarities found give the recall reached:
    a link of similarity s is met at depth d with probability 1 - (1 - s^d)^TREES,
    so the links found stand for a known number (`measured`).  If the target is
    missed, the prefixes are shortened to the longest depth that these
    similarities say will meet it, and the nodes that join several children are
    compared, for pairs that have not met before.  This goes on until the recall
    measured is met or the shortest prefix is reached.
4.  A pair is compared only in the first tree in which it meets, so links are
    counted once; nodes with the same members are visited once.  A node is cut
    into blocks of about `BLOCK` shingles and pairs of blocks; only counts and
    a spanning forest leave a task.
5.  The components of the verified forests are the classes.

Null texts and texts without words have no shingles: each is a class of its own
without links.  Ties go to the least id.  Every row is returned: rows that
repeat an id are texts of their own if their texts differ, and copies if not.  A
null id names a class only if no other id does.  Empty tables give none; other
columns, of any names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ragged, stored
from .graph import components
from .hashing import mix
from .shingles import shingle_sets

WORDS, THRESHOLD = 5, 0.8
TREES, TAIL, RECALL = 16, 4, 0.9995
BLOCK = 1 << 19
#: Nodes of more texts are compared by matrix products.
SMALL = 64


# -- the forest ----------------------------------------------------------------
def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest depth at which pairs at the threshold meet with the target recall."""
    depth = 1
    while depth < 16 and meets(threshold, depth + 1, trees) >= recall:
        depth += 1
    return depth


def measured(found: dict[int, int], depth: int, shorter: int | None = None) -> float:
    """Recall at `shorter` (or at `depth`), told by the links found at `depth`.

    found: links by similarity in hundredths, rounded down.  A link found stands
    for 1 / meets(its similarity, depth) links.
    """
    p = {b: meets(b / 100, depth) for b in found}
    expected = {b: n / p[b] for b, n in found.items()}
    return sum(n * meets(b / 100, shorter or depth) for b, n in expected.items()) / sum(expected.values())


def strings(sets: list[np.ndarray], shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, tree) of prefix keys, and of tails with the first value highest."""
    full = [k for k, s in enumerate(sets) if len(s)]
    prefix, tail = np.zeros((len(sets), TREES), np.uint64), np.zeros((len(sets), TREES), np.uint64)
    if not full:
        return prefix, tail
    flat = np.concatenate([sets[k] for k in full])
    cut = np.cumsum([0, *[len(sets[k]) for k in full[:-1]]])
    factor = mix(np.arange(1, TREES * (shortest + TAIL) + 1, dtype=np.uint64)) | np.uint64(1)
    for t in range(TREES):
        key, rest = np.full(len(full), t, np.uint64), np.zeros(len(full), np.uint64)
        for d in range(shortest + TAIL):
            least = mix(np.minimum.reduceat(flat * factor[t * (shortest + TAIL) + d], cut))
            if d < shortest:
                key = mix(key ^ least) + np.uint64(d)
            else:
                rest = (rest << np.uint64(16)) | (least >> np.uint64(48))
        prefix[full, t], tail[full, t] = key, rest
    return prefix, tail


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(df: DataFrame, id_col: str, text_col: str, n: int = WORDS, shortest: int = 4) -> DataFrame:
    """(id, n_shingles, text_key, prefixes, tails) of every whole text."""

    def make():
        def kernel(ids, texts):
            sets = shingle_sets(texts, n)
            prefix, tail = strings(sets, shortest)
            return {"id": ids, "n_shingles": [len(s) for s in sets], "text_key": [digest(s) for s in sets], "prefixes": prefix.view(np.int64).tolist(), "tails": tail.view(np.int64).tolist()}

        return kernel

    return map_texts(df, id_col, text_col, make, f"id {dict(df.dtypes)[id_col]}, n_shingles long, text_key binary, prefixes array<long>, tails array<long>")


# -- exact comparison ----------------------------------------------------------
def first_meeting(at: np.ndarray, deeper: np.ndarray, tree: np.ndarray | int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) meet in no earlier tree at this depth and in none at the one before.

    at, deeper: (text, tree) of node names at this depth and the one before (no columns: none).
    """
    new = np.ones(np.broadcast(a, b).shape, bool)
    for t in range(TREES):
        new &= (at[a, t] != at[b, t]) | (t >= tree)
    for t in range(deeper.shape[1]):
        new &= deeper[a, t] != deeper[b, t]
    return new


def overlaps(code: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of codes that the sets a and b share, for each pair; codes are sorted in a set."""
    out, width = np.zeros(len(a), np.int64), int(code.max()) + 1 if len(code) else 1
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    part = np.cumsum(size[a] + size[b]) >> 21
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
        x, y, pair = a[lo:hi], b[lo:hi], np.arange(hi - lo) * width
        small = code[ragged(start[x], size[x])] + np.repeat(pair, size[x])
        large = code[ragged(start[y], size[y])] + np.repeat(pair, size[y])
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size[x])[large[place] == small], minlength=hi - lo)
    return out


def products(code: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): the same numbers as products of 0/1 matrices."""
    rows = np.unique(np.concatenate([left, right]))
    row, col = np.repeat(rows, size[rows]), code[ragged(start[rows], size[rows])]
    uniq, col, n = np.unique(col, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # only shingles met twice add to an overlap
    row, col = row[n[col] > 1], shared[col[n[col] > 1]]
    width = int(shared[-1]) + 1 if len(shared) else 0
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    place = np.zeros(len(size), np.int64)
    place[rows] = np.arange(len(rows))
    i, j = place[left], place[right]
    both = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, 2048):
        lo, hi = np.searchsorted(col, (c, c + 2048))
        m = np.zeros((len(rows), min(2048, width - c)), np.float32)
        m[place[row[lo:hi]], col[lo:hi] - c] = 1
        both += m[i] @ m[j].T
    return both


def compare(pdf: pd.DataFrame, threshold: float, drop: int, drop_before: int | None) -> pd.DataFrame:
    """(text_key, root, hundredths, links) of the rows of whole nodes or pairs of blocks.

    drop, drop_before: bits of the tails below this depth and the one before.
    """
    keys = pdf["text_key"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    prefix, tail = (np.array(pdf[c].tolist(), np.int64).reshape(-1, TREES).view(np.uint64) for c in ("prefixes", "tails"))

    def names(bits):
        return mix(prefix ^ mix((tail >> np.uint64(bits) if bits < 64 else tail * np.uint64(0)) + np.uint64(1)))

    at, deeper = names(drop), names(drop_before) if drop_before is not None else np.zeros((len(pdf), 0), np.uint64)
    tree, block, bi, bj = (pdf[c].to_numpy() for c in ("tree", "block", "bi", "bj"))
    unit = pdf.groupby(["tree", "prefix", "node", "bi", "bj"], sort=False).ngroup().to_numpy()
    order = np.argsort(unit, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(unit[order]) != 0))
    count = np.diff(np.append(head, len(unit)))
    links: list[tuple] = []

    def keep(a, b, both):
        either = size[a] + size[b] - both
        near = both >= threshold * either - 1e-6
        links.append((a[near], b[near], both[near] * 100 // either[near]))

    def listed(a, b):
        ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-6
        keep(a[ok], b[ok], overlaps(code, start, size, a[ok], b[ok]))

    few = (count <= SMALL) & (bi[order[head]] == bj[order[head]])
    for k in np.unique(count[few]).tolist():  # nodes of k texts together
        i, j = np.triu_indices(k, 1)
        heads = head[few & (count == k)]
        for some in np.array_split(heads, max(1, len(heads) * len(i) >> 20)):
            a, b = order[(some[:, None] + i).ravel()], order[(some[:, None] + j).ravel()]
            new = first_meeting(at, deeper, tree[a], a, b)
            listed(a[new], b[new])
    for h, n in zip(head[~few].tolist(), count[~few].tolist(), strict=True):
        rows = order[h : h + n]
        left, right = rows[block[rows] == bi[rows[0]]], rows[block[rows] == bj[rows[0]]]
        if not len(left) or not len(right):
            continue
        new = first_meeting(at, deeper, int(tree[rows[0]]), left[:, None], right[None, :])
        if bi[rows[0]] == bj[rows[0]]:
            new &= np.triu(np.ones(new.shape, bool), 1)
        x, y = np.nonzero(new)
        if len(x) * 20 < new.size:
            listed(left[x], right[y])
        else:
            both = products(code, start, size, left, right)
            keep(left[x], right[y], both[x, y].astype(np.int64))
    a, b, hundredths = (np.concatenate([x[c] for x in links]) if links else np.zeros(0, np.int64) for c in range(3))
    root = np.arange(len(pdf))
    while True:  # the least row of each connected set
        was = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == was).all():
            break
    pair = np.concatenate([a, b]) * 101 + np.concatenate([hundredths, hundredths])
    pair, n = np.unique(pair, return_counts=True)
    return pd.DataFrame({"text_key": keys[pair // 101], "root": keys[root[pair // 101]], "hundredths": pair % 101, "links": n})


# -- the join --------------------------------------------------------------------
def _round(forest: DataFrame, sets: DataFrame, threshold: float, depth: int, before: int | None, shortest: int) -> DataFrame:
    """Links of the pairs that meet at `depth` and not at `before`, a greater depth."""
    drop = 16 * (shortest + TAIL - depth)
    drop_before = None if before is None else 16 * (shortest + TAIL - before)
    cut: Callable = lambda bits: F.shiftrightunsigned("tail", bits) if bits < 64 else F.lit(0).cast("long")
    at = forest.withColumn("node", cut(drop))
    child = F.lit(0) if drop_before is None else cut(drop_before)
    nodes = at.groupBy("tree", "prefix", "node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.min(child).alias("lo"), F.max(child).alias("hi"),
        F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("y"),
    ).filter("n > 1" if before is None else "lo != hi")
    # of nodes with the same members the one in the first tree
    once = stored(nodes.groupBy("n", "size", "x", "y").agg(F.min(F.struct("tree", "prefix", "node")).alias("m")).select("m.*", F.expr(f"cast((size + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"), "size"))
    bins = max(1, -(-int(once.filter("blocks = 1").agg(F.sum("size")).first()[0] or 0) // (2 * BLOCK)))
    member = at.join(once.hint("merge"), ["tree", "prefix", "node"]).select("tree", "prefix", "node", "blocks", "text_key", F.pmod(F.xxhash64("text_key"), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = member.join(sets.hint("merge"), "text_key").select("*", other.alias("o")).withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o"))
    rows = rows.select(
        "text_key", "shingles", "prefixes", "tails", "tree", "prefix", "node", "block", "bi", "bj", (F.col("blocks") == 1).alias("whole"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("tree", "prefix", "node"), F.lit(bins))).otherwise(F.xxhash64("tree", "prefix", "node", "bi", "bj")).alias("work"),
    )
    return stored(rows.groupBy("whole", "work").applyInPandas(lambda pdf: compare(pdf, threshold, drop, drop_before), "text_key binary, root binary, hundredths long, links long"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row.

    class_id: the least id of the connected class; n_links: other distinct texts
    (shingle sets) with a similarity of `threshold` or more; n_copies: other
    rows with the same shingle set.
    """
    shortest = shortest_prefix(threshold, recall)
    sk = stored(sketches(df, id_col, text_col, n, shortest))
    texts = stored(sk.filter("n_shingles > 0").groupBy("text_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("n_shingles", "prefixes", "tails")).alias("s")).select("text_key", "rep", "n_rows", "s.*"))
    placed = texts.select("text_key", "n_shingles", F.posexplode(F.arrays_zip("prefixes", "tails")).alias("tree", "s")).select("tree", F.col("s.prefixes").alias("prefix"), F.col("s.tails").alias("tail"), "text_key", "n_shingles")
    shared = placed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    forest = stored(placed.join(shared.hint("merge"), ["tree", "prefix"]).sortWithinPartitions("tree", "prefix", "tail"))
    wanted = texts.join(forest.select("text_key").distinct().hint("merge"), "text_key", "left_semi")

    def make():
        def kernel(ids, ts):
            sets = shingle_sets(ts, n)
            return {"own_key": [digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return kernel

    source = df.select(F.col(id_col).alias("tid"), F.col(text_col).alias("txt")).join(wanted.select("text_key", "rep", "prefixes", "tails").hint("merge"), F.col("tid").eqNullSafe(F.col("rep")))
    sets = map_texts(source, "tid", "txt", make, "own_key binary, shingles binary", keep=("text_key", "prefixes", "tails"))
    sets = stored(sets.filter("own_key = text_key").drop("own_key").dropDuplicates(["text_key"]))  # rows may repeat an id

    found, depth, before, reached = [], shortest + TAIL, None, {}
    while True:
        found.append(_round(forest, sets, threshold, depth, before, shortest))
        for r in found[-1].groupBy("hundredths").agg(F.sum("links").alias("n")).collect():  # 101 rows at most
            reached[r["hundredths"]] = reached.get(r["hundredths"], 0) + r["n"]
        if depth == shortest or (reached and measured(reached, depth) >= recall):
            break
        before = depth
        depth = next((d for d in range(depth - 1, shortest, -1) if reached and measured(reached, before, d) >= recall), shortest)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    links = pairs.groupBy("text_key").agg(F.sum("links").alias("n_links"))
    group = components(pairs.filter("text_key != root").select("text_key", "root"), "text_key", "root")
    group = stored(group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()))
    named = group.join(texts.select(F.col("text_key").alias("node"), "rep").hint("merge"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = group.join(least.hint("merge"), "root").select(F.col("node").alias("text_key"), "class_id").join(links.hint("merge"), "text_key")
    per_text = texts.select("text_key", "rep", "n_rows").join(linked.hint("merge"), "text_key", "left").select("text_key", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n_rows") - 1).alias("n_copies"))
    rows = sk.filter("n_shingles > 0").select("id", "text_key").join(per_text.hint("merge"), "text_key").select("id", F.coalesce("class_id", "id").alias("class_id"), "n_links", "n_copies")
    none = F.lit(0).cast("long")
    return rows.unionByName(sk.filter("n_shingles = 0").select("id", F.col("id").alias("class_id"), none.alias("n_links"), none.alias("n_copies"))).withColumnRenamed("id", id_col)
