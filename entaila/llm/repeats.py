"""Removal of repeated 50-byte strings with column-wise suffix ordering.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a
document with a smaller id.  The work is cut so that every equal string meets:

1.  Of equal texts only the one with the least id is searched; a later one goes
    whole if it has `LENGTH` bytes.  The texts searched are dealt to chunks by a
    hash of the id and written, compressed, as a table bucketed by chunk, so no
    later step moves them again.
2.  Every window of LENGTH bytes has a minimiser, the least hash of its 20-byte
    substrings: equal windows have equal minimisers.  A chunk sends each of its
    minimisers once; those met in one document only are set aside, exactly.
3.  Runs of windows with one minimiser are strings of 50 to 80 bytes.  A chunk
    sends each distinct string once, with the least id that has it; occurrences
    stay where their text is.  So what a string in a third of all documents
    costs is a row a chunk, not a row a document.
4.  Strings are dealt by the minimiser, equal ones are kept once, and a
    multi-document suffix order is built column by column (Bauer, Cox and
    Rosone 2013; Cox et al. 2016): in each round one symbol of every string is
    inserted, which updates the collection's Burrows-Wheeler transform and the
    common prefixes.  Suffixes between which every common prefix has LENGTH
    bytes start with the same window; the least id of such a class decides.
    Strings are ordered in lots of whole minimisers, one lot after the other, in
    the memory of a task; the shuffle's spill files take the place of the
    method's external files.  A minimiser that is alone with one string has
    nothing to be ordered against.  One with more than `HOT` different strings
    (a common phrase in many contexts) is split: each of its windows is a string
    of its own, dealt by its whole hash.
5.  A chunk gets back, for each string, the least id of each of its windows where
    that is not the chunk's own, merges the covered spans of its documents and
    cuts them out.

Strings are told apart by two 64-bit hashes, of the minimiser and of the whole.
Null and empty texts have no bytes and lose none.  Rows that repeat an id and a
text are one row; those that repeat an id with another text are one document in
several rows.  Rows with a null id are one document, after all others.  Ids are
whole numbers of 64 bits: "smaller" is by number, others are an error.  A string
repeated inside one document alone stays.  An empty table gives none; other
columns, of any names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ragged, shared_dir, stored
from .hashing import prefix_sums, spans_hash

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # 20-byte substrings of a window
#: Text whose minimisers meet in one group, and text of a chunk, on average, at most.
PART_BYTES, CHUNK_BYTES = 32 << 20, 16 << 20
LOT = 4096  # strings ordered together, unless one minimiser has more
#: Different strings of a minimiser, summed over the chunks, beyond which it is split into windows.
HOT = 1 << 15
#: Text hashed at once; longer texts are cut with an overlap.
PIECE = 1 << 20


# -- windows -----------------------------------------------------------------
def runs(texts: list[bytes], hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, begin, windows, key, name) of runs of at most SPAN windows with one minimiser.

    key: the minimiser; name: a hash of the run's string.  Of minimisers in `hot`
    each window is a run, and the key is its name.
    """
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    empty, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = int(size.sum())
    if n < LENGTH:
        return empty, empty, empty, none, none
    sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    at = np.arange(n - GRAM + 1)
    least = spans_hash(sums, at, at + GRAM)
    wide = 1
    while wide * 2 <= SPAN:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[SPAN - wide : SPAN - wide + n - LENGTH + 1])
    count = np.maximum(size - LENGTH + 1, 0)
    begin = ragged(base, count)
    value = least[begin]
    doc = np.repeat(np.arange(len(texts)), count)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(value)))
    pieces = -(-length // SPAN)
    first = np.repeat(head, pieces) + SPAN * ragged(np.zeros(len(pieces), np.int64), pieces)
    windows = np.minimum(SPAN, np.repeat(head + length, pieces) - first)
    key = value[first]
    if hot is not None and len(hot) and (split := np.isin(key, hot)).any():
        times = np.where(split, windows, 1)
        first, windows, key, split = ragged(first, times), np.repeat(np.where(split, 1, windows), times), np.repeat(key, times), np.repeat(split, times)
        name = spans_hash(sums, begin[first], begin[first] + windows + LENGTH - 1)
        key = np.where(split, name, key)
    else:
        name = spans_hash(sums, begin[first], begin[first] + windows + LENGTH - 1)
    return doc[first], begin[first] - base[doc[first]], windows, key, name


def pieces_of(texts: list[bytes]):
    """(text numbers, offsets, pieces) of about PIECE bytes; a longer text is cut so that each window is in one piece."""
    who, off, some, size = [], [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - LENGTH + 1, 1), PIECE):
            piece = t[a : a + PIECE + LENGTH - 1]
            if size and size + len(piece) > PIECE:
                yield np.array(who), np.array(off), some
                who, off, some, size = [], [], [], 0
            who.append(k), off.append(a), some.append(piece)
            size += len(piece)
    if some:
        yield np.array(who), np.array(off), some


# -- suffix order --------------------------------------------------------------
def column_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the one before) in suffix order.

    Round t inserts the suffixes of t symbols.  `bwt` holds the symbol before
    each suffix (0: none); a pending suffix goes where the transform's own
    ordering of its symbols puts it, and its common prefixes are one more than
    the least ones between the places of the same symbol.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    bwt = data[end - 1]
    lcp = np.zeros(m, np.uint8)
    tag = np.arange(m, dtype=np.int64) << 8  # string and suffix length
    at, who = np.arange(m), np.arange(m)
    t = 0
    while len(who):
        t += 1
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        mine = rank[at]
        place = mine + (m - int(np.count_nonzero(bwt == 0)))
        symbol = bwt[at]
        low = np.append(lcp, np.uint8(0))

        def between(a, b):
            """least common prefix over a+1..b, for each pair."""
            if not len(a):
                return np.zeros(0, np.uint8)
            return np.minimum.reduceat(low, np.stack([a + 1, b + 1], 1).ravel())[::2]

        before = order[np.maximum(mine - 1, 0)]
        has = (mine > 0) & (bwt[before] == symbol)
        own = np.zeros(len(at), np.uint8)
        own[has] = between(before[has], at[has]) + np.uint8(1)
        after = order[np.minimum(mine + 1, len(order) - 1)]
        has_next = (mine + 1 < len(order)) & (bwt[after] == symbol)
        nxt = between(at[has_next], after[has_next]) + np.uint8(1)

        total = len(bwt) + len(at)
        old = np.ones(total, bool)
        old[place] = False
        left = size[who] - t
        prior = np.where(left > 0, data[np.maximum(end[who] - t - 1, 0)], 0).astype(np.uint8)
        grown = []
        for was, new in ((bwt, prior), (lcp, own), (tag, (who << 8) | t)):
            x = np.empty(total, was.dtype)
            x[old] = was
            x[place] = new
            grown.append(x)
        bwt, lcp, tag = grown
        lcp[place[has_next] + 1] = nxt
        go = left > 0
        at, who = place[go], who[go]
        o = np.argsort(at)
        at, who = at[o], who[o]
    return tag >> 8, tag & 255, lcp


def window_classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class): the windows of LENGTH bytes, equal ones in one class."""
    who, size, lcp = column_order(strings)
    group = np.cumsum(lcp < LENGTH)
    keep = size >= LENGTH
    total = np.array([len(s) for s in strings], np.int64)
    return who[keep], total[who[keep]] - size[keep], group[keep]


def window_ids(strings: list[bytes], least: np.ndarray) -> np.ndarray:
    """The least id of each window of distinct strings, string after string; least: the least id of each string."""
    who, off, group = window_classes(strings)
    _, group = np.unique(group, return_inverse=True)
    first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, least[who])
    count = np.array([len(s) - LENGTH + 1 for s in strings], np.int64)
    out = np.empty(int(count.sum()), np.int64)
    out[(np.cumsum(count) - count)[who] + off] = first[group]
    return out


def merge(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans, by document; touching spans become one."""
    if not len(doc):
        return doc, begin, end
    o = np.lexsort((begin, doc))
    doc, begin, end = doc[o], begin[o], end[o]
    new = np.ones(len(doc), bool)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    far = end.copy()  # running maximum inside a document
    shift = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc)))) * (1 << 40)
    far = np.maximum.accumulate(far + shift) - shift
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > far[:-1])
    head = np.flatnonzero(new)
    return doc[head], begin[head], far[np.append(head[1:], len(doc)) - 1]


def packed(by: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """(values of `by`, columns): the rows of each value packed and compressed."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    o = np.argsort(by, kind="stable")
    by = by[o]
    cut = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
    return by[cut], [[z.compress(v.tobytes()) for v in np.split(c[o], cut[1:])] if len(cut) else [] for c in cols]


def unpacked(blobs, kind) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(d.decompress(b), kind) for b in blobs]) if len(blobs) else np.zeros(0, kind)


def same(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): rows sorted by the columns, and the first of each equal rows in that order."""
    o = np.lexsort(cols[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[o][1:] != c[o][:-1]
    return o, np.flatnonzero(new)


def sums_of(value: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.add.reduceat(value, head) if len(head) else value[:0]


# -- stages ------------------------------------------------------------------
def _texts(blobs) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(b) if b else b"" for b in blobs]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document; kept: the bytes that stay, null where all do."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = np.iinfo(np.int64).max
    df = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(last))).alias("id"), F.col(text_col).cast("string").alias("text"))

    def digest():
        def kernel(ids, texts):
            raw = [t.encode() for t in texts]
            return {"id": ids, "n_bytes": [len(r) for r in raw], "sha": [hashlib.sha256(r).digest() for r in raw]}

        return kernel

    seen = stored(map_texts(df, "id", "text", digest, "id long, n_bytes long, sha binary").dropDuplicates(["id", "sha"]))
    # groups and chunks are held in memory: there are more of them for more text
    total = int(seen.agg(F.sum("n_bytes")).first()[0] or 0)
    parts, chunks = max(buckets, -(-total // PART_BYTES)), max(4 * buckets, -(-total // CHUNK_BYTES))
    first = stored(seen.groupBy("sha").agg(F.min("id").alias("first"), F.max("n_bytes").alias("n_bytes")))

    def pack():
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return lambda ids, texts: {"id": ids, "blob": [c.compress(t.encode()) for t in texts]}

    blobs = map_texts(df.filter(F.length("text") > 0), "id", "text", pack, "id long, blob binary")
    name, keep = f"repeats_{uuid.uuid4().hex}", first.filter(F.col("n_bytes") >= LENGTH).select(F.col("first").alias("id")).distinct()
    searched = blobs.join(keep.hint("merge"), "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).repartition(buckets, "chunk")
    searched.write.option("path", shared_dir(spark)).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    texts = spark.table(name)

    def minimisers(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each minimiser of a chunk once: 0 if one document has it, or the number of its strings."""
        ids, got = pdf["id"].to_numpy(), []
        for who, _, some in pieces_of(_texts(pdf["blob"])):
            doc, _, _, key, string = runs(some)
            got.append((key, string, ids[who[doc]]))
        key, string, doc = (np.concatenate([g[c] for g in got]) for c in range(3))
        o, head = same(key, string)
        n_strings = sums_of(np.ones(len(head), np.int64), np.flatnonzero(np.append(True, key[o][head][1:] != key[o][head][:-1])))
        o, head = same(key)
        lo, hi = np.minimum.reduceat(doc[o], head), np.maximum.reduceat(doc[o], head)
        key, n = key[o][head], np.where(lo == hi, 0, np.minimum(n_strings, 65535)).astype(np.uint16)
        part, (keys, counts) = packed((key >> np.uint64(32)).astype(np.int64) % parts, key, n)
        return pd.DataFrame({"part": part, "chunk": pdf["chunk"].iloc[0], "keys": keys, "counts": counts})

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """The minimisers that two documents have, for each chunk that has them; hot: those with many strings."""
        per = [unpacked([x], np.uint64) for x in pdf["keys"]]
        key, n = np.concatenate(per), unpacked(pdf["counts"], np.uint16).astype(np.int64)
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) for x in per])
        o, head = same(key)
        times = np.diff(np.append(head, len(key)))
        strings = sums_of(np.maximum(n, 1)[o], head)
        ok = (times > 1) | (strings > 1) | (np.maximum.reduceat(n[o], head) > 0)
        pick = o[np.repeat(ok, times)]
        hot = np.repeat(strings > HOT, times)[np.repeat(ok, times)]
        to, (keys, hots) = packed(chunk[pick], key[pick], hot)
        return pd.DataFrame({"chunk": to, "keys": keys, "hots": hots})

    def strings_of(texts_pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Each distinct string of a chunk that has a shared minimiser, with its least id."""
        empty = pd.DataFrame({c: [] for c in ("part", "chunk", "keys", "names", "least", "sizes", "text")})
        if not len(texts_pdf) or not len(replies):
            return empty
        ids, wanted, hots = texts_pdf["id"].to_numpy(), unpacked(replies["keys"], np.uint64), unpacked(replies["hots"], bool)
        hot, wanted = wanted[hots], np.sort(wanted[~hots])
        got, raw = [], []
        for who, _, some in pieces_of(_texts(texts_pdf["blob"])):
            doc, begin, windows, key, string = runs(some, hot)
            at = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
            ok = (wanted[at] == key if len(wanted) else np.zeros(len(key), bool)) | (key == string)
            doc, begin, windows, key, string = doc[ok], begin[ok], windows[ok], key[ok], string[ok]
            o, head = same(key, string, ids[who[doc]])
            head = head[np.append(True, (key[o][head][1:] != key[o][head][:-1]) | (string[o][head][1:] != string[o][head][:-1]))] if len(head) else head
            k = o[head]
            got.append((key[k], string[k], ids[who[doc[k]]], windows[k] + LENGTH - 1))
            raw += [some[d][b : b + w] for d, b, w in zip(doc[k].tolist(), begin[k].tolist(), got[-1][3].tolist(), strict=True)]
        key, string, least, size = (np.concatenate([g[c] for g in got]) for c in range(4))
        if not len(key):
            return empty
        o, head = same(key, string)
        least, k = np.minimum.reduceat(least[o], head), o[head]
        key, string, size, raw = key[k], string[k], size[k].astype(np.uint8), np.array([raw[x] for x in k.tolist()], object)
        # windows of a split minimiser are dealt by all bits of their hash
        part = (np.where(key == string, string >> np.uint64(20), key >> np.uint64(32)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % parts
        to, (keys, names, leasts, sizes) = packed(part, key, string, least, size)
        o = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.append(False, part[o][1:] != part[o][:-1]))
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        text = [z.compress(b"".join(x)) for x in np.split(raw[o], cut)]
        return pd.DataFrame({"part": to, "chunk": texts_pdf["chunk"].iloc[0], "keys": keys, "names": names, "least": leasts, "sizes": sizes, "text": text})

    def first_ids(pdf: pd.DataFrame) -> pd.DataFrame:
        """For the strings of each chunk the least ids of their windows, as runs, where these are not the chunk's own."""
        import zstandard

        d = zstandard.ZstdDecompressor()
        per = [unpacked([x], np.uint64) for x in pdf["keys"]]
        key, string = np.concatenate(per), unpacked(pdf["names"], np.uint64)
        own, size = unpacked(pdf["least"], np.int64), unpacked(pdf["sizes"], np.uint8).astype(np.int64)
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) for x in per])
        text = b"".join([d.decompress(x) for x in pdf["text"]])
        end = np.cumsum(size)
        o, head = same(key, string)
        pick, least = o[head], np.minimum.reduceat(own[o], head)
        which = np.empty(len(key), np.int64)  # the distinct string of each row
        which[o] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(o))))
        count = size[pick] - LENGTH + 1
        base = np.cumsum(count) - count
        ids = np.repeat(least, count)
        start = np.flatnonzero(np.append(True, key[pick][1:] != key[pick][:-1]))
        stop = np.append(start[1:], len(pick))
        lot: list[int] = []
        for a, b, alone in zip(start.tolist(), stop.tolist(), (stop - start == 1).tolist(), strict=True):
            if not alone:
                lot += range(a, b)
            if lot and (len(lot) >= LOT or b == len(pick)):
                rows = np.array(lot)
                x = window_ids([text[e - s : e] for e, s in zip(end[pick[rows]].tolist(), size[pick[rows]].tolist(), strict=True)], least[rows])
                ids[ragged(base[rows], count[rows])] = x
                lot = []
        if lot:
            rows = np.array(lot)
            ids[ragged(base[rows], count[rows])] = window_ids([text[e - s : e] for e, s in zip(end[pick[rows]].tolist(), size[pick[rows]].tolist(), strict=True)], least[rows])
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        new[base] = True
        at = np.flatnonzero(new)
        n_runs = np.add.reduceat(new.astype(np.int64), base)
        first_run = np.cumsum(n_runs) - n_runs
        length, run_id = np.diff(np.append(at, len(ids))), ids[at]
        tell = (n_runs[which] > 1) | (run_id[first_run[which]] != own)
        rows = np.flatnonzero(tell)
        o = rows[np.argsort(chunk[rows], kind="stable")]
        if not len(o):
            return pd.DataFrame({c: [] for c in ("chunk", "keys", "names", "counts", "lengths", "ids")})
        to, (keys, names, counts) = packed(chunk[o], key[o], string[o], n_runs[which[o]].astype(np.uint8))
        flat = ragged(first_run[which[o]], n_runs[which[o]])
        _, (lengths, run_ids) = packed(np.repeat(chunk[o], n_runs[which[o]]), length[flat].astype(np.uint8), run_id[flat])
        return pd.DataFrame({"chunk": to, "keys": keys, "names": names, "counts": counts, "lengths": lengths, "ids": run_ids})

    def cut_out(texts_pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The documents of a chunk that lose bytes."""
        out: dict[str, list] = {c: [] for c in ("id", "sha", "n_removed", "n_spans", "kept")}
        if not len(texts_pdf) or not len(replies):
            return pd.DataFrame(out)
        ids, raw = texts_pdf["id"].to_numpy(), _texts(texts_pdf["blob"])
        told = replies[replies["counts"].notna()]
        hot = replies[replies["hots"].notna()]
        hot = unpacked(hot["keys"], np.uint64)[unpacked(hot["hots"], bool)]
        got = []
        for who, off, some in pieces_of(raw):
            doc, begin, windows, key, string = runs(some, hot)
            got.append((who[doc], begin + off[doc], windows, key, string))
        doc, begin, windows, key, string = (np.concatenate([g[c] for g in got]) for c in range(5))
        r_key, r_name, r_n = unpacked(told["keys"], np.uint64), unpacked(told["names"], np.uint64), unpacked(told["counts"], np.uint8).astype(np.int64)
        r_len, r_id = unpacked(told["lengths"], np.uint8).astype(np.int64), unpacked(told["ids"], np.int64)
        # a string without a reply has the chunk's own least id; rows of replies stand before those of the text
        o, head = same(np.concatenate([r_key, key]), np.concatenate([r_name, string]))
        n_told, at = len(r_key), np.repeat(np.arange(len(head)), np.diff(np.append(head, len(o))))
        which = np.empty(len(o), np.int64)
        which[o] = at
        reply = np.full(len(head), -1, np.int64)
        reply[which[:n_told]] = np.arange(n_told)
        which = which[n_told:]
        least = np.full(len(head), last)
        np.minimum.at(least, which, ids[doc])
        r_first, r_off = np.cumsum(r_n) - r_n, np.cumsum(r_len) - r_len
        r_off = r_off - np.repeat(r_off[r_first], r_n) if len(r_n) else r_off
        alone = np.flatnonzero((reply[which] < 0) & (least[which] < ids[doc]))
        asked = np.flatnonzero(reply[which] >= 0)
        n = r_n[reply[which[asked]]]
        flat, unit = ragged(r_first[reply[which[asked]]], n), np.repeat(asked, n)
        ok = r_id[flat] < ids[doc[unit]]
        flat, unit = flat[ok], unit[ok]
        lo = np.concatenate([begin[alone], begin[unit] + r_off[flat]])
        hi = np.concatenate([begin[alone] + windows[alone], begin[unit] + r_off[flat] + r_len[flat]]) + LENGTH - 1
        d, lo, hi = merge(np.concatenate([doc[alone], doc[unit]]), lo, hi)
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        for k, begins, ends in zip(d[cut].tolist(), np.split(lo, cut[1:]), np.split(hi, cut[1:]), strict=False):
            at, kept = 0, []
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                kept.append(raw[k][at:x])
                at = y
            row = (int(ids[k]), hashlib.sha256(raw[k]).digest(), int((ends - begins).sum()), len(begins), b"".join([*kept, raw[k][at:]]))
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)
        return pd.DataFrame(out).drop_duplicates(["id", "sha"])

    sent = texts.groupBy("chunk").applyInPandas(minimisers, "part long, chunk long, keys binary, counts binary")
    replies = stored(sent.groupBy("part").applyInPandas(shared, "chunk long, keys binary, hots binary"))
    dealt = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(strings_of, "part long, chunk long, keys binary, names binary, least binary, sizes binary, text binary")
    told = dealt.groupBy("part").applyInPandas(first_ids, "chunk long, keys binary, names binary, counts binary, lengths binary, ids binary")
    told = told.unionByName(replies.select("chunk", "keys", "hots"), allowMissingColumns=True)
    changed = stored(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(cut_out, "id long, sha binary, n_removed long, n_spans long, kept binary"))
    spark.sql(f"DROP TABLE {name}")  # the files stay in the shared folder
    base = seen.join(first.select("sha", "first").hint("merge"), "sha").join(changed.hint("merge"), ["id", "sha"], "left")
    copy = (F.col("id") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return base.select(
        F.when(F.col("id") != F.lit(int(last)), F.col("id")).alias(id_col), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "sha",
    )


def report(docs: DataFrame) -> DataFrame:
    got = remove_repeats(docs)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha"))).alias("kept_sha256"))
