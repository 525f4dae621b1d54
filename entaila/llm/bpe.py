"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut by the tokenizer's pattern.  The distinct pieces not met before
are put into matrices by byte length; in each round every row merges its
leftmost pair of minimum rank, pairs are looked up in an open-addressing hash
table, and rows are compacted.  Rows without a mergeable pair leave the matrix.
Pieces over `LONG_PIECE` bytes, for which a round a merge would be quadratic,
are merged by a heap with the same order of merges.

Results do not depend on batches: the piece cache only saves work.  Null and
empty texts have no tokens; special-token strings are ordinary text.  Every row is
returned, repeated ones too; an empty table gives none; other columns, of any names,
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

LONG_PIECE = 256
#: Pieces kept between texts, at most; the cache is emptied when it is full.
CACHE_PIECES = 600_000
#: Characters of the texts that are split and merged at once, unless a single text is longer.
GROUP_CHARS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DOUBLE_SPACE = re.compile(r"\s\s").search
_NONE = np.int32(0x7FFFFFFF)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the joined token, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.full(1 << self.bits, _NONE, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        vals = np.array(joined, np.int32)
        while len(rest):
            free = self.vals[slot[rest]] == _NONE
            first = np.zeros(len(rest), bool)
            first[np.unique(slot[rest], return_index=True)[1]] = True
            put = rest[free & first]
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], vals[put]
            rest = rest[~(free & first)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slot = self._slot(keys)
        found, out = self.keys[slot], self.vals[slot]
        out = np.where(found == keys, out, _NONE)
        rest = np.flatnonzero((found != keys) & (self.vals[slot] != _NONE))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            hit, empty = self.keys[slot[rest]] == keys[rest], self.vals[slot[rest]] == _NONE
            out[rest[hit]] = self.vals[slot[rest[hit]]]
            rest = rest[~hit & ~empty]
        return out.reshape(shape)


class Bpe:
    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import regex

        self.ranks = load_ranks(path or default_ranks_path())
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.pairs = PairTable(self.ranks)
        self.first = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        both = np.arange(1 << 16)
        self.pair_of_bytes = self.pairs(self.first[both >> 8], self.first[both & 255])
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, bytes] = {}  # ids as four bytes each: a third of what tuples take, and nothing for the collector to walk

    # -- merging ---------------------------------------------------------
    def merge_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Token ids of equally long byte rows (a uint8 matrix).

        Every row left merges one pair a round, so all stay equally long.
        """
        n, width = rows.shape
        ids = self.first[rows]
        out: list = [None] * n
        where = np.arange(n)
        ranks = self.pair_of_bytes[(rows[:, :-1].astype(np.int32) << 8) | rows[:, 1:]]
        while len(where):
            if width == 1:
                best = np.full(len(where), _NONE)
            else:
                at = ranks.argmin(1)
                best = ranks.ravel()[np.arange(len(where)) * (width - 1) + at]
            over = best == _NONE
            if over.any():
                for k, row in zip(where[over].tolist(), ids[over], strict=True):
                    out[k] = row
                go = ~over
                if width == 1 or not go.any():
                    break
                ids, ranks, where, at, best = ids[go], ranks[go], where[go], at[go], best[go]
            m = len(where)
            row = np.arange(m)
            flat, places = ids.ravel(), row * width + at
            flat[places] = best
            mask = np.ones(m * width, bool)
            mask[places + 1] = False
            width -= 1
            ids = flat[mask].reshape(m, width)  # compaction
            mask = np.ones(m * width, bool)
            mask[row * width + at] = False
            ranks = ranks.ravel()[mask].reshape(m, width - 1)
            for pair, ok in ((at - 1, at > 0), (at, at < width - 1)):
                r, p = row[ok], pair[ok]
                ranks[r, p] = self.pairs(ids[r, p], ids[r, p + 1])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece, from a heap of (rank, place)."""
        toks = [piece[i : i + 1] for i in range(len(piece))]
        n, get = len(toks), self.ranks.get
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(toks[i] + toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or len(toks[i]) + len(toks[j]) != size or get(toks[i] + toks[j]) != r:
                continue
            toks[i] += toks[j]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] < n and (s := get(both := toks[a] + toks[nxt[a]])) is not None:
                    heapq.heappush(heap, (s, a, len(both)))
        return tuple(self.ranks[t] for t, live in zip(toks, alive, strict=True) if live)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the cache, a matrix for each byte length."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[p] = np.int32(whole).tobytes()
            elif len(raw) > LONG_PIECE:
                self.cache[p] = np.array(self.merge_long(raw), np.int32).tobytes()
            else:
                by.setdefault(len(raw), []).append((p, raw))
        for width, group in by.items():
            for k in range(0, len(group), step := max(1, 200_000 // width)):
                part = group[k : k + step]
                rows = np.frombuffer(b"".join(raw for _, raw in part), np.uint8).reshape(len(part), width)
                self.cache.update((p, ids.tobytes()) for (p, _), ids in zip(part, self.merge_rows(rows), strict=True))

    # -- texts -----------------------------------------------------------
    def units(self, text: str) -> list[str]:
        """The text in parts that the pattern splits independently of each other.

        Where no two white-space characters meet, a piece can only cross neither
        the place before a space nor either side of a line feed.  Other texts are
        one unit for each piece.
        """
        if "\0" in text or _DOUBLE_SPACE(text):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; only one group of texts is in pieces at a time."""
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.flatnonzero(np.diff(ends // GROUP_CHARS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            yield from self._group(texts[a:b])

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        units = [self.units(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        known = self.cache
        new = {u: self.split(u) for u in set().union(*units).difference(known)}
        self.learn({p for ps in new.values() for p in ps if p not in known})
        get = known.__getitem__
        for u, ps in new.items():
            if u not in known:
                known[u] = b"".join(map(get, ps))
        return [np.frombuffer(b"".join(map(get, us)), np.int32) for us in units]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encoded(texts)]

    def count_batch(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.encoded(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every whole text."""

    def make():
        bpe = Bpe(ranks_path)
        return lambda ids, texts: {id_col: ids, "ids": bpe.encode_batch(texts)}

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(id, decoded binary) of rows of token ids; null ids give no bytes."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        bpe = Bpe(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return df.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded binary")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""

    def make():
        bpe = Bpe(ranks_path)

        def kernel(ids, texts):
            n, a, b = [], [], []
            for ids_of in bpe.encoded(texts):
                toks = ids_of.tolist()
                n.append(len(toks))
                a.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, toks)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(toks)).hexdigest())
            return {id_col: ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return kernel

    return map_texts(df, id_col, text_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
