"""Word shingles as hashes."""

from __future__ import annotations

import numpy as np

from .hashing import prefix_sums, spans_hash
from .phrase_index import words

#: Bytes hashed at once; longer word lists are cut with an overlap.
BLOCK = 1 << 20


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of n words.

    A text of fewer words, but not none, is one shingle; one without words has
    no shingles.
    """
    lists = [words(t) for t in texts]
    out: list[np.ndarray] = []
    batch: list[list[bytes]] = []
    size = 0
    for ws in lists:
        big = sum(map(len, ws)) + len(ws)
        if big > BLOCK:
            out += _sets(batch, n)
            step = 100_000
            parts = [_sets([ws[k : k + step + n - 1]], n)[0] for k in range(0, max(len(ws) - n + 1, 1), step)]
            out.append(np.unique(np.concatenate(parts)))
            batch, size = [], 0
            continue
        batch.append(ws)
        size += big
        if size > BLOCK:
            out += _sets(batch, n)
            batch, size = [], 0
    return out + _sets(batch, n)


def _sets(lists: list[list[bytes]], n: int) -> list[np.ndarray]:
    count = np.array([len(x) for x in lists], np.int64)
    total = int(count.sum())
    if not total:
        return [np.zeros(0, np.uint64) for _ in lists]
    data = np.frombuffer(b" ".join([w for x in lists for w in x]), np.uint8)
    space = np.flatnonzero(data == 32)
    begin, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    made = np.where(count > 0, np.maximum(count - n + 1, 1), 0)  # shingles of a text
    first = np.cumsum(count) - count
    at = np.arange(int(made.sum())) + np.repeat(first - (np.cumsum(made) - made), made)
    last = np.minimum(at + n - 1, np.repeat(first + count - 1, made))
    h = spans_hash(prefix_sums(data), begin[at], end[last])
    return [np.unique(x) for x in np.split(h, np.cumsum(made)[:-1])]
