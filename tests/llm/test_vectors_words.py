import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from entaila.llm import binary_codes, spelling, whitening

ODD_VECTORS = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, math.nan, 0.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]


def vectors(spark, rows, kind="double", first=0):
    data = [(i, v, "x", 1.0) for i, v in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, id string, v double")


# -- whitening ------------------------------------------------------------------------
def whitened(rows):
    """Brute force over clean rows: {(row, component): ...} by numpy's eigenvectors."""
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v[:, ::-1][:, :4] / np.sqrt(e[::-1][:4]), e[::-1][:4] / e.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 6)) @ np.diag([3, 2.5, 2, 1, 0.5, 0.2]))]
    rows += [(900 + k, rows[3][1]) for k in range(200)] + [(3, rows[4][1]), (None, rows[5][1])]
    n, deviation, white, share = whitened(rows)
    got = whitening.report(vectors(spark, rows + [(5000 + k, v) for k, v in enumerate(ODD_VECTORS) if v != [0.0, 0.0, 0.0]])).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    sign = {}
    want = {}
    for (i, _), d, w in zip(rows, deviation, white, strict=True):
        for c in range(4):
            want.setdefault((i, c + 1), []).append((int(d), w[c]))
    for r in got:
        assert abs(r.explained - share[r.component - 1]) < 1e-12
        d, w = min(want[r.vec_id, r.component], key=lambda x: (x[0] != r.deviation, abs(abs(x[1]) - abs(r.whitened))))
        assert d == r.deviation and abs(abs(w) - abs(r.whitened)) < 1e-9
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)


def test_whitening_odd_tables(spark):
    assert whitening.report(vectors(spark, [(k, v) for k, v in enumerate(ODD_VECTORS[:2])])).count() == 0
    equal = whitening.report(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in equal] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = whitening.report(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()  # one direction
    assert all((r.whitened is None) == (r.component > 1) and (r.component == 1 or r.explained == 0) for r in flat) and flat[0].identity_error < 1e-12
    x = np.array([[1 << 40, 5], [-(1 << 41), 7]])
    assert whitening.deviations(x, 2, [-(1 << 40), 12]).tolist() == [(2 * (1 << 40) + (1 << 40)) ** 2 + 4, (-(1 << 42) + (1 << 40)) ** 2 + 4]


# -- nearest neighbours ------------------------------------------------------------------
def nearest(rows, every, k):
    out = []
    for a, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            score = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0) for b, (j, w) in enumerate(rows) if a != b]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(score)[:k])]
    return sorted(out, key=str)


def unordered_sums(rows):
    return [tuple(r[:3]) + (round(r[3], 9),) for r in rows]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_neighbours_equal_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 24)).astype(np.float32).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [(1000 + k, rows[20][1]) for k in range(300)]  # many copies, of queries and of candidates
    rows += [(40, rows[7][1]), (None, rows[40][1])]  # a repeated id, a null id
    monkeypatch.setattr(binary_codes, "SEGMENT_BYTES", 64 * 24 * 8)
    monkeypatch.setattr(binary_codes, "BLOCK_BYTES", 10 * 24 * 8)
    odd = [(2000 + 20 * k, (v or [])[:3] and v + [0.0] * 21 if v and len(v) == 3 else v) for k, v in enumerate(ODD_VECTORS)]
    got = binary_codes.neighbours(vectors(spark, rows + odd, kind)).collect()
    assert unordered_sums(sorted([tuple(r) for r in got], key=str)) == unordered_sums(nearest(rows, 20, 20))


def test_neighbours_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (20, [1.0, 0.0])]
    got = sorted(tuple(r) for r in binary_codes.neighbours(vectors(spark, rows)).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 2, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 2, -1.0)]
    assert binary_codes.neighbours(vectors(spark, [(20, [1.0, 0.0])])).count() == 0
    assert binary_codes.neighbours(vectors(spark, [(20, None), (1, [])])).count() == 0


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64))
    centre, turn = v.mean(0), binary_codes.rotation(256, 64, 1)
    codes, scale, slack = binary_codes.encode(v, centre, turn)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    error = np.abs((q @ centre)[:, None] + (q @ turn.T) @ signs.T * scale - q @ v.T)
    bound = np.sqrt((q * q).sum(1))[:, None] * slack
    assert codes.shape == (2000, 32) and (error > 3 * bound).mean() < 0.005 and (error > bound).mean() > 0.1


# -- spelling variants ----------------------------------------------------------------------
def counted(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out, word = Counter(), []
    for i, text in texts:
        for c in [*(text or "").translate(low), " "]:
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                word.append(c)
            elif word:
                w, word = "".join(word), []
                h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
                out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return out


def related(counts):
    """{word: (form, root, n, n_near, form_n)} by comparing every word with every other."""
    words = [w for w, n in counts.items() if n >= 3 and len(w) >= 5]
    cut = lambda w, k: w[:k] + w[k + 1 :]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(cut(b, k) == a for k in range(len(b)))

    form, count = {}, {}
    for w in words:
        ns = [x for x in words if x != w and near(x, w)]
        best = min(ns, key=lambda x: (-counts[x], x), default=None)
        count[w], form[w] = len(ns), best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], count[w], counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 64])
def test_spelling_equals_brute_force(spark, monkeypatch, bucket):
    r = random.Random(6)
    letters = "aabbbéÿ"
    base = ["".join(r.choice(letters) for _ in range(r.choice((5, 6, 7, 9)))) for _ in range(40)]
    pool = base + [w[:k] + x + w[k + d :] for w in base for k in (0, 2, len(w)) for x in ("", "a", "é") for d in (0, 1)] + ["hello", "helllo", "hellllo", "aaaaa", "aaaaaa", "x" * 90, "x" * 91, "x" * 40 + "y" + "x" * 49]
    weight = [1 << r.randrange(7) for _ in pool]
    texts = [(k, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(pool, weight, k=60)) + r.choice((".", " 1", "Ā", "×z "))) for k in range(60)]
    texts += [(None, texts[0][1]), (7, None), (8, ""), (9, "  "), (3, "Hello " * 3000), (3, "aaaaa,aaaaa;ÀÀÀÀÀ àààààà")]
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n long")
    counts = counted(texts)
    assert {w.word: w.n for w in spelling.word_counts(df).collect() if w.word} == {w: n for w, n in counts.items() if w}
    assert {w.word: tuple(w)[1:] for w in spelling.report(df).collect()} == related(counts)
    assert spelling.report(df.limit(0)).count() == 0


def test_spelling_of_few_long_words(spark):
    words = ["q" * 80_000, "q" * 79_999 + "p", "q" * 100 + "z" + "q" * 79_899, "r" * 5000, "q" * 79_999]
    df = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.n_near, r.best) for r in spelling.near_words(df).collect()}
    assert got == {words[0]: (3, words[4]), words[1]: (2, words[4]), words[2]: (2, words[4]), words[3]: (0, None), words[4]: (3, words[2])}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(8)
    values = rng.permutation(37)
    lo, low = rng.integers(0, 37, 50), rng.integers(0, 37, 50)
    hi, high = lo + rng.integers(0, 38 - lo), low + rng.integers(0, 38 - low)
    q, v = spelling.Wavelet(values).report(lo, hi, low, high)
    want = {(k, x) for k in range(50) for x in values[lo[k] : hi[k]].tolist() if low[k] <= x < high[k]}
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == want and len(q) == len(want)
