"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: str | Column, digits: int = 6) -> Column:
    """A double rounded for comparison, with -0.0 as 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def words_of(col: str | Column) -> Column:
    """Lower-case a-z words; every other character separates."""
    return F.filter(F.split(F.lower(col), "[^a-z]+"), lambda w: w != "")


def without_markup(col: str | Column) -> Column:
    """Tags, wiki links, templates and character entities removed, in that order."""
    c = F.regexp_replace(col, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    c = F.regexp_replace(c, r"\[\[([^\]]+)\]\]", "$1")
    c = F.regexp_replace(c, r"\{\{[^}]+\}\}", " ")
    return F.regexp_replace(c, r"&[a-z]+;", " ")


def norm_lemma(col: str | Column) -> Column:
    """Trimmed, lower case, white space and hyphens as underscores."""
    return F.translate(F.regexp_replace(F.lower(F.trim(col)), r"\s+", "_"), "-", "_")


def is_synset_id(col: str | Column) -> Column:
    """At least three dot-separated parts, the last of digits."""
    return F.col(col).rlike(r"^[^.]*(\.[^.]*)+\.[0-9]+$") if isinstance(col, str) else col.rlike(r"^[^.]*(\.[^.]*)+\.[0-9]+$")


def key_ladder(col: str | Column) -> Column:
    """Key variants in order of preference, without repeats or empty ones."""
    raw = F.trim(col)
    low = F.lower(raw)
    plain = F.regexp_replace(low, r"[^a-z0-9_\s]", "")
    tries = F.array(raw, low, F.translate(low, " ", "_"), F.translate(low, "_", " "), plain, F.translate(plain, " ", "_"))
    return F.array_distinct(F.filter(tries, lambda k: k != ""))


def interval_width(lo: Column, hi: Column) -> Column:
    return F.greatest(hi - lo, F.lit(0.0))


def interval_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """2 |a and b| / (|a| + |b|); 0 if they don't overlap or are empty, null if a bound is null."""
    inter = F.least(hi1, hi2) - F.greatest(lo1, lo2)
    both = interval_width(lo1, hi1) + interval_width(lo2, hi2)
    known = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()  # least and greatest pass over nulls
    return F.when(known, F.when((inter <= 0) | (both <= 0), 0.0).otherwise(2 * inter / both))


def ball_distance(u: Column, v: Column) -> Column:
    """Distance in the Poincare ball of two arrays of doubles, from |u-v|, |u| and |v|."""
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    d = F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.acosh(1 + 2 * d / ((1 - sq(u)) * (1 - sq(v))))


# -- fuzzy logic ----------------------------------------------------------------
def _stable(x: Column, eps: float) -> Column:
    return x * (1 - eps) + eps if eps else x


def f_and(x: Column, y: Column, eps: float = 0.0) -> Column:
    return _stable(x, eps) * _stable(y, eps)


def f_not(x: Column) -> Column:
    return 1 - x


def f_implies(x: Column, y: Column, eps: float = 0.0) -> Column:
    """Reichenbach: 1 - x + x y."""
    a = _stable(x, eps)
    return 1 - a + a * (y * (1 - eps) if eps else y)


def pmean_error(x: Column, p: int = 2) -> Column:
    """1 - (mean of (1 - x)^p)^(1/p): an aggregate; null for no rows."""
    return 1 - F.pow(F.avg(F.pow(1 - x, F.lit(p))), F.lit(1.0 / p))
