"""Queries against DuckDB on the smallest tables, where these are present."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__
from entaila import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: a few of each kind; all are compared by the driver
NAMES = ["token_counts", "chunks", "ppmi", "pair_probabilities", "interval_weighted", "wup_similarity", "bins_spread", "codewords", "closure", "katz_complete", "sense_candidates", "token_pick", "interval_features", "paired_stats", "axiom_breakdown", "pivot_delta", "schema_union", "closure_vectors", "diagnostics", "feature_bundle", "bundle_labels", "interval_features_path", "poincare_groups", "append_scalar", "topk_associates", "pseudo_vectors", "byte_prefix_whole", "closure_sat", "pair_snapshots", "interval_through", "chain_token_pick", "sense_bias", "resolve_ways", "best_ways", "svd_trade"]


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in res.fetchall())


def test_registration():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_places_let_every_rule_decide():
    """The pairs of places have ways of none to three steps, and distance, similarity, bias and order each settle some."""
    import duckdb

    from entaila.plans import ways

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    steps = dict(con.execute(f"SELECT path_len, count(*) FROM ({catalogue.ORACLES['best_ways']}) GROUP BY 1").fetchall())
    assert set(steps) == {None, 0, 1, 2, 3}
    sql = catalogue.ORACLES["resolve_ways"]
    tiers = {t for (t,) in con.execute(sql[: sql.rindex("SELECT pair_id")] + "SELECT DISTINCT tier FROM sc").fetchall()}
    assert tiers == {1, 2, 3}
    free = con.execute(sql.replace("d + bias", "d").replace("bias - wup", "-wup")).fetchall()
    assert len(set(con.execute(sql).fetchall()) - set(free)) > 5
    assert con.execute(f"SELECT count(DISTINCT bias) FROM ({catalogue.ORACLES['sense_bias']})").fetchone()[0] >= 3 and ways.__doc__
