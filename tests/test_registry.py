"""The registered queries: contract, and agreement with their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = [f[:-8] for f in os.listdir("/root/testdata/sf0.001") if f.endswith(".parquet")]
FAST = [
    "daily_sentiment_by_source", "prepare_headlines", "lm_sentiment", "merge_sources", "merge_not_in", "ingest_articles",
    "session_gap_join", "pre_market_filter", "reindex_by_column", "corr_matrix", "collect_by_day", "topn_norms",
    "ts_folds", "auc_rank", "fetch_plan", "stream_dedup",
]


def cell(v):
    return "~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


def test_every_query_has_a_callable_and_sql_keys_match():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert len(sql) >= 95


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = contract.queries()[name](spark, sf_dir)
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
