"""Driver contract: entry runs, every query has an oracle, a sample of keys matches DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from procweave.sources.tables import TABLES


def test_entry_runs(spark, sf_small):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["name", "callers", "complexity_score", "complexity_class"]


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(E.queries()) - set(E.EXTRA_QUERIES) - set(E.oracle_sql())
    assert not rows_only


@pytest.mark.parametrize("key", ["proc_calls", "proc_complexity", "field_usage", "proc_levels", "crawl_summary",
                                 "catalog_fks", "relations", "sql_audit", "semantic_topk", "token_windows"])
def test_oracle_parity_small(spark, sf_small, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = E.queries()[key](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    idx = [names.index(c) for c in cols]
    exp = sorted(tuple(str(row[i]) for i in idx) for row in res.fetchall())
    assert sorted(names) == cols and len(got) == len(exp)
    assert got == exp
