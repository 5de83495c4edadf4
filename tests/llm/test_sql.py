"""Queries with SQL against DuckDB on the same tables."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["op3_near_documents", "op6_url_rules", "op9_near_vectors", "op11_filter_audit", "op13_merkle"])
def test_same_rows(spark, sf, name):
    from roomflow.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf).toPandas(), c.execute(ORACLE_SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def rows(df):
        return list(tuple(None if x is None or x != x else str(x) for x in r) for r in df[names].astype(object).itertuples(index=False))

    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
