"""Every query that has SQL gives the rows that DuckDB gives; the others run and have rows."""

import math

import duckdb
import pytest

from roomflow.plans.queries import COVERS, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 6)
        return str(x)[:19] if hasattr(x, "isoformat") else str(x)

    return sorted((tuple(one(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, sf, name, tmp_path, monkeypatch):
    """The others can be written whole, with unique column names. Boosted models get few rounds here; test_boosting and test_models check them."""
    from roomflow.plans import profile_queries

    for setting, value in (("ROUNDS", 3), ("STACK_ROUNDS", 3), ("RUNGS", (1, 2)), ("TRIALS", 2), ("TREES", (5, 10)), ("FIXED_TREES", 10)):
        monkeypatch.setattr(profile_queries, setting, value)
    got = QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    got.write.parquet(str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() > 0


def test_all_covered():
    covered = {c for v in COVERS.values() for c in v}
    for prefix, n in (("P", 11), ("F", 10), ("J", 10), ("A", 29), ("W", 10), ("O", 7), ("U", 7), ("C", 14), ("Q", 9), ("E", 14), ("H", 12)):
        assert not {f"{prefix}{i}" for i in range(1, n + 1)} - covered, prefix


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
