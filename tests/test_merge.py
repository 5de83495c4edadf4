"""The merge table: last of repeated keys wins, repeated and interrupted batches leave one version, only touched buckets are written."""

import pytest

from roomflow.operators import conform
from roomflow.sources.merge import MergeTable, VersionTaken

SCHEMA = conform.schema("id long, area string, note string")


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, area string, note string, at long")


@pytest.fixture
def table(spark, tmp_path):
    return MergeTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)


def test_merge(spark, table):
    assert rows(table) == []
    assert table.merge(batch(spark, (1, "a", "x", 1), (2, "b", "x", 1), (1, "late", "y", 2), (None, "no", "no", 1)), "one", order="at")
    assert rows(table) == [(1, "late", "y"), (2, "b", "x")]
    assert not table.merge(batch(spark, (1, "other", "z", 3)), "one", order="at")  # known
    assert table.merge(batch(spark, (2, "new", "kept?", 1), (3, "c", "first", 1)), "two", columns=["area"])
    assert rows(table) == [(1, "late", "y"), (2, "new", "x"), (3, "c", "first")]  # only area of a known row, all of a new one
    assert rows(table, 0) == [(1, "late", "y"), (2, "b", "x")]
    assert table.merge(spark.createDataFrame([(3, None)], "id long, area string"), "three")
    assert rows(table) == [(1, "late", "y"), (2, "new", "x"), (3, None, "first")]
    assert table.merge(batch(spark, (4, None, None, 1), (4, "set", None, None)), "four", order="at")  # a null order comes first
    assert (4, None, None) in rows(table)
    assert table.merge(batch(spark).where("false"), "none") and len(rows(table)) == 4


def test_only_touched_buckets(spark, table):
    table.merge(batch(spark, *[(i, "a", "b", 1) for i in range(40)]), "all")
    before = table._latest()[1]["buckets"]
    table.merge(batch(spark, (7, "z", "z", 1)), "one row")
    after = table._latest()[1]["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


def test_interrupted_and_repeated(spark, table, monkeypatch):
    table.merge(batch(spark, (1, "a", "x", 1)), "one")
    commit = MergeTable._commit

    def fails(self, base, manifest):
        raise OSError("gone")

    monkeypatch.setattr(MergeTable, "_commit", fails)
    with pytest.raises(OSError):
        table.merge(batch(spark, (1, "b", "x", 1)), "two")
    monkeypatch.setattr(MergeTable, "_commit", commit)
    assert rows(table) == [(1, "a", "x")] and table.versions() == [0]
    assert table.merge(batch(spark, (1, "b", "x", 1)), "two") and rows(table) == [(1, "b", "x")]
    gone = table.vacuum()
    assert len(gone) == 2 and rows(table) == [(1, "b", "x")] and table.versions() == [1]  # the first version's and the interrupted folder
    with pytest.raises(VersionTaken):
        table._commit(0, {"batches": [], "buckets": {}})  # another writer was first


def test_append(spark, table):
    assert table.append(batch(spark, (1, "a", "x", 1), (1, "a", "x", 1)), "one") and table.append(batch(spark, (1, "b", "y", 1)), "two")
    assert not table.append(batch(spark, (9, "b", "y", 1)), "two")
    assert rows(table) == [(1, "a", "x"), (1, "a", "x"), (1, "b", "y")]
    assert rows(table, 0) == [(1, "a", "x"), (1, "a", "x")]
