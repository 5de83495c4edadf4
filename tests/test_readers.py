"""CSV in byte ranges equals the reader of whole files; broken sources leave the others whole."""

import csv
import random

import pytest

from roomflow.operators import conform
from roomflow.sources import readers

SCHEMA = conform.schema("id long, text string, more string")


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "2000b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_csv(spark, tmp_path, small_ranges, end):
    draw = random.Random(1)
    pieces = ["plain", 'quo"ted', "a, comma", "two\nlines", '"\n"', "", "é😀", "three\n\nlines, \"x\"", " blanks "]
    table = [[i, draw.choice(pieces) + draw.choice(pieces), draw.choice(pieces)] for i in range(600)]
    for folder, terminator in (("given", end), ("plain", "\n")):
        (tmp_path / folder).mkdir()
        for name in ("a", "b"):
            with open(tmp_path / folder / f"{name}.csv", "w", newline="", encoding="utf-8-sig" if name == "a" else "utf-8") as f:
                out = csv.writer(f, lineterminator=terminator)
                out.writerow(["id", "te\nxt" if name == "b" else "text", "more"])
                out.writerows(table[:300] if name == "a" else table[300:])
    path = str(tmp_path / "given")  # the reader of whole files takes the end of a line into an empty last column, so it gets plain ends
    got, want = readers.split_csv(spark, path, SCHEMA), readers.csv(spark, str(tmp_path / "plain"), SCHEMA)
    assert spark.read.text(path).rdd.getNumPartitions() > 6  # files are in ranges
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert len(rows(want)) == 600 and rows(got) == rows(want)


def test_split_csv_shuffles_edges_only(spark, tmp_path, small_ranges):
    """Records, which all have a line break, are put together where they are read; what is shuffled does not grow with them."""
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerows([["id", "text", "more"], *[[i, f"two\nlines {i}", "x" * 40] for i in range(3000)]])
    got = readers.split_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"two\nlines {i}", "x" * 40) for i in range(3000))
    plan = got._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    shuffled, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            waiting.append(node.plan())
        if node.nodeName() == "Exchange":
            shuffled.append(int(node.metrics().apply("shuffleRecordsWritten").value()))
    assert shuffled and max(shuffled) < 200


def test_tolerant_sources(spark, tmp_path):
    schema = conform.schema("id long, text string")
    good = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    good.write.parquet(str(tmp_path / "good"))
    good.repartition(2, "id").write.parquet(str(tmp_path / "torn"))
    parts = sorted((tmp_path / "torn").glob("part-*.parquet"))
    victim = next(p for p in parts if spark.read.parquet(str(p)).count())
    victim.write_bytes(victim.read_bytes()[:40])
    for p in (tmp_path / "torn").glob(".*.crc"):
        p.unlink()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "lines.csv").write_text("id,text\n1,fine\nx,wrong\n3,\"also\nfine\"\n")
    (tmp_path / "docs.json").write_text('{"id": 1, "text": "fine"}\n{"id": 2, "text"\n')
    sources = {n: (k, str(tmp_path / f)) for n, k, f in (("good", "parquet", "good"), ("torn", "parquet", "torn"), ("bad", "parquet", "bad"), ("lines", "csv", "lines.csv"), ("docs", "json", "docs.json"), ("nowhere", "csv", "nowhere.csv"))}
    rows, report = readers.tolerant_sources(spark, sources, schema)
    held = {}
    for r in rows.collect():
        held.setdefault(r.data_source, []).append((r.id, r.text))
    assert sorted(held["good"]) == [(1, "a"), (2, "b")] and sorted(held["lines"]) == [(1, "fine"), (3, "also\nfine")] and held["docs"] == [(1, "fine")]
    told = {r.data_source: r for r in report.collect()}
    assert {n: r.state for n, r in told.items()} == {"good": "whole", "torn": "partly" if held.get("torn") else "broken", "bad": "broken", "lines": "partly", "docs": "partly", "nowhere": "missing"}
    assert told["torn"].broken_files == 1 and told["torn"].rows == len(held.get("torn", [])) and told["bad"].rows == 0
    assert (told["lines"].rows, told["lines"].broken_records, told["docs"].broken_records) == (2, 1, 1)
