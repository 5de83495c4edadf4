"""Exact quantiles by counted values equal SQL with one group of nearly all rows; sketches can be merged and keep their error."""

import duckdb
from pyspark.sql import functions as F

from roomflow.operators import profile


def test_exact_with_a_hot_group(spark):
    rows = spark.range(8, 20000, 1, 7).select(F.when(F.col("id") % 50 == 0, F.lit("rare")).when(F.col("id") % 777 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"), F.when(F.col("id") % 13 != 0, F.round(F.exp(F.randn(5)) * 100, 1)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 4.0), ("void", None)], "g string, v double"))
    held = rows.toPandas()  # noqa: F841  read by DuckDB
    want = {g: (n, q) for g, n, q in duckdb.sql("SELECT g, count(*), quantile_cont(v, [0, 0.1, 0.5, 0.99, 1]) FROM held GROUP BY g").fetchall()}
    got = {r.g: (r.n, r.q) for r in profile.group_quantiles(rows.repartition(11), "v", [0, 0.1, 0.5, 0.99, 1], ["g"], "q").collect()}
    assert set(got) == set(want) and got["void"][1] is None
    for g, (n, q) in want.items():
        assert got[g][0] == n and (q is None or all(abs(a - b) < 1e-9 for a, b in zip(got[g][1], q, strict=True)))
    assert profile.group_quantiles(rows.where("false"), "v", [0.5], ["g"]).count() == 0


def test_sketches(spark):
    batches = [spark.range(i * 5000, (i + 1) * 5000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 20000).cast("double").alias("v")) for i in range(4)]
    kept = None
    for b in batches:
        own = profile.sketches(b, "v", ["g"])
        kept = own if kept is None else kept.unionByName(own)
    row = profile.sketch_quantiles(kept, [0.1, 0.5, 0.9], ["g"]).first()
    assert row.n == 20000 and all(abs(q / 20000 - s) < 2 * profile.SKETCH_ERROR for q, s in zip(row.quantiles, (0.1, 0.5, 0.9), strict=True))
