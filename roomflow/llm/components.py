"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import Stage

#: Links of one task.
SHARE = 1 << 16


def _contract(batches):
    """Replaces a task's links by links of each node to the smallest node that it reaches within the task."""
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := top.setdefault(i, i)) != i:
            top[i] = i = top[up] = top.get(up, up)
        return i

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            top[high] = low
    rows = [(find(i), i) for i in top]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame, stage: Stage, name: str = "component") -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node that it reaches.

    Each task first contracts its own links (there are fewer of them than documents, and a task holds its share only). What is left is
    dealt over as many tasks as there are shares of ``SHARE`` links, however many partitions shuffles have, and contracted again; links
    that are no more than one share are done with that. Then each round a node takes the smallest label among its own and its neighbours', and after that its label's label (pointer jumping), until no
    label changes. Labels are written each round; nothing but whether any has moved comes to the driver. Most nodes of a large component
    soon have one neighbour and one label in common; both joins are inner ones with nothing above that needs their keys together, so
    Spark's skew handling deals such a key's rows over many tasks. Repeated links and links of a node with itself are harmless; rows
    with a null are passed over; an empty table gives an empty result.
    """
    star = stage.write(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(_contract, "a long, b long"), f"{name}-stars")
    tasks = int(star.count() // SHARE + 1)
    star = star.coalesce(tasks).mapInArrow(_contract, "a long, b long")
    if tasks == 1:
        done = stage.write(star.select(F.col("b").alias("node"), F.col("a").alias("component")), f"{name}-1")
        stage.drop(f"{name}-stars")
        return done
    star = star.distinct()
    both = stage.write(star.select(F.col("a").alias("node"), F.col("b").alias("other")).union(star.select("b", "a")).union(star.select("b", "b")).union(star.select("a", "a")).distinct().coalesce(4 * tasks), f"{name}-edges")
    stage.drop(f"{name}-stars")
    labels = both.select("node").distinct().withColumn("label", F.col("node"))
    turn = 0
    while True:
        known = labels.select(F.col("node").alias("other"), "label")
        low = both.join(known, "other").groupBy("node").agg(F.min("label").alias("low"), F.max(F.when(F.col("node") == F.col("other"), F.col("label"))).alias("old"))
        low = stage.write(low.coalesce(tasks), f"{name}-low-{turn}")
        turn += 1
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = stage.write(low.join(up, "low").select("node", F.col("up").alias("label"), (F.col("up") < F.col("old")).alias("moved")).coalesce(tasks), f"{name}-{turn}")
        moved = not new.where("moved").isEmpty()
        stage.drop(f"{name}-{turn - 1}", f"{name}-low-{turn - 1}")
        labels = new.select("node", "label")
        if not moved:
            stage.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")
