"""Shared folder for intermediate tables, and global row numbers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where a local session names none, a folder in its warehouse. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.stages"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver found it; clusters use --py-files.

    Arrow batches get 1000 rows instead of Spark's default (a setting of the session's own stays), so that long texts fit in memory.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


class Stage:
    """Writes tables to the shared folder and reads them back, which cuts lineage and survives lost executors.

    A table is complete or absent (Spark's commit protocol), and any executor can read it again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all other tables of this stage."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        self.drop(*{s.getPath().getName() for s in there} - set(names))


def numbered(df: DataFrame, order: list[Column], stage: Stage, name: str, out: str = "row_number") -> DataFrame:
    """Adds the global row number (from 0) in the given order, without a global window.

    Rows are range partitioned and sorted, numbered inside each partition, and written once; then each
    partition's number gets the count of the rows before it. Only one count per partition is gathered.
    The order must be total up to rows that are equal in every column.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage.write(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    return with_offsets(placed.withColumn("__part", F.shiftrightunsigned("__at", 33)), F.lit(1)).withColumn(
        out, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("__at", "__part", "__before")


def with_offsets(df: DataFrame, weight: Column) -> DataFrame:
    """Adds ``__before``: the weight of all rows in lower ``__part``. One row per partition is broadcast: as many as tasks."""
    return df.join(F.broadcast(part_offsets(df, weight)), "__part")


def part_offsets(df: DataFrame, weight: Column) -> DataFrame:
    from pyspark.sql import Window

    totals = df.groupBy("__part").agg(F.sum(weight).cast("long").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def groups(batches, key: str):
    """Rows with one key as arrays by column, from Arrow batches that are sorted by the key; a group must be of bounded size."""
    import numpy as np

    rest: dict = {}
    for batch in batches:
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if rest:
            columns = {name: np.concatenate([rest[name], c]) for name, c in columns.items()}
        keys = columns[key]
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield {name: c[a:b] for name, c in columns.items()}
        rest = {name: c[cuts[-1] if cuts else 0 :] for name, c in columns.items()}
    if rest and len(rest[key]):
        yield rest
