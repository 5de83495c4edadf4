"""Where intermediate files go."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a local session works in its warehouse; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.stages"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several steps read to the shared folder, and reads it back; it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``stored``, in buckets of a column: groups and joins on that column, among others, need no shuffle of what was stored."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(parts, column).write.bucketBy(parts, column).sortBy(column).format("parquet")
    rows.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only; the files stay
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote for these rows, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver found it; clusters use --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
