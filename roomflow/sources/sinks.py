"""Sinks (S5-S12, S14, S15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str) -> None:
    """S5. The path must not be one that ``df`` reads."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """S6."""
    df.write.mode("append").parquet(path)


def upsert(target: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values where the key exists, new rows where it doesn't; other columns of known rows stay. The caller writes it to a new path."""
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    joined = target.join(fresh, key, "full")
    return joined.select(key, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns if c != key])


def csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """S3, S14."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", separator).csv(path)


def csv_for_people(df: DataFrame, path: str) -> None:
    """Every file starts with the mark by which spreadsheets tell UTF-8."""
    first = df.columns[0]
    csv(df.withColumnRenamed(first, f"\ufeff{first}"), path)


def nested_json(df: DataFrame, path: str) -> None:
    """One document a line."""
    df.write.mode("overwrite").json(path)


def quarantine(df: DataFrame, path: str, reason: str = "reject_reason") -> None:
    """Accepted and rejected rows go to tables of their own, ``accepted=true`` and ``accepted=false`` of the path, in one pass."""
    df.withColumn("accepted", F.col(reason).isNull()).write.mode("overwrite").partitionBy("accepted").parquet(path)


def overwrite_unless_empty(df: DataFrame, path: str) -> bool:
    """Keeps what is there when the result is empty."""
    if df.isEmpty():
        return False
    overwrite(df, path)
    return True


def key_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are null or repeat; empty when the key holds."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(missing | (F.col("n") > 1))


def lines(df: DataFrame, column: str, path: str) -> None:
    """S15."""
    df.select(column).write.mode("overwrite").text(path)
