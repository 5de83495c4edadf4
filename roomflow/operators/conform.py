"""Schema shaping (P1-P11), filters (F1-F10) and value-independent column choices."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings that mark a row as unclassified.
UNCLASSIFIED = ("Other", "other", "Unknown", "unknown", "OTHER")


def schema(text: str) -> T.StructType:
    """A schema from 'name type, name type'; names with blanks stand in back quotes. Needs no session."""
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(name.strip("`"), kinds[kind]) for name, kind in (f.rsplit(" ", 1) for f in text.split(", "))])


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that exist."""
    return df.withColumnsRenamed(dict(names))


def select_present(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """P2."""
    return df.select(*[c for c in order if c in df.columns])


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order and types; missing ones are null. Names are resolved without case (P5)."""
    found = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{found[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in found else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])


def tag(df: DataFrame, source: str, name: str = "data_source") -> DataFrame:
    """P4."""
    return df.withColumn(name, F.lit(source))


def resolve(df: DataFrame, *aliases: str) -> str | None:
    """P5: the first column that equals an alias without case."""
    known = {c.lower(): c for c in df.columns}
    return next((known[a.lower()] for a in aliases if a.lower() in known), None)


def snake_names(df: DataFrame) -> DataFrame:
    """P6."""
    return df.toDF(*[re.sub(r"[ -]", "_", c.strip().lower()).replace("%", "percent") for c in df.columns])


def project(df: DataFrame, mapping: Mapping[str, Column | str | None], target: T.StructType) -> DataFrame:
    """One source into a unified schema; unmapped columns are null. A text names a source column."""
    def of(field: T.StructField) -> Column:
        c = mapping.get(field.name)
        c = F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
        return c.try_cast(field.dataType).alias(field.name)

    return df.select(*[of(f) for f in target])


def millions(c: Column) -> Column:
    """P11."""
    return c / 1e6


def price_interval(df: DataFrame, price: str, low: float = 50_000, high: float = 1e9) -> DataFrame:
    """open interval."""
    return df.where((F.col(price) > low) & (F.col(price) < high))


def with_guests(df: DataFrame, guests: str, name: str) -> DataFrame:
    """F2."""
    return df.where((F.col(guests) > 0) & (F.length(name) > 1))


def classified(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """drops rows with an unclassified spelling in any column; null is kept."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*UNCLASSIFIED), F.lit(False)) for c in columns]))


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that are worked out once for each row, however many later filters and columns read them.

    Spark pastes an expression into every place that reads it. Long ones then make methods of over 8000 bytes of byte code, which the JVM
    runs uncompiled. An explode over an array of one struct stops the pasting and is cheap.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    held = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once"))
    return held.select(*kept, *[F.col(f"__once.`{n}`").alias(n) for n in columns])


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F4, F7."""
    return df.na.drop("any", subset=list(columns))


def with_reject_reason(df: DataFrame, location: str, area: str, most: float = 120) -> DataFrame:
    """Null reason means accepted. A missing area is kept."""
    place = F.col(location)
    reason = F.when(place.isNull() | (place == "Unknown"), F.lit("location")).when(F.coalesce(F.col(area) > most, F.lit(False)), F.lit("area"))
    return df.withColumn("reject_reason", reason)


def rated(df: DataFrame, price: str, rating: str) -> DataFrame:
    """F6."""
    return df.where((F.col(price) > 0) & (F.col(rating) <= 10))


def detail_link(url: Column, host: str, path: str) -> Column:
    """F8: http or https, this host exactly, and a path that matches."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) == host) & F.try_parse_url(url, F.lit("PATH")).rlike(path), F.lit(False))


def numeric_columns(df: DataFrame) -> list[str]:
    """F9."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """F10."""
    return [c for c in df.columns if c.startswith(prefixes)]
