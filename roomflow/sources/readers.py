"""Sources (S1-S4, S13, S15). Schemas are given, never inferred."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomflow.sources.places import ship

_LOG = logging.getLogger(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, options: Mapping[str, str], name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column. Options (url, user, password) come from the caller's environment."""
    return spark.read.format("jdbc").options(**options, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """Header, UTF-8 with or without mark, line breaks in quotes. A file is one task's work; ``split_csv`` reads large ones."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", separator).csv(path)


def split_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """S2, S3 for large files: the same rows as ``csv`` gives, from files that are read in byte ranges.

    A line starts a record if an even number of quotes stands before it in its file. A first pass counts quotes by range, and a row for each
    range tells how its quotes stand at its start. Then the records of each range are put together where they are read: only the lines before a
    range's first record and those of its last one, which may go on, meet the next range's by a shuffle. The first record of each file is
    its header. Files need a name of their own for their ranges to be told apart.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ranges = lines.groupBy("file", "block").agg(F.sum(F.regexp_count("value", F.lit('"'))).alias("held"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    before = ranges.select("file", "block", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) % 2).cast("int").alias("odd"))
    told = lines.join(F.broadcast(before), ["file", "block"]).select("value", "file", "block", "odd")  # a row for each range
    whole = told.mapInArrow(_records(inside=True), _PIECES).select("value", "first")
    # the end of one range and the start of the next, and ranges without any start between them
    run = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = told.mapInArrow(_records(inside=False), _PIECES).withColumn("record", F.sum((F.col("place") == 2).cast("int")).over(run))
    joined = edges.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "place", "value", "first"))).alias("parts"))
    edged = joined.select(F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"), F.col("parts")[0]["first"].alias("first"))
    body = whole.unionByName(edged).where("NOT first").select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\u0001"}
    return body.select(F.from_csv("value", _ddl(schema), options).alias("row")).select("row.*")


#: ``place``: 0 for a whole record, 1 for lines that go on with a record of an earlier range, 2 for a range's last record. ``first``: a file's header.
_PIECES = "file string, block long, place int, first boolean, value string"


def _records(inside: bool):
    """Lines, in the order of their range, to the whole records inside of ranges or to the two edges of each; holds a batch and a record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd = None, 0
        #: Lines of the open piece, its place, and whether it is its file's first record.
        open_, place, header = [], 1, False

        def piece(values: pa.Array, place: int, first: np.ndarray) -> list[pa.RecordBatch]:
            if (place == 0) != inside or not len(values):
                return []
            n, (file, block) = len(values), now
            columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([place] * n, pa.int32()), pa.array(first), values]
            return [pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])]

        def held(place: int) -> list[pa.RecordBatch]:
            return piece(pa.array(["\n".join(open_)] if open_ else [], pa.string()), place, np.array([header] if open_ else [], bool))

        for batch in batches:
            files, blocks = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = (batch.column("file")[a].as_py(), int(blocks[a]))
                if key != now:
                    yield from held(place)
                    now, odd, open_, place, header = key, batch.column("odd")[a].as_py(), [], 1, False
                lines = batch.column("value").slice(a, b - a)
                sums = np.cumsum(pc.count_substring(lines, '"').to_numpy())
                starts = np.flatnonzero((odd + np.concatenate([[0], sums[:-1]])) % 2 == 0)
                odd = (odd + int(sums[-1])) % 2
                if not len(starts):
                    open_ += lines.to_pylist()
                    continue
                open_ += lines.slice(0, int(starts[0])).to_pylist()
                yield from held(0 if place == 2 else 1)
                top = key[1] == 0 and place == 1  # a file starts with a record
                place, last, header = 2, int(starts[-1]), top and len(starts) == 1
                lists = pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), lines.slice(int(starts[0]), last - int(starts[0])))
                yield from piece(pc.binary_join(lists, "\n"), 0, np.arange(len(lists)) == (0 if top else -1))
                open_ = lines.slice(last).to_pylist()
        yield from held(place)

    return run


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def tolerant(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """A missing source is an empty table of the schema, and is logged."""
    try:
        return spark.read.format(kind).schema(schema).option("header", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        _LOG.warning("source %s is missing", path)
        return spark.createDataFrame([], schema)


#: How a source may be: read whole, not there, in part unreadable, or not readable at all.
WHOLE, MISSING, PARTLY, BROKEN = "whole", "missing", "partly", "broken"
_CORRUPT = "__corrupt"


def tolerant_sources(spark: SparkSession, sources: Mapping[str, tuple[str, str]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of all sources that can be read, with ``data_source``, and a report; no source stops the others.

    ``sources``: name to (kind, path), where kind is ``csv``, ``json`` or ``parquet``. Records of text that don't fit the schema, and Parquet
    files that can't be opened or break off, are left out and counted. The report has for each source its state, files, broken files,
    rows and broken records. It costs a pass over the sources, as any count does; what it counts is what the rows hold.
    """
    kept, reports = [], []
    for name, (kind, path) in sources.items():
        try:
            part, wrong = _forgiving(spark, kind, path, schema)
            files = part.inputFiles()
        except PySparkException as e:
            missing = isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"
            _LOG.warning("source %s: %s", name, str(e).splitlines()[0])
            reports.append(spark.createDataFrame([(name, MISSING if missing else BROKEN, 0, 0, 0, 0)], _REPORT))
            continue
        each = part.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("seen"), F.sum(wrong.cast("int")).alias("wrong"))
        sums = each.agg(F.count("*").alias("full"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"))
        silent, broken = F.lit(_unreadable(spark, files, each) if kind == "parquet" else 0), F.col("wrong")
        state = F.when((silent == 0) & (broken == 0), WHOLE).when(F.col("seen") > broken, PARTLY).otherwise(BROKEN)
        reports.append(sums.select(F.lit(name).alias("data_source"), state.alias("state"), F.lit(len(files)).cast("long").alias("files"), silent.cast("long").alias("broken_files"), (F.col("seen") - broken).alias("rows"), broken.alias("broken_records")))
        kept.append(part.where(~wrong).select(*schema.names).withColumn("data_source", F.lit(name)))
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("data_source", T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b), kept, empty), reduce(lambda a, b: a.unionByName(b), reports, spark.createDataFrame([], _REPORT))


_REPORT = "data_source string, state string, files long, broken_files long, rows long, broken_records long"


def _unreadable(spark: SparkSession, files: Sequence[str], each: DataFrame) -> int:
    """Parquet files without rows that don't end as such files do. Only files that gave no rows are looked at."""
    seen = {r[0] for r in each.select("file").collect()}  # names, as many as the listing has
    silent = [f for f in files if f not in seen]
    if not silent:
        return 0
    ending = F.decode(F.expr("right(content, 4)"), "ISO-8859-1")
    return spark.read.format("binaryFile").load(silent).where((F.col("length") < 12) | (ending != "PAR1")).count()


def _forgiving(spark: SparkSession, kind: str, path: str, schema: T.StructType) -> tuple[DataFrame, Column]:
    """Rows of a source and which of them are broken records."""
    if kind == "parquet":
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path), F.lit(False)
    wider = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.schema(wider).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("ignoreCorruptFiles", True)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    whole = F.concat_ws("", *[F.col(f"`{n}`").cast("string") for n in schema.names])  # what a record is worth shows only when all of it is parsed
    return reader.format(kind).load(path), F.col(_CORRUPT).isNotNull() | (F.length(whole) < 0)


def ranged(df: DataFrame, key: str, ranges: Sequence[tuple[int, int]], link: str | None = None, prefix: str = "http") -> DataFrame:
    """Rows in any of the key ranges whose link starts with a prefix, in key order; the filters reach the scan."""
    inside = reduce(lambda a, b: a | b, [F.col(key).between(a, b) for a, b in ranges])
    if link:
        inside = inside & F.col(link).startswith(prefix)
    return df.where(inside).orderBy(key)


def links(spark: SparkSession, path: str) -> DataFrame:
    """One link a line, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("link")).where("link <> ''")
