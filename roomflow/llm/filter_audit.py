"""Audit of how filters interact, kept up to date by a stream that takes back what later files prove wrong.

All files of a table come as available-now micro-batches. Four filters judge a text by itself. The fifth one fails a text that has a copy
with a smaller id, so its verdict may change with every file: keyed state holds, for each text, the smallest id so far and how its rows were
counted. A smaller id takes that place, and the rows it drives out are retracted from their part's counters and counted again as copies.
Each batch's changes go to a ledger in a folder of their own, which a repeated batch overwrites. Counters are by part, labels and the set of
filters that fail, 32 at most; every order of the filters, and what each one removes in it, follows from these.

Before the shuffle each task drops the copies it has seen itself, so a text with very many copies is a few rows of each task. Texts are known
by 128 bits of their hash, and those with one remainder share a state, which bounds the number of groups by the input's size.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.llm.common import Stage, ship

FILTERS = "ABCDE"
COPY = 16
_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
#: Micro-batches of one run; bytes of input for one group of texts; texts that a task remembers before it sends them on.
BATCHES, GROUP_BYTES, REMEMBERED = 4, 1 << 18, 200_000
_CANDIDATES = "bucket long, key binary, id long, part string, mask int, quality int, toxic int, n long"
_CHANGES = "part string, mask int, quality int, toxic int, n long"


def failing(data: bytes, characters: int) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, signs."""
    words = data.split()  # bytes split at ASCII white space only
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _UPPER))) > 2 * characters) << 2
        | (len(data.translate(None, _SIGNS)) < len(data)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        keys, masks = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            keys.append(hashlib.blake2b(data, digest_size=16).digest())
            masks.append(failing(data, len(text or "")))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "part": batch.column("part"), "mask": pa.array(masks, pa.int32()), "key": pa.array(keys, pa.binary())})


def place(held: dict, key: bytes, new: tuple) -> tuple | None:
    """Puts (id, mask, quality, toxic, {part: rows}) in place if its id is the smallest of the text; returns what isn't smallest, if any."""
    old = held.get(key)
    if old is None or new[0] < old[0]:
        held[key] = new
        return old
    if new[0] > old[0]:
        return new
    for part, n in new[4].items():  # the same text under one id again
        old[4][part] = old[4].get(part, 0) + n
    return None


def _combined(buckets: int):
    """A task's smallest id of each text, and counts of the rows that are copies already; counts have no key."""
    def flush(held: dict, counts: Counter, task: int) -> pa.RecordBatch:
        rows = [(int.from_bytes(key[:8], "big") % buckets, key, x[0], part, *x[1:4], n) for key, x in held.items() for part, n in x[4].items()]
        rows += [((zlib.crc32(repr(k).encode()) + task) % buckets, b"", 0, *k, n) for k, n in counts.items()]
        names = [c.split()[0] for c in _CANDIDATES.split(", ")]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, counts = TaskContext.get().partitionId(), {}, Counter()
        for batch in batches:
            for i, part, mask, key, quality, toxic in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "mask", "key", "quality", "toxic")), strict=True):
                if i is None:  # no id is smaller or larger
                    counts[part, mask, quality, toxic] += 1
                elif lost := place(held, key, (i, mask, quality, toxic, {part: 1})):
                    for p, n in lost[4].items():
                        counts[p, lost[1] | COPY, lost[2], lost[3]] += n
            if len(held) >= REMEMBERED:
                yield flush(held, counts, task)
                held, counts = {}, Counter()
        yield flush(held, counts, task)

    return run


def _updated(_, frames, state):
    """Changes of the counters by new candidates of a group of texts, whose smallest ids are the state."""
    import pandas as pd

    held: dict = pickle.loads(state.get[0]) if state.exists else {}
    counts: Counter = Counter()

    def count(x: tuple, copy: int, sign: int) -> None:
        for part, n in x[4].items():
            counts[part, x[1] | copy, x[2], x[3]] += sign * n

    for frame in frames:
        for key, i, part, mask, quality, toxic, n in zip(*(frame[c].tolist() for c in ("key", "id", "part", "mask", "quality", "toxic", "n")), strict=True):
            if not key:
                counts[part, mask, quality, toxic] += n
                continue
            new = (i, mask, quality, toxic, {part: n})
            lost = place(held, key, new)
            count(new, COPY if lost is new else 0, 1)
            if lost and lost is not new:  # retract what was counted as the first of its text
                count(lost, 0, -1)
                count(lost, COPY, 1)
    state.update((pickle.dumps(held),))
    yield pd.DataFrame([(*k, n) for k, n in counts.items() if n], columns=["part", "mask", "quality", "toxic", "n"])


class FilterAudit:
    """An audit that goes on where it stopped: ``advance`` takes the files that have come since."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", batches: int = BATCHES):
        """``path``: a Parquet table; ``labels``: id, quality, toxic, where any row of an id may set a label; ``folder``: a shared one for state and ledger."""
        ship(spark)
        self.spark, self.path, self.folder, self.batches = spark, path, folder, batches
        self.names = (id_col, text_col, part_col)
        is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
        self.labels = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(is_one("quality"), is_one("toxic"))

    def advance(self) -> None:
        """Processes all new files in micro-batches, each of a part of the files there are."""
        there = self.spark.read.parquet(self.path)
        size = int(str(there._jdf.queryExecution().analyzed().stats().sizeInBytes()))
        files = len(there.inputFiles())
        id_col, text_col, part_col = self.names
        stream = self.spark.readStream.schema(there.schema).option("maxFilesPerTrigger", max(1, -(-files // self.batches))).parquet(self._glob())
        rows = stream.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
        judged = rows.mapInArrow(_judged, "id long, part string, mask int, key binary")
        labelled = judged.join(self.labels, "id", "left").select("id", "part", "mask", "key", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        changes = labelled.mapInArrow(_combined(self._groups(size)), _CANDIDATES).groupBy("bucket").applyInPandasWithState(_updated, _CHANGES, "held binary", "append", "NoTimeout")
        running = changes.writeStream.foreachBatch(self._enter).outputMode("append").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()

    def _groups(self, size: int) -> int:
        """Groups of texts: fixed by the first run, since state stays under its key."""
        folder = f"{self.folder}/groups"
        try:
            return self.spark.read.parquet(folder).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        groups = max(64, size // GROUP_BYTES)
        self.spark.range(groups, groups + 1).write.parquet(folder)
        return groups

    def _enter(self, changes: DataFrame, batch: int) -> None:
        """A batch that is repeated after a failure writes the same entry again."""
        changes.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def counters(self) -> DataFrame:
        """part, mask, quality, toxic, n: documents by the filters they fail."""
        if not self._has_ledger():
            return self.spark.createDataFrame([], _CHANGES)
        entries = self.spark.read.schema(f"{_CHANGES}, batch long").parquet(f"{self.folder}/ledger")
        return entries.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")

    def _file_system(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), held

    def _glob(self) -> str:
        """A stream reads folders; where the table is one file, a pattern that only this file matches."""
        system, held = self._file_system(self.path)
        return self.path if system.getFileStatus(held).isDirectory() else f"{self.path[:-1]}[{self.path[-1]}]"

    def _has_ledger(self) -> bool:
        system, held = self._file_system(f"{self.folder}/ledger")
        return system.exists(held)


def orders(spark: SparkSession) -> DataFrame:
    """All orders of the filters, a row for each step: filter_order, step, filter (its bit) and before (bits of those applied already)."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), step + 1, 1 << f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def interactions(counters: DataFrame) -> DataFrame:
    """For each part, order and step what its filter keeps, removes and repeats, and its sums over all orders. 600 rows a part."""
    places = 1 << len(FILTERS)
    by_mask = counters.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    listed = by_mask.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("of"))  # at most 32 entries
    masks = F.sequence(F.lit(0), F.lit(places - 1))

    def total(what: str, wanted) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(wanted(m), F.coalesce(F.try_element_at("of", m)[what], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))

    bit, before = F.col("filter"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    removed = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    share = F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m), F.coalesce(F.try_element_at("of", m)["n"], F.lit(0).cast("long")) * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    each = listed.select("part", "of", F.explode(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])).alias("filter")).select("*", F.explode(masks).alias("before")).where(before.bitwiseAND(bit) == 0)
    found = each.select(
        "part", "filter", "before",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )
    return found.join(F.broadcast(orders(counters.sparkSession)), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, stage: Stage, batches: int = BATCHES) -> DataFrame:
    """The interactions over a whole table.

    A null text counts as empty, a null part as the empty string. Rows that repeat an id with its text aren't copies of each other. A null id
    is neither smaller nor larger than any, so such a row never fails as a copy and has no labels. Very long texts are judged whole. An empty
    table has no parts and no rows. Columns that aren't named play no part.
    """
    run = FilterAudit(spark, path, labels, f"{stage.path}/audit", batches=batches)
    run.advance()
    return interactions(run.counters())
