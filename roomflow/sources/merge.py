"""A table that batches are merged into or appended to, and that readers always see whole.

Rows lie in buckets by a hash of their key. A merge writes only the buckets that its keys fall in, to a folder of its own, and then one small
file that names, for each bucket, the folders of the new version. That file is created once or not at all, which is the moment when all of a
batch becomes visible. It also holds the batch's id: a batch that is repeated finds its id and does nothing, and what an interrupted one has
written is in no version. Old versions can be read until ``vacuum`` drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionTaken(RuntimeError):
    """Another writer has made the next version meanwhile; the batch can be tried again."""


class MergeTable:
    """``path`` is in a store that the driver and all executors share; ``key`` identifies a row, and ``buckets`` must stay as they were."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # Versions

    def versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit()) if self._files.exists(folder) else []

    def _manifest(self, version: int | None) -> dict:
        """batch, and the folders of each bucket. The number of buckets bounds it, and appends until the next merge of a bucket."""
        if version is None:
            return {"batches": [], "buckets": {}}
        stream = self._files.open(self._jvm_path(f"{self.path}/versions/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> tuple[int | None, dict]:
        version = max(self.versions(), default=None)
        return version, self._manifest(version)

    def _commit(self, base: int | None, manifest: dict) -> int:
        """Makes the next version: written aside, then renamed to its name, which fails where that is taken."""
        version = 0 if base is None else base + 1
        aside, there = self._jvm_path(f"{self.path}/aside/{uuid.uuid4().hex}"), self._jvm_path(f"{self.path}/versions/{version}")
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            stream.close()
        self._files.mkdirs(there.getParent())
        if self._files.exists(there) or not self._files.rename(aside, there):
            self._files.delete(aside, False)
            raise VersionTaken(f"version {version} is there already")
        return version

    # Batches

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket to a new folder; the buckets that have rows and their folders."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        there = self._jvm_path(folder)
        names = [s.getPath().getName() for s in self._files.listStatus(there)]
        return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was in a version."""
        manifest = self._latest()[1] if version is None else self._manifest(version)
        return self._read([f for folders in manifest["buckets"].values() for f in folders])

    def merge(self, new: DataFrame, batch: str, columns: Sequence[str] | None = None, order: str | None = None) -> bool:
        """Updates ``columns`` (all but the key, if not named) of rows whose key exists and inserts the others; False for a known batch.

        Of rows of the batch with one key the last by ``order`` wins, nulls first; without an order they must be one. Rows whose key holds a
        null match nothing and are passed over. Columns that the batch lacks stay as they are, or null in new rows.
        """
        base, manifest = self._latest()
        if batch in manifest["batches"]:
            return False
        rest = [c for c in self.schema.names if c not in self.key]
        set_ = [c for c in (columns or rest) if c in new.columns]
        given = [c for c in rest if c in new.columns]
        fresh = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key))
        if order:  # an aggregation, so a key that repeats very often is no hot spot
            fresh = fresh.groupBy(*self.key).agg(F.max_by(F.struct(*given), F.struct(F.col(order).isNotNull(), order)).alias("__row"))
            fresh = fresh.select(*self.key, *[F.col(f"__row.{c}").alias(f"__{c}") for c in given])
        else:
            fresh = fresh.select(*self.key, *[F.col(c).alias(f"__{c}") for c in given])
        fresh = fresh.withColumn("__new", F.lit(True))
        touched = [str(r[0]) for r in fresh.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets
        held = self._read([f for b in touched for f in manifest["buckets"].get(b, [])]).withColumn("__old", F.lit(True))
        both = held.join(fresh, self.key, "full")
        known = F.col("__old").isNotNull()
        value = lambda c: F.when(F.col("__new") & (~known | F.lit(c in set_)), F.col(f"__{c}")).otherwise(F.col(c)) if c in given else F.col(c)
        rows = both.select(*[F.col(c) if c in self.key else value(c).alias(c) for c in self.schema.names]).withColumn("__bucket", self._bucket())
        written = self._write(rows)
        buckets = manifest["buckets"] | {b: [f] for b, f in written.items()}
        self._commit(base, {"batches": [*manifest["batches"], batch], "buckets": buckets})
        return True

    def append(self, new: DataFrame, batch: str) -> bool:
        """Adds all rows, whatever is there; False for a known batch."""
        base, manifest = self._latest()
        if batch in manifest["batches"]:
            return False
        written = self._write(new.select(*self.schema.names).withColumn("__bucket", self._bucket()))
        buckets = {b: list(f) for b, f in manifest["buckets"].items()}
        for b, folder in written.items():
            buckets.setdefault(b, []).append(folder)
        self._commit(base, {"batches": [*manifest["batches"], batch], "buckets": buckets})
        return True

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops all versions but the last ``keep``, and the folders that none of these names, those of interrupted batches among them."""
        held = self.versions()
        kept = held[-keep:] if held else []
        used = {f for v in kept for folders in self._manifest(v)["buckets"].values() for f in folders}
        for v in held[: len(held) - len(kept)]:
            self._files.delete(self._jvm_path(f"{self.path}/versions/{v}"), False)
        data, gone = self._jvm_path(f"{self.path}/data"), []
        for top in self._files.listStatus(data) if self._files.exists(data) else []:
            for s in self._files.listStatus(top.getPath()):
                name = f"{self.path}/data/{top.getPath().getName()}/{s.getPath().getName()}"
                if s.isDirectory() and name not in used:
                    self._files.delete(s.getPath(), True)
                    gone.append(name)
        return gone
