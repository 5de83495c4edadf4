"""Sharding by a keyed Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import Stage, numbered

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift steps), so that every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A bijection of 0..n-1 that is computed for any single number, forwards and backwards.

    A balanced Feistel network permutes the smallest even power of two that holds n; a number that leaves
    0..n-1 walks along its cycle until it is back inside, which keeps the map a bijection.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))

    def _pass(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            if back:
                left, right = right ^ (_mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ key) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        with np.errstate(over="ignore"):
            out = self._pass(np.asarray(x, dtype=np.uint64), keys, back)
            while (outside := out >= np.uint64(self.n)).any():
                out[outside] = self._pass(out[outside], keys, back)
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)

    def place(self, rows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        p = self.forward(rows)
        return p % shards, p // shards

    def row(self, shard: int, slot: int, shards: int) -> int:
        """The row number at a shard's slot."""
        return int(self.backward(np.array([slot * shards + shard]))[0])


def shard_rows(docs: DataFrame, stage: Stage, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard and a slot; the law is ``rows``: shard counts differ by one at most.

    Row numbers follow (id, text checksum, size), so a rerun gives the same places. The place of row r is p = permutation(r):
    shard p mod ``shards``, slot p div ``shards``; so slots are gapless from 0 in each shard. Rows with equal
    texts are independent rows and need not share a shard (that would break the law for a large group).
    Null text: no bytes, checksum 0. A null id sorts first. Repeated rows each get a place of their own. An empty
    table gives an empty result. Other columns are ignored, so names in them can't clash. Only id, size and
    checksum are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(slim, [F.col(id_col), F.col("text_crc32"), F.col("size")], stage, "sharding")
    permutation = Permutation(max(1, stage.read("sharding").count()), seed)

    @F.pandas_udf("shard int, slot long")
    def place(n: pd.Series) -> pd.DataFrame:
        shard, slot = permutation.place(n.to_numpy(), shards)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    placed = rows.withColumn("at", place("row_number"))
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "at.shard", "at.slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
