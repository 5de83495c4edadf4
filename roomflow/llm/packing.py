"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

Documents are cut into full sequences and one rest piece. The histogram of rest lengths, in classes of a few tokens, is a
cutting-stock problem of bounded size however many documents there are: a linear program over patterns of classes, whose columns a
knapsack dynamic program prices. Rounded patterns make slots for ranks within each class, and a piece's rank finds its slot. Within a
class pieces are ranked by length, so the lengths of all other pieces in a sequence, and with them a piece's offset, follow from the
histogram alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.chunks import encoder, slices
from roomflow.llm.common import Stage

#: Tokens in a length class (rests count as rounded up, which leaves under one class of padding for each piece). The linear
#: program stops when it is proven within ``GAP`` of its optimum, or after so many columns.
UNIT, GAP, MOST_COLUMNS = 8, 2e-3, 4000
#: Offsets of ranks (8 kB for each task that tokenised) are broadcast up to this many tasks, and joined beyond.
BROADCAST_PARTS = 2048


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths that fits (unbounded knapsack); lengths ascend."""
    worth = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        value = worth[c - 1]
        if n:
            options = worth[c - lengths[:n]] + prices[:n]
            k = int(options.argmax())
            if options[k] > value + 1e-12:
                value, took[c] = options[k], k
        worth[c] = value
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
    return float(worth[capacity]), pattern


def patterns_of(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each length 0..capacity-1) and how often each is used; together exactly ``counts`` pieces."""
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    m = len(lengths)
    if m == 0:
        return []
    columns = np.diag(capacity // lengths).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // lengths))
    used = demand / (capacity // lengths)
    for _ in range(MOST_COLUMNS):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, prices, capacity)
        if value <= 1 + GAP:  # Farley: the optimum is at least the current value divided by this
            break
        enter = inverse @ pattern
        ratio = np.where(enter > 1e-9, used / np.where(enter > 1e-9, enter, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * enter, 0)
        used[out] = step
        row = inverse[out] / enter[out]
        inverse -= np.outer(enter, row)
        inverse[out] = row
        columns[out] = pattern
    times = np.floor(used + 1e-7).astype(np.int64)
    left = counts[lengths] - times @ columns
    for k in np.flatnonzero(times):  # rounding errors of the arithmetic must not use a piece twice
        while times[k] and (left < 0)[columns[k] > 0].any():
            times[k] -= 1
            left += columns[k]
    out_patterns: list[tuple[np.ndarray, int]] = []

    def add(column: np.ndarray, n: int) -> None:
        full = np.zeros(capacity, np.int64)
        full[lengths] = column
        out_patterns.append((full, n))

    for k in np.flatnonzero(times):
        add(columns[k], int(times[k]))
    while left.any():  # what rounding left over: at most a pattern's worth for each length
        column, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            if left[k] and lengths[k] <= room:
                n = min(int(left[k]), room // int(lengths[k]))
                column[k], room = n, room - n * int(lengths[k])
        n = int((left[column > 0] // column[column > 0]).min())
        left -= n * column
        add(column, n)
    return out_patterns


class Slots:
    """Where the pieces of each class go, by rank: intervals of ranks, one for each class in each pattern.

    counts: pieces of each exact length 0..capacity. Pieces of the largest class have a sequence of their own.
    """

    def __init__(self, counts: np.ndarray, capacity: int, unit: int = UNIT):
        if capacity % unit:
            unit = 1
        self.unit, self.classes = unit, capacity // unit
        held = np.zeros((self.classes + 1) * unit, np.int64)
        held[unit - 1 : unit - 1 + capacity + 1] = counts
        self.held = held.reshape(-1, unit)
        self.lengths = (np.arange(held.size) - unit + 1).reshape(-1, unit)
        self.shorter = np.cumsum(self.held, axis=1) - self.held
        whole = self.held.sum(axis=1)
        rows, sequence, taken = [], int(whole[-1]), np.zeros(self.classes, np.int64)
        for pattern, times in patterns_of(whole[:-1], self.classes):
            begin = len(rows)
            for place, k in enumerate(np.flatnonzero(pattern)):
                rows.append((k, taken[k], sequence, int(pattern[k]), begin, place))
                taken[k] += times * int(pattern[k])
            sequence += times
        self.sequences = sequence
        self.table = np.array(rows, np.int64).reshape(-1, 6)
        self.order = np.lexsort((self.table[:, 1], self.table[:, 0]))
        self.key = (self.table[self.order, 0] << 48) + self.table[self.order, 1]

    def _tokens(self, k: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Tokens in the first ``rank`` pieces of classes k."""
        return (np.clip(rank[:, None] - self.shorter[k], 0, self.held[k]) * self.lengths[k]).sum(axis=1)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank within the length."""
        k = -(-length // self.unit)
        rank = rank + self.shorter[k, length - self.lengths[k, 0]]
        sequence, offset = rank.copy(), np.zeros_like(rank)
        packed = np.flatnonzero(k < self.classes)
        if len(packed):
            k, rank = k[packed], rank[packed]
            at = self.order[np.searchsorted(self.key, (k << 48) + rank, side="right") - 1]
            _, first, base, each, begin, place = self.table[at].T
            turn = (rank - first) // each
            before = self._tokens(k, rank) - self._tokens(k, first + turn * each)
            for step in range(int(place.max(initial=0))):
                some = np.flatnonzero(place > step)
                k2, first2, _, each2, _, _ = self.table[begin[some] + step].T
                from_rank = first2 + turn[some] * each2
                before[some] += self._tokens(k2, from_rank + each2) - self._tokens(k2, from_rank)
            sequence[packed], offset[packed] = base + turn, before
        return sequence, offset


PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tokens = encoder(path, leading=True)
        for batch in batches:
            for rows in slices(batch):
                ids, counts = tokens.encode(rows.column("text").to_pylist())
                totals = counts + 1
                ends = np.cumsum(totals)
                full = np.full(int(ends[-1]), end_id, "<u4")
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                pieces = -(-totals // capacity)
                doc = np.repeat(np.arange(len(totals)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, totals[doc] - start)
                order = np.argsort(length, kind="stable")
                runs = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(runs, runs) + seen[runs]
                seen += np.bincount(length, minlength=capacity + 1)
                begin = (ends - totals)[doc] + start
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(4 * begin, 4 * len(full)).astype("<i4")), pa.py_buffer(full)])
                columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(totals[doc]), raw, pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, stage: Stage, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids and one ``end_id`` lie in exactly one piece each. Null text counts as empty: the end id alone. Repeated
    rows are packed each. A null id is kept. Very long texts become many full pieces. An empty table gives no rows. Other
    columns are ignored. Pieces are ranked within their length in the order of the tokenising tasks; only the histogram of lengths
    (``capacity`` numbers) comes to the driver.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = stage.write(slim.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    held = stage.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "held")
    counts = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots = Slots(counts, capacity)

    def before(parts):
        """For each length the counts of earlier tasks; one key is one length, with one row for each task."""
        parts = parts.sort_values("part")
        return parts.assign(before=parts["n"].cumsum() - parts["n"])[["part", "length", "before"]]

    earlier = held.groupBy("length").applyInPandas(before, "part int, length int, before long")
    if held.agg(F.max("part")).first()[0] is not None and held.select("part").distinct().count() <= BROADCAST_PARTS:
        earlier = F.broadcast(earlier)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = slots.place(length.to_numpy(np.int64), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(earlier, ["part", "length"]).withColumn("at", place("length", F.col("nth") + F.col("before")))
    return ranked.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", "at.sequence_id", "at.offset")
