"""Token ids in word-aligned Simple-8b blocks, written as a table of segments and read back.

Format. A segment holds whole documents in order. Its ids are cut into blocks of ``BLOCK`` ids; every block is a
run of 64-bit words, so each block can be decoded alone from its word offset. The top four bits of a word select
how many ids of which width fill the other 60 bits, the first id lowest. Selector 0 is the escape: the low bits
are an index into the segment's list of values that need more than 60 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.chunks import encoder, slices
from roomflow.llm.common import Stage, part_offsets

BLOCK, SEGMENT = 1024, 65_536
#: Fixed values of the format: bits of an id and ids in a word for selectors 1 to 14.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_WIDTH, _COUNT = np.array((60, *WIDTHS)), np.array((1, *COUNTS))


#: The narrowest width, as a selector, of every value below 2 ** 16.
_NARROWEST = np.searchsorted(1 << np.array(WIDTHS, np.int64), np.arange(1 << 16), side="right").astype(np.uint8) + np.uint8(1)


def _narrowest(ids: np.ndarray) -> np.ndarray:
    """For each id the selector of the narrowest width that holds it; 15 where none does."""
    out = _NARROWEST[np.minimum(ids, np.uint64((1 << 16) - 1)).astype(np.int32)]
    wide = np.flatnonzero(ids >= np.uint64(1 << 16))
    out[wide] = np.searchsorted(np.array([1 << w for w in WIDTHS], np.uint64), ids[wide], side="right") + 1
    return out


def pack_segments(ids: np.ndarray, cuts: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of ids between two cuts: its words, the word offset of each block, and the escaped values.

    The blocks of all segments step from word to word side by side.
    """
    ids = np.asarray(ids, dtype=np.uint64)
    lengths = np.diff(cuts)
    per = -(-lengths // BLOCK)
    first, blocks, width = np.cumsum(per) - per, int(per.sum()), BLOCK + COUNTS[0]
    used = np.full(blocks, BLOCK)
    need, values = np.full((blocks, width), 1, np.uint8), np.zeros((blocks, width), np.uint64)  # past its end a block holds zeroes, which fit every width
    selectors, large = _narrowest(ids), ids >= np.uint64(1 << 60)
    for begin, n, block, some in zip(cuts, lengths.tolist(), first.tolist(), per.tolist(), strict=False):
        for table, source in ((need, selectors), (values, np.where(large, 0, ids) if large.any() else ids)):
            whole = n // BLOCK
            table[block : block + whole, :BLOCK] = source[begin : begin + whole * BLOCK].reshape(whole, BLOCK)
            if some > whole:
                table[block + whole, : n % BLOCK] = source[begin + whole * BLOCK : begin + n]
                used[block + whole] = n % BLOCK
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(len(WIDTHS), 0, -1):  # the last that fits has the most ids; where one doesn't fit, no later one does
        fits, length, count = need <= selector, 1, COUNTS[selector - 1]
        while length < count:
            step = min(length, count - length)
            fits, length = fits[:, :-step] & fits[:, step:], length + step
        fits = fits[:, :BLOCK]
        if not fits.any():
            break
        choice[fits] = selector
    steps, starts = _COUNT.astype(np.uint8)[choice], np.zeros((blocks, BLOCK), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        starts[row, at] = True
        at = at + steps[row, at]
        more = at < used[row]
        if not more.all():
            row, at = row[more], at[more]
    block, column = np.nonzero(starts)
    chosen, begin, flat = choice[block, column], block * width + column, values.ravel()
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == 0:
            segment = np.searchsorted(first + per, block[rows], side="right")
            words[rows] |= (np.arange(len(rows)) - np.searchsorted(segment, segment)).astype(np.uint64)
            continue
        from_, held = begin[rows], words[rows]
        for k in range(_COUNT[selector]):
            held |= flat[from_ + k] << np.uint64(_WIDTH[selector] * k)
        words[rows] = held
    offsets = np.append(0, np.cumsum(starts.sum(axis=1)))
    out = []
    for begin, end, block, some in zip(cuts, cuts[1:], first.tolist(), per.tolist(), strict=False):
        a, b = offsets[block], offsets[block + some]
        part = ids[begin:end]
        out.append((words[a:b], offsets[block : block + some] - a, part[large[begin:end]]))
    return out


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 ids as words; also the word offset of each block, and the escaped values."""
    return pack_segments(ids, [0, len(ids)])[0]


def unpack_words(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ids of a segment of n, all words at once."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    block_ends = np.append(offsets[1:], len(words)) - 1
    block_sizes = np.minimum(BLOCK, n - np.arange(len(offsets)) * BLOCK)
    counts[block_ends] -= np.add.reduceat(counts, offsets) - block_sizes  # a block's last word may be padded
    begin = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[begin[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        width, mask = np.uint64(_WIDTH[selector]), np.uint64((1 << int(_WIDTH[selector])) - 1)
        for k in range(_COUNT[selector]):
            held = rows[counts[rows] > k]
            out[begin[held] + k] = (words[held] >> (width * np.uint64(k))) & mask
    return out


SEGMENTS = "__part int, segment long, ids_before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, words binary, block_offsets array<long>, escaped array<long>"


def _segments(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, segment, before = TaskContext.get().partitionId(), 0, 0
        tokens = encoder(path, leading=False)
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in SEGMENTS.split(", ")}
            for piece in slices(batch):
                ids, counts = tokens.encode(piece.column("text").to_pylist())
                counts = counts + 1
                ends = np.cumsum(counts)
                full = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint64)
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                doc_ids = piece.column("doc_id").to_pylist()
                group = (ends - counts) // SEGMENT
                runs = np.split(np.arange(len(counts)), np.flatnonzero(np.diff(group)) + 1)
                cuts = [0, *(int(ends[rows[-1]]) for rows in runs)]
                for rows, first, last, (words, offsets, escaped) in zip(runs, cuts, cuts[1:], pack_segments(full, cuts), strict=False):
                    for name, value in zip(out, (part, segment, before, last - first, [doc_ids[i] for i in rows], counts[rows], words.astype("<u8").tobytes(), offsets, escaped.astype(np.int64)), strict=True):
                        out[name].append(value)
                    segment, before = segment + 1, before + last - first
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), _TYPES, strict=True)], names=list(out))

    return run


_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def write_tokens(docs: DataFrame, stage: Stage, name: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, ends each document with ``end_id`` and writes the segments in ascending id order.

    Null text counts as empty, so the document is its end id alone. Repeated ids keep one entry for each row, ordered by a
    hash of the text; a null id sorts first. Very long texts stay whole: a segment holds at least one
    document. An empty table writes no segment. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage.write(ranged.mapInArrow(_segments(tokenizer_path, end_id), SEGMENTS), name)


def read_tokens(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decodes segments into one row per document: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids themselves.

    Each written row has one of its own, repeated and null ids too; an empty text has its end id alone; a table without segments gives no
    row. A segment is decoded at once, and so is a very long document, which lies in one.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    placed = segments.join(F.broadcast(part_offsets(segments, F.col("n_ids"))), "__part")  # one row per file

    def run(batches):
        for batch in batches:
            got: list[list] = [[] for _ in range(4 + with_ids)]
            for row in range(batch.num_rows):
                cell = lambda c: batch.column(c)[row]  # noqa: B023, E731
                array = lambda c: cell(c).values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                words = np.frombuffer(cell("words").as_buffer(), "<u8")
                ids = unpack_words(words, array("block_offsets"), array("escaped").astype(np.uint64), cell("n_ids").as_py())
                counts = array("doc_tokens")
                ends = np.cumsum(counts)
                raw, small = memoryview(ids.astype("<u4").tobytes()), ids
                got[0] += cell("doc_ids").as_py()
                got[1] += (ends - counts + (cell("ids_before").as_py() + cell("__before").as_py())).tolist()
                got[2] += counts.tolist()
                got[3] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                if with_ids:
                    got[4] += [small[e - n : e].astype(np.int64) for e, n in zip(ends, counts, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, kinds, strict=True)], names=names)

    return placed.mapInArrow(run, schema)
