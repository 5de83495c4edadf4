"""Encoding and decoding with a merge-type SentencePiece vocabulary.

An agenda holds the adjacent symbol pairs that make a known piece, best score first and leftmost among equals;
the best pair merges, and its neighbours' pairs enter anew, until none is left. No piece of such a vocabulary has
a word boundary mark after another character, so merges never cross the start of a word, and each word has an
agenda of its own. Words of like length run through their agendas side by side in arrays; a very long one takes a heap.
Every word that is met for the first time in a worker is checked against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.chunks import ChunkMemo, slices
from roomflow.llm.common import ship

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
NONE = np.iinfo(np.int32).max
SIDE_BY_SIDE, WIDEST = 8192, 64


class Merges:
    """Pairs of symbols that make a piece, with the rank of its score and its id; taken from a vocabulary once per worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        ids = {self.library.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a word boundary inside; merges could cross words")
        ranks = {s: k for k, s in enumerate(sorted({self.library.get_score(i) for i in plain}, reverse=True))}
        rows = [(ids[p[:k]] << 20 | ids[p[k:]], ranks[self.library.get_score(i)], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair makes; the rank is NONE where it makes nothing."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def fallback(self, symbols: list[int], chars: list[int]) -> list[int]:
        """Characters without a piece become their UTF-8 bytes."""
        out: list[int] = []
        for s, c in zip(symbols, chars, strict=True):
            out += [s] if s >= 0 else [self.of_byte[b] for b in chr(c).encode()]
        return out

    def side_by_side(self, words: list[str]) -> list[list[int]]:
        """Agendas of words of like length; each step merges the best pair of every word that has one."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        width = int(counts.max())
        chars = np.zeros((len(words), width), np.int64)
        chars[np.arange(width) < counts[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = np.where(np.arange(width) < counts[:, None], self.of_char[chars], -2)
        out: list[list[int]] = [[] for _ in words]
        rows = np.arange(len(words))
        rank, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            going = rank[each, best] < NONE if rank.shape[1] else np.zeros(len(rows), bool)
            for k in np.flatnonzero(~going):
                held = symbols[k][symbols[k] != -2]
                out[rows[k]] = held.tolist() if (held >= 0).all() else self.fallback(held.tolist(), chars[k, : len(held)].tolist())
            if not going.any():
                break
            rows, symbols, chars, rank, made, best = rows[going], symbols[going], chars[going], rank[going], made[going], best[going]
            each = np.arange(len(rows))
            symbols[each, best] = made[each, best]
            place = np.arange(symbols.shape[1] - 1)
            after = place + (place > best[:, None])
            symbols, chars = np.take_along_axis(symbols, after, 1), np.take_along_axis(chars, after, 1)
            pair = np.arange(rank.shape[1] - 1)
            after = pair + (pair >= best[:, None])
            rank, made = np.take_along_axis(rank, after, 1), np.take_along_axis(made, after, 1)
            for side in (best - 1, best):
                some = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[some, side[some]], made[some, side[some]] = self.look_up(symbols[some, side[some]], symbols[some, side[some] + 1])
        return out

    def alone(self, word: str) -> list[int]:
        """The agenda of one long word, as a heap of (rank, left place, size); entries of symbols that changed are stale."""
        chars = [ord(c) for c in word]
        symbols = self.of_char[np.array(chars)].tolist()
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        arrays = self.look_up(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        agenda = [(r, k, symbols[k], symbols[k + 1], m) for k, (r, m) in enumerate(zip(arrays[0].tolist(), arrays[1].tolist(), strict=True)) if r < NONE]
        heapq.heapify(agenda)
        while agenda:
            _, k, left, right, made = heapq.heappop(agenda)
            other = after[k] if alive[k] else -1
            if other < 0 or symbols[k] != left or symbols[other] != right:
                continue
            symbols[k], alive[other], after[k] = made, 0, after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0:
                    r, m = self.look_up(np.array([symbols[a]]), np.array([symbols[b]]))
                    if r[0] < NONE:
                        heapq.heappush(agenda, (int(r[0]), a, symbols[a], symbols[b], int(m[0])))
        kept = [k for k in range(n) if alive[k]]
        return self.fallback([symbols[k] for k in kept], [chars[k] for k in kept])


class PieceMemo(ChunkMemo):
    """Ids of words; a word stands for itself with one boundary mark before it, a key that starts with a mark for itself."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.lead = len(self.merges.library.encode("x"))
        super().__init__()

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 not in marked and marked[-1] != MARK:
            return marked.split(MARK)[1:]
        return [c[1:] if len(c) > 1 and c[1] != MARK else c for c in _RUNS.findall(marked)]

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """chunks come shortest first."""
        full = [c if c[0] == MARK else MARK + c for c in chunks]
        short = next((i for i, c in enumerate(full) if len(c) > WIDEST), len(full))
        out = [ids for i in range(0, short, SIDE_BY_SIDE) for ids in self.merges.side_by_side(full[i : min(i + SIDE_BY_SIDE, short)])]
        out += [self.merges.alone(c) for c in full[short:]]
        library = self.merges.library
        told = [i[self.lead :] if c[0] == MARK else i for c, i in zip(chunks, library.encode([f"x{c}" if c[0] == MARK else c for c in chunks], num_threads=1), strict=True)]
        if told != out:
            bad = next(c for c, a, b in zip(chunks, told, out, strict=True) if a != b)
            raise ValueError(f"the agenda and the library differ on {bad[:80]!r}")
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(lengths.sum())), lengths


_MEMO: dict[str, PieceMemo] = {}


def memo(path: str) -> PieceMemo:
    if path not in _MEMO:
        _MEMO[path] = PieceMemo(path)
    return _MEMO[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, and the text that the library's decode makes of them: doc_id, ids array<int>, decoded string.

    No begin or end ids. Null and empty texts give no ids and an empty text. Repeated rows stay repeated. Very
    long texts and very long words are encoded whole. An empty table gives an empty result. Other columns are ignored.
    The ids are as the library's for the whole text; a difference on any word raises ValueError.
    """
    ship(docs.sparkSession)

    def run(batches):
        words = memo(model_path)
        for batch in batches:
            for piece in slices(batch):
                ids, counts = words.encode(piece.column("text").to_pylist())
                ends = np.cumsum(counts)
                flat = ids.tolist()
                decoded = words.merges.library.decode([flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], num_threads=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
