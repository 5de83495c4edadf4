"""Whole texts to token ids with the tokenizers library, remembering the ids of frequent chunks.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so that the ids of the chunks, joined, are
the ids of the text. Chunks come back again and again in a corpus; their ids are kept in arrays and gathered.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

LONGEST, MOST, MOST_IDS, JOINED = 40, 650_000, 8_000_000, 200
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"^\s|\s\Z| \s|[^\S ] ")
_CLOSING = ".,!?;:%$#&*|"
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"


def _simple(text: str) -> bool:
    """Whether all characters are of Latin-1, for which lower-casing and normal forms are the same in every Unicode version."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _odd(text: str) -> bool:
    """Whether a text has white space at its ends or beside a space."""
    if not _simple(text):
        return bool(_ODD.search(text))
    found = [c for c in _SPACES if c in text]
    return "  " in text or text[0].isspace() or text[-1].isspace() or any(f" {c}" in text or f"{c} " in text for c in found)


class _Index(dict):
    """Chunk to number; a chunk that is asked for the first time gets the next number and is listed in ``new``."""

    count, new = 0, ()

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = self.count
        self.count = n + 1
        self.new.append(chunk)
        return n


class ChunkMemo:
    """Remembers the ids of chunks. Subclasses cut texts into chunks and give the ids of new ones.

    Memory is bounded: chunks of more than ``LONGEST`` characters are forgotten after a call, and with ``MOST`` chunks or
    ``MOST_IDS`` ids only those that came often stay.
    """

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.at = _Index()
        self.at.new = []
        self.starts, self.lengths, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.hits = np.zeros(1024, np.int64)
        self.used = 0

    def _shrink(self) -> None:
        """Starts anew with the chunks that came often."""
        kept = [(c, i) for c, i in self.at.items() if self.hits[i] > 2]
        if len(kept) > MOST // 2:
            kept = []
        index = np.fromiter((i for _, i in kept), np.int64, len(kept))
        ids, ends = self._gather(index)
        self._clear()
        for chunk, _ in kept:
            self.at[chunk]
        self.at.new = []
        self._store(np.arange(len(kept)), ids, np.diff(ends, prepend=0))

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def parts(self, chunk: str) -> list[str]:
        """Finer chunks whose ids, joined, are the chunk's."""
        return [chunk]

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one chunk after another, and how many each has."""
        raise NotImplementedError

    def _store(self, index: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.at.count > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            self.hits = np.append(self.hits, np.zeros(len(self.hits), np.int64))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.lengths[index] = lengths
        self.starts[index] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and where each chunk ends."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(total)], ends

    def _learn(self) -> list[str]:
        """Finds the ids of all new chunks; returns them."""
        plain, whole, counts, pieces, learned = [], [], [], [], []
        while self.at.new:
            fresh, self.at.new = self.at.new, []
            learned += fresh
            for chunk in fresh:
                parts = self.parts(chunk)
                if len(parts) == 1:
                    plain.append(chunk)
                else:
                    whole.append(self.at[chunk])
                    counts.append(len(parts))
                    pieces += map(self.at.__getitem__, parts)
        plain.sort(key=len)
        if plain:
            self._store(np.fromiter(map(self.at.__getitem__, plain), np.int64, len(plain)), *self.ids(plain))
        if whole:
            ids, ends = self._gather(np.array(pieces, np.int64))
            self._store(np.array(whole, np.int64), ids, np.diff(ends[np.cumsum(counts) - 1], prepend=0))
        return learned

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many belong to each text."""
        if len(self.at) > MOST or self.used > MOST_IDS:
            self._shrink()
        cut = [self.cut(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        index = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        learned = self._learn()
        ids, ends = self._gather(index)
        self.hits += np.bincount(index, minlength=len(self.hits))
        for chunk in learned:
            if len(chunk) > LONGEST:
                del self.at[chunk]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


class ChunkEncoder(ChunkMemo):
    """leading: the tokenizer joins one space to the word after it (byte-level), else it drops white space."""

    def __init__(self, path: str, leading: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.leading = Tokenizer.from_file(path), leading
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between, self.between_id = next(iter(special.items()), (None, None))
        super().__init__()

    def cut(self, text: str) -> list[str]:
        """Chunks of a text; for ``leading``, a chunk stands for itself with a space before it, or if it has a space in front, without."""
        if not self.leading:
            if _simple(text) and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return text.lower().split()
            return [c for c in text.split(" ") if c]
        if not text:
            return []
        if not _odd(text):
            first, *rest = text.split(" ")
            return [f" {first}", *rest]
        return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else f" {c}" for c in _CUT.split(text)]

    def parts(self, chunk: str) -> list[str]:
        """Cuts at single line breaks (``leading`` only), and between a letter and the closing signs at the end."""
        if chunk[-1] not in _CLOSING and not (self.leading and "\n" in chunk):
            return [chunk]
        lines, out = [chunk], []
        if self.leading and "\n" in chunk:
            lines = chunk.split("\n")
            if any(not x or x[-1].isspace() or (i and x[0].isspace()) for i, x in enumerate(lines)) or lines[0][:2].isspace():
                return [chunk]
        for i, line in enumerate(lines):
            if i:
                out.append(" \n")
            word = line.rstrip(_CLOSING)
            first = f" {line}" if i and self.leading else line
            if word and word != line and word[-1].lower()[-1].isalpha():
                tail = line[len(word) :]
                out += [first[: len(first) - len(tail)], f" {tail}" if self.leading else tail]
            else:
                out.append(first)
        return out

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks go to the tokenizer many at a time, with a special token between them."""
        plain = [c[1:] if c[0] == " " else f" {c}" for c in chunks] if self.leading else chunks
        joined = [i for i, c in enumerate(plain) if self.between and "<" not in c]
        known = set(joined)
        order = joined + [i for i in range(len(plain)) if i not in known]
        texts = [self.between.join(plain[i] for i in joined[k : k + JOINED]) for k in range(0, len(joined), JOINED)] + [plain[i] for i in order[len(joined) :]]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        runs = -(-len(joined) // JOINED)
        flat = np.fromiter(chain.from_iterable(chain.from_iterable((ids, (self.between_id,)) for ids in encoded[:runs])), np.int32)
        ends = np.flatnonzero(flat == self.between_id)
        lengths = np.diff(ends, prepend=-1) - 1
        rest = encoded[runs:]
        flat = np.concatenate([flat[flat != self.between_id], np.fromiter(chain.from_iterable(rest), np.int32)])
        lengths = np.concatenate([lengths, np.fromiter(map(len, rest), np.int64, len(rest))])
        if len(lengths) != len(chunks):
            raise ValueError("a chunk holds the separating token")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts, wanted = (np.cumsum(lengths) - lengths)[back], lengths[back]
        ends = np.cumsum(wanted)
        return flat[np.repeat(starts - (ends - wanted), wanted) + np.arange(len(flat))], wanted


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, leading: bool) -> ChunkEncoder:
    """One encoder per Python worker."""
    if (path, leading) not in _ENCODERS:
        _ENCODERS[path, leading] = ChunkEncoder(path, leading)
    return _ENCODERS[path, leading]


def slices(batch, column: str = "text", most: int = 4_000_000):
    """Cuts an Arrow batch into runs of rows with about ``most`` characters, so that work on them stays small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
