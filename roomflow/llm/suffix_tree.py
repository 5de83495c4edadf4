"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a run of up to ``DEPTH`` words before a token (a begin mark stands before the first). A context becomes a state if
its training occurrences are told better by its own counts than by its suffix's distribution: the divergence test sums, over all of them,
the log ratio of the two chances, leaving the occurrence itself out of the counts. States are smoothed towards their suffix's distribution
with the weight (of a few) that this sum likes best, the root by add-one. A token is scored by the longest suffix of its context that is a
state, where a state's suffixes are states too.

Documents are cut into chunks of bounded size, which keep their tokens as local numbers in compressed arrays. Chunks ask for what they need
to know of the whole corpus in rounds: the distinct keys of a chunk (64-bit hashes) go to buckets by value with the chunk's own counts, a
bucket adds up what all chunks sent, and each chunk gets its sums back. Keys of one chunk are distinct, so a word or context that is
everywhere is one entry of each chunk, and buckets are even. Nothing of the corpus is held in one place.
"""

from __future__ import annotations

import gc
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import Stage, groups, ship

#: Longest context in words; training occurrences that a context needs to be tested; gain in nats that makes it a state.
DEPTH, MIN_CONTEXT, GAIN = 2, 64, 5.0
#: Smoothing weights to choose from, times the occurrences of the context.
WEIGHTS = (1 / 16, 1 / 4, 1.0, 4.0)
#: Tokens of a chunk (a longer document is one chunk), bytes of text that are split at once, keys of a bucket on average.
CHUNK_TOKENS, SPLIT_BYTES, BUCKET_KEYS = 500_000, 1 << 20, 1 << 19
#: Chunks of one task, which travel as one Arrow batch.
TASK_CHUNKS = 2
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Kinds of questions are kept apart by the high bits of the bucket.
_COUNTS, _GAINS, _KIND = 0, 1, 40


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays with their bytes dealt into planes and compressed."""
    import zstandard

    def planes(a: np.ndarray) -> bytes:
        return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if a.size else b""

    squeeze = zstandard.ZstdCompressor(level=1)
    return pickle.dumps({k: (a.dtype.str, a.shape, squeeze.compress(planes(a))) for k, a in arrays.items()})


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    def whole(kind: str, shape: tuple, blob: bytes) -> np.ndarray:
        wide = np.dtype(kind).itemsize
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(np.prod(shape)) * wide)), np.uint8)
        return np.ascontiguousarray(flat.reshape(wide, -1).T).view(kind).reshape(shape) if flat.size else np.zeros(shape, kind)

    return {k: whole(*x) for k, x in pickle.loads(data).items()}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context * np.uint64(0xD6E8FEB86659FD93) + word)


#: A number for each place in a word (later ones go round, times an odd number) and byte.
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, (64, 256), dtype=np.uint64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts without empty ones: sums of a number for each place and byte, spread."""
    if not len(words):
        return np.zeros(0, np.uint64)
    plain = words.cast(pa.binary())
    ends = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    data = np.frombuffer(plain.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    return _mix(np.add.reduceat(_TABLE[place & 63, data] * (2 * (place >> 6) + 1).astype(np.uint64), starts) + np.diff(ends).astype(np.uint64))


class Chunk:
    """Tokens of some documents, and what their chunk has learned about the corpus so far.

    ids, known (id not null), train: by document; lens: tokens of each, the end counted; words: by token, 0 for the end, else the place in
    ``hashes``; counts: by word; n1, n2 ...: by token, training count of the gram of its context of that length and itself (0: not asked
    for); s1, s2 ...: by token, 0 or the number of the smoothing weight of its context, if that is a state.
    """

    def __init__(self, arrays: dict[str, np.ndarray], model: dict):
        self.a, self.model = arrays, model
        lens = arrays["lens"]
        self.n = int(lens.sum())
        self.first = np.zeros(self.n, bool)
        self.first[np.cumsum(lens) - lens] = True
        self.train = np.repeat(arrays["train"], lens)

    def _back(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before, ``start`` at the first of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def _contexts(self, depth: int) -> np.ndarray:
        """Hash of the ``depth`` words before each token; further back than the begin mark there is nothing, see ``frequent``."""
        word = self._back(self.a["hashes"][self.a["words"]], BEGIN)
        key = _mix(word)
        for _ in range(1, depth):
            word = self._back(word, BEGIN)
            key = _join(key, word)
        return key

    def frequent(self, depth: int) -> np.ndarray:
        """Training occurrences of the ``depth`` words before each token, 0 where they are under the least number."""
        if depth == 1:
            counts = self.a["counts"][self.a["words"]]
            seen = self._back(counts, self.a["counts"][0])  # as many begin marks as ends
        else:
            seen = self._back(self.a[f"n{depth - 1}"].astype(np.int64), 0)
        return np.where(seen >= self.model["least"], seen, 0)

    def grams(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose context is frequent, and the hash of context and token."""
        at = np.flatnonzero(self.frequent(depth))
        return at, _join(self._contexts(depth)[at], self.a["hashes"][self.a["words"][at]])

    def chances(self, depth: int) -> np.ndarray:
        """Each token's chance by the longest state of up to ``depth`` words."""
        m, words = self.model, self.a["words"]
        p = (self.a["counts"][words] + 1.0) / (m["tokens"] + m["distinct"] + 1.0)
        for k in range(1, depth + 1):
            at = np.flatnonzero(self.a[f"s{k}"])
            seen = self.frequent(k)[at]
            pull = np.array((0.0, *m["weights"]))[self.a[f"s{k}"][at]] * seen
            p[at] = (self.a[f"n{k}"][at] + pull * p[at]) / (seen + pull)
        return p

    def tested(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose context is to be tested (frequent, and its suffix a state), the number of each one's context, and the contexts' sorted hashes."""
        open_ = self.frequent(depth) > 0
        if depth > 1:
            open_ &= self.a[f"s{depth - 1}"] > 0
        at = np.flatnonzero(open_)
        if depth > 1:
            keys, where = np.unique(self._contexts(depth)[at], return_inverse=True)
            return at, where, keys
        words = self._back(self.a["words"], len(self.a["hashes"]))[at]  # contexts of one word need no sorting of tokens
        there = np.flatnonzero(np.bincount(words, minlength=len(self.a["hashes"]) + 1))
        keys, rank = np.unique(_mix(np.append(self.a["hashes"], BEGIN)[there]), return_inverse=True)
        place = np.zeros(len(self.a["hashes"]) + 1, np.int64)
        place[there] = rank
        return at, place[words], keys

    def gains(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the contexts to be tested, and the sums of their log ratios by weight."""
        at, where, keys = self.tested(depth)
        learned = self.train[at]
        at, where = at[learned], where[learned]
        seen, n, p = (x[at].astype(np.float32) for x in (self.frequent(depth), self.a[f"n{depth}"], self.chances(depth - 1)))
        out = np.empty((len(keys), len(self.model["weights"])), np.float32)
        for i, weight in enumerate(self.model["weights"]):
            pull = np.float32(weight) * seen
            out[:, i] = np.bincount(where, weights=np.log((n - 1 + pull * p) / ((seen - 1 + pull) * p)), minlength=len(keys))
        return keys, out

    def asks(self, step: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Questions of a round as (kind, sorted distinct keys, own values): words first, then grams of each length, and gains one round later."""
        if step == 0:
            return [(_COUNTS, *_summed(self.a["hashes"], np.bincount(self.a["words"][self.train], minlength=len(self.a["hashes"]))))]
        out = []
        if step <= self.model["depth"]:
            at, keys = self.grams(step)
            out.append((_COUNTS, *_summed(keys, self.train[at].astype(float))))
        if step > 1:
            out.append((_GAINS, *self.gains(step - 1)))
        return out

    def take(self, step: int, answers: dict[int, np.ndarray]) -> None:
        """Puts the answers, which are in the order of the keys, where later rounds look for them."""
        if step == 0:
            _, where = np.unique(self.a["hashes"], return_inverse=True)
            self.a["counts"] = answers[_COUNTS][where].astype(np.int64)
            return
        if step > 1:
            self.a[f"s{step - 1}"] = np.zeros(self.n, np.uint8)
            at, where, _ = self.tested(step - 1)
            if len(at):
                self.a[f"s{step - 1}"][at] = answers[_GAINS][where]
        if step <= self.model["depth"]:
            self.a[f"n{step}"] = np.zeros(self.n, np.int64)
            at, keys = self.grams(step)
            if len(at):
                self.a[f"n{step}"][at] = answers[_COUNTS][np.unique(keys, return_inverse=True)[1]]

    def scores(self) -> dict[str, np.ndarray]:
        lens, words, m = self.a["lens"], self.a["words"], self.model
        starts = np.cumsum(lens) - lens
        base = np.log10((self.a["counts"][words] + 1.0) / (m["tokens"] + m["distinct"] + 1.0))
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x  # noqa: E731  every document has an end
        deep = self.a["s1"] > 0 if m["depth"] else np.zeros(self.n, bool)
        return {"n_known": add((self.a["counts"][words] > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(self.chances(m["depth"]))), "n_deep": add(deep.astype(np.int64))}


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, weights=values, minlength=len(unique))


def _chunked(batches):
    """Chunks of documents; batches have doc_id, text, held_out."""
    from pyspark import TaskContext

    number, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SPLIT_BYTES, "right")))
            part = batch.slice(at, end - at)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
            flat = lists.flatten()
            full = pc.not_equal(pc.binary_length(flat), 0)  # white space at the ends leaves empty words
            doc = pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)]
            rows.append((part.column("doc_id"), part.column("held_out").to_numpy(zero_copy_only=False), np.bincount(doc, minlength=part.num_rows), flat.filter(full)))
            held += len(doc) + part.num_rows
            at = end
            if held >= CHUNK_TOKENS:
                yield _chunk(number, rows)
                number, rows, held = number + 1, [], 0
    if rows:
        yield _chunk(number, rows)


def _chunk(number: int, rows: list) -> pa.RecordBatch:
    told = pa.chunked_array([r[3] for r in rows]).combine_chunks().dictionary_encode()
    if isinstance(told, pa.ChunkedArray):
        told = told.combine_chunks()
    lens = np.concatenate([r[2] for r in rows]) + 1
    words = np.zeros(int(lens.sum()), np.int32)
    inside = np.ones(len(words), bool)
    inside[np.cumsum(lens) - 1] = False
    words[inside] = told.indices.to_numpy() + 1
    hashes = np.concatenate([[END], _word_hashes(told.dictionary)])
    ids = pa.chunked_array([r[0] for r in rows])
    arrays = {"ids": pc.fill_null(ids, 0).to_numpy().astype(np.int64), "known": pc.is_valid(ids).to_numpy(), "train": ~np.concatenate([r[1] for r in rows]).astype(bool), "lens": lens.astype(np.int64), "words": words, "hashes": hashes}
    return pa.record_batch({"chunk": [number], "tokens": [len(words)], "data": [pack(arrays)]}, _KEPT)


_CHUNKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])
_CHUNKS_SQL = "chunk long, bucket long, tokens long, data binary"
_KEPT = pa.schema([f for f in _CHUNKS if f.name != "bucket"])
_KEPT_SQL = "chunk long, tokens long, data binary"


def _asking(step: int, buckets: int, model: dict):
    """Questions of all chunks of a task, a row for each bucket that is asked something."""
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                for kind, keys, values in Chunk(unpack(data.as_py()), model).asks(step):
                    if not len(keys):
                        continue
                    place = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(keys)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        own = values[a:b].astype(np.int64) if kind == _COUNTS else values[a:b]
                        yield pa.record_batch({"chunk": [number], "bucket": [int(place[a]) + (kind << _KIND)], "tokens": [b - a], "data": [pack({"steps": np.diff(keys[a:b], prepend=np.uint64(0)), "values": own})]}, _CHUNKS)

    return run


def _answering(gain: float):
    """Sums of each key over all chunks, sent back to the chunks that asked. Rows of chunk -1 tell a bucket's distinct keys and their sum.

    For gains the answer is the number of the best weight, or 0 if even that one gains too little.
    """
    def run(batches):
        for group in groups(batches, "bucket"):
            bucket = int(group["bucket"][0])
            asked = [unpack(d) for d in group["data"]]
            unique, where = np.unique(np.concatenate([np.cumsum(x["steps"], dtype=np.uint64) for x in asked]), return_inverse=True)
            values = np.concatenate([x["values"] for x in asked])
            if bucket >> _KIND == _GAINS:
                sums = np.stack([np.bincount(where, weights=v) for v in values.T], axis=1)
                told = np.where(sums.max(axis=1) > gain, sums.argmax(axis=1) + 1, 0).astype(np.uint8)
            else:
                told = np.bincount(where, weights=values).astype(np.int64)
                yield pa.record_batch({"chunk": [-1], "bucket": [int((told > 0).sum())], "tokens": [int(told.sum())], "data": [b""]}, _CHUNKS)
            ends = np.cumsum([len(x["steps"]) for x in asked])
            for number, own in zip(group["chunk"].tolist(), np.split(told[where], ends[:-1]), strict=True):
                yield pa.record_batch({"chunk": [number], "bucket": [bucket], "tokens": [len(own)], "data": [pack({"told": own})]}, _CHUNKS)

    return run


def _taking(step: int, model: dict):
    """A chunk with its answers put in."""
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(unpack(own.column("data")[0].as_py()), model)
        told: dict[int, list[np.ndarray]] = {}
        answers = answers.sort_by("bucket")
        for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("data"), strict=True):
            told.setdefault(bucket >> _KIND, []).append(unpack(data.as_py())["told"])
        chunk.take(step, {kind: np.concatenate(parts) for kind, parts in told.items()})
        return pa.table({"chunk": [own.column("chunk")[0].as_py()], "tokens": [chunk.n], "data": [pack(chunk.a)]}, _KEPT)

    return run


def _kept(chunks: DataFrame, stage: Stage, name: str, tasks: int) -> DataFrame:
    """Writes chunks in buckets of their number, so that answers can be brought to them and they need not move again."""
    spark, table = chunks.sparkSession, f"chunks_{uuid.uuid4().hex}"
    chunks.write.bucketBy(tasks, "chunk").sortBy("chunk").format("parquet").option("path", f"{stage.path}/{name}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only; the files stay
    return out


def _scoring(model: dict):
    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                chunk = Chunk(unpack(data.as_py()), model)
                found = chunk.scores()
                ids = pa.array(chunk.a["ids"], mask=~chunk.a["known"])
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": ~chunk.a["train"], "n_tokens": chunk.a["lens"], "n_known": found["n_known"], "train_tokens": np.full(len(ids), int(model["tokens"])), "base_score": found["base_score"], "score": found["score"], "n_deep": found["n_deep"]})

    return run


def score(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = DEPTH, least: int = MIN_CONTEXT, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and n_deep: the tokens scored by a state beyond the root.

    Learns from all documents outside the held-out fold. A null text counts as empty and has one token, its end; a null id is kept and not
    held out. Repeated rows are scored alike and each is learned from. Very long texts are used whole. Without training documents the root
    gives every token the chance 1. An empty table gives an empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    model = {"depth": depth, "least": max(2, least), "weights": WEIGHTS, "tokens": 0, "distinct": 0}
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    cut = stage.write(rows.mapInArrow(_chunked, _KEPT_SQL), "cut")
    tokens, n = cut.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    buckets, tasks = int(tokens // BUCKET_KEYS + 1), int(n // TASK_CHUNKS + 1)
    chunks = _kept(cut.repartition(tasks, "chunk"), stage, "chunks", tasks)
    stage.keep("chunks")
    for step in range(depth + 2):
        asked = chunks.mapInArrow(_asking(step, buckets, dict(model)), _CHUNKS_SQL)
        answers = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answering(gain), _CHUNKS_SQL)
        if step == 0:
            answers = stage.write(answers, "word-counts")
            sums = answers.where("chunk = -1").agg(F.coalesce(F.sum("bucket"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
            model |= {"distinct": sums[0], "tokens": sums[1]}
        both = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
        learned = _kept(both.applyInArrow(_taking(step, dict(model)), _KEPT_SQL), stage, f"chunks-{step}", tasks)
        stage.keep(f"chunks-{step}")
        chunks, asked, answers, both = learned, None, None, None
        gc.collect()
        docs.sparkSession._jvm.System.gc()  # a round's shuffle files go once the driver's collector has seen that nothing refers to them
    return chunks.mapInArrow(_scoring(dict(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_deep long")
