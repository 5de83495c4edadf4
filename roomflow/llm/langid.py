"""Language identification by words first, then by ever shorter character n-grams for words that were never seen."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflow.llm.chunks import _Index
from roomflow.llm.common import ship

#: Bound of the fit: documents per language to learn from (about). All of their words and n-grams are in the model.
PER_LANGUAGE, ORDERS = 1500, (5, 4, 3, 2, 1)
#: Added to every count; words that carry evidence of full weight; most that one word counts; memo.
SMOOTH, EVIDENCE, MOST_FOR_A_WORD, KNOWN = 0.1, 20, 8.0, 150_000
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numerals of any script (½, ①, Ⅷ) are no letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def _roll(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all n-grams of rows of code points."""
    n = codes.shape[1] - order + 1
    h = np.full((codes.shape[0], n), order, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ codes[:, k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with a 2 before and a 3 after, and their lengths."""
    full = [f"\x02{w}\x03" for w in words]
    counts = np.fromiter(map(len, full), np.int64, len(full))
    codes = np.zeros((len(full), max(5, int(counts.max()))), np.uint64)
    codes[np.arange(codes.shape[1]) < counts[:, None]] = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, counts


class Model:
    """Log frequencies by language: rows of ``values[order]`` for the sorted hashes in ``keys[order]``; order 0 holds words."""

    def __init__(self, languages: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.languages, self.keys, self.values = languages, {}, {}
        for order, (key, language, n) in counts.items():
            self.keys[order], row = np.unique(key, return_inverse=True)
            table = np.full((len(self.keys[order]), len(languages)), SMOOTH)
            np.add.at(table, (row, language), n)
            table = np.log(table / table.sum(axis=0))
            self.values[order] = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)
        self._start()

    def _start(self) -> None:
        self.at = _Index()
        self.at.new = []
        self.rows = np.zeros((1024, len(self.languages)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _find(self, order: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys.get(order, np.zeros(0, np.uint64))
        if not len(keys):
            return np.zeros(key.shape, bool), np.zeros(key.shape, np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, at

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies if known, else the mean of its known n-grams of the highest order that has any."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        known, at = self._find(0, np.fromiter(map(xxhash.xxh64_intdigest, (w.encode("utf-8", "surrogatepass") for w in words)), np.uint64, len(words)))
        out[known] = self.values[0][at[known]] if known.any() else 0
        left = np.flatnonzero(~known)
        left = left[np.argsort([len(words[i]) for i in left], kind="stable")]
        while len(left):
            n = 4096 if len(words[left[min(4095, len(left) - 1)]]) <= 64 else max(1, int(np.searchsorted([len(words[i]) for i in left[:4096]], 64, side="right")))
            some, left = left[:n], left[n:]
            codes, counts = _codes([words[i] for i in some])
            waiting = np.arange(len(some))
            for order in ORDERS:
                if not len(waiting):
                    break
                hit, at = self._find(order, _roll(codes[waiting], order))
                hit &= np.arange(hit.shape[1]) <= (counts[waiting] - order)[:, None]
                row, column = np.nonzero(hit)
                found = np.bincount(row, minlength=len(waiting))
                if len(row):
                    sums = np.stack([np.bincount(row, weights=self.values[order][at[row, column], k], minlength=len(waiting)) for k in range(len(self.languages))], axis=1)
                    got = found > 0
                    out[some[waiting[got]]] = sums[got] / found[got, None]
                    waiting = waiting[~got]
        return np.clip(out, -MOST_FOR_A_WORD, MOST_FOR_A_WORD)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without letters."""
        if len(self.at) > KNOWN:
            self._start()
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        new, self.at.new = self.at.new, []
        while self.at.count > len(self.rows):
            self.rows = np.resize(self.rows, (2 * len(self.rows), len(self.languages)))
        if new:
            self.rows[self.at.count - len(new) : self.at.count] = self.evidence(new)
        total = np.zeros((len(words), len(self.languages)))
        some = np.flatnonzero(counts)
        if not self.languages or not len(some):
            return [UNDETERMINED] * len(words), np.zeros(len(words))
        starts = np.cumsum(counts) - counts
        for k in range(len(self.languages)):
            total[some, k] = np.add.reduceat(self.rows[index, k], starts[some])
        total *= np.minimum(1, EVIDENCE / np.maximum(counts, 1))[:, None]
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        out = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), counts.tolist(), strict=True)]
        return out, np.where(counts > 0, share[np.arange(len(words)), best], 0.0)


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _count_words(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _hashed(order: int, number: dict[str, int]):
    """Rows (lang, gram, n) as numbers: hash, index of the language, count; 16 bytes instead of texts."""

    def run(batches):
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            if order:
                key = _roll(np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(-1, order), order)[:, 0] if grams else np.zeros(0, np.uint64)
            else:
                key = np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams), np.uint64, len(grams))
            language = np.fromiter((number[x] for x in batch.column("lang").to_pylist()), np.int32, len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(language), batch.column("n").cast(pa.int32())], names=["key", "language", "n"])

    return run


def _grams(text: Column, order: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - order + 1), lambda i: F.substring(text, i, F.lit(order)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from texts with a language outside the held-out fold.

    About ``PER_LANGUAGE`` documents of each language are taken by a hash of their id (all where there are fewer); their words and n-grams
    are counted in tasks, and the counts of the sample come to the driver.
    """
    ship(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    totals = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(totals)
    if not languages:
        return Model([], {})
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n))) for k, n in totals.items()))
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    words = sample.select("text", "lang").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    padded = F.concat(F.lit("\x02"), F.col("word"), F.lit("\x03"))
    counts: dict[int, tuple] = {}
    number = {x: i for i, x in enumerate(languages)}
    for order in (0, *ORDERS):
        if order:
            grams = _grams(padded, order)
            table = words.where(F.char_length(padded) >= order).select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        else:
            table = words.withColumnRenamed("word", "gram")
        rows = table.select("lang", "gram", "n").mapInArrow(_hashed(order, number), "key long, language int, n int").toArrow()  # of the sample, which is bounded
        key, language, n = (rows.column(c).to_numpy() for c in ("key", "language", "n"))
        counts[order] = (key.view(np.uint64), language.astype(np.int64), n.astype(np.float64))
    words.unpersist()
    return Model(languages, counts)


def language_of(model: Model):
    """A column function of a text column: struct of lang_pred and score."""
    shared = _broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches_of_text: pd.Series) -> pd.DataFrame:
        known = shared.value
        parts = [known.predict(batches_of_text.iloc[i : i + 1000].tolist()) for i in range(0, len(batches_of_text), 1000)]
        return pd.DataFrame({"lang_pred": [x for p, _ in parts for x in p], "score": np.concatenate([s for _, s in parts]) if parts else np.zeros(0)})

    return predict


def _broadcast(value):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(value)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text.

    Null texts and texts without letters are ``und`` with score 0. Ties go to the language that sorts first. Repeated rows stay. A
    null id isn't held out. An empty table gives an empty result; a model of no language gives ``und``. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("found", language_of(model)("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "found.lang_pred", "found.score")
