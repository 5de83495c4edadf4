"""Toxicity by compression distance: windows of a text against one dictionary of toxic and one of ordinary text.

A window is one word, its head in capitals so that a match tells where words start, written three times so that a frame's fixed costs hide
nothing. Two zstandard dictionaries of one size are made apart: one of the toxic documents' telling words, and one of the ordinary words that
are most like those. A window is compressed with each of them and with a neutral dictionary of that size. What it saves by the toxic one,
and by how much more than by the ordinary one, is counted over a text's words and calibrated to a score on labelled documents that the
dictionaries in use have not seen (cross-fitting).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import ship

#: Bounds of the fit: labelled documents of each kind, and different words of one of them, that come to the driver.
TOXIC_DOCS, ORDINARY_DOCS, DOC_WORDS = 1400, 4500, 2000
#: A word tells toxic text if it starts with letters (so many) that this share of documents with them has, kinds weighing alike, in at least so many toxic ones.
LETTERS, SHARE, LEAST = (3, 8), 0.95, 6
#: Ordinary words that save so many bytes by the toxic dictionary go to the ordinary one, up to its size; bytes of the toxic one at most.
ALIKE, ORDINARY_BYTES, TOXIC_BYTES = 4, 3000, 100_000
#: Letters of a word's head; shortest match in bytes; copies of a word in its window; folds of the calibration.
HEAD, MATCH, COPIES, FOLDS = 4, 5, 3, 3
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
_END = b"\x1f" * 12
#: Levels of both kinds of savings at which words are counted.
_MORE, _SAVED = (1, 2, 3, 4), (3, 4, 5, 6, 7)


def words_of(text: str | None) -> list[str]:
    """The different words (letters and digits) of the whole text, lower-cased, in order."""
    return list(dict.fromkeys(_WORD.findall((text or "").lower())))


def coded(word: str) -> str:
    return word[:HEAD].upper() + word[HEAD:]


def window(word: str) -> bytes:
    return f" {' '.join([coded(word)] * COPIES)} ".encode("utf-8", "surrogatepass")


def _dictionary(words: list[str], most: int) -> bytes:
    return f" {' '.join(map(coded, words))} ".encode("utf-8", "surrogatepass")[-most:] + _END if words else _END


def telling_words(toxic: list[list[str]], ordinary: list[list[str]]) -> list[str]:
    """Words of toxic documents that start with telling letters, the commonest last (a dictionary's end is the cheapest to refer to).

    Of telling starts the shortest count, since a longer one says no more.
    """
    low, high = LETTERS

    def starts(words: list[str]) -> set[str]:
        return {w[:k] for w in words for k in range(low, min(high, len(w)) + 1)}

    seen = {s: n for s, n in Counter(s for ws in toxic for s in starts(ws)).items() if n >= LEAST}
    other = Counter(s for ws in ordinary for s in starts(ws) & seen.keys())
    share = lambda s: (seen[s] / len(toxic)) / (seen[s] / len(toxic) + other[s] / max(1, len(ordinary)))
    telling = {s for s in seen if share(s) >= SHARE}
    held = Counter(w for ws in toxic for w in ws if any(w[:k] in telling for k in range(low, high + 1)))
    return [w for w, _ in sorted(held.items(), key=lambda x: (x[1], x[0]))]


class ToxicityModel:
    """The dictionaries' contents, padded to one size, and the weights; compressors are made once per worker."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None):
        size = max(len(toxic), len(ordinary))
        filler = np.random.default_rng(1).integers(1, 31, size, dtype=np.uint8).tobytes()  # control characters match no word
        self.contents = {"toxic": filler[: size - len(toxic)] + toxic, "ordinary": filler[: size - len(ordinary)] + ordinary, "neutral": filler}
        self.heads = {h for c in (toxic, ordinary) for h in re.findall(r" ([^ ]{1,%d})" % HEAD, c.decode("utf-8", "replace"))}
        self.weights = np.zeros(self.width()) if weights is None else weights
        self.made, self.known = None, {}

    def __getstate__(self):
        return {**self.__dict__, "made": None, "known": {}}

    def _compressors(self) -> list:
        import zstandard

        params = zstandard.ZstdCompressionParameters(min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, hash_log=17, chain_log=17, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0)
        out = []
        for name in ("toxic", "ordinary", "neutral"):
            d = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out

    def lengths(self, word: str) -> tuple[int, int, int]:
        """Compressed lengths of a word's window with the toxic, the ordinary and the neutral dictionary."""
        self.made = self.made or self._compressors()
        return tuple(len(c.compress(window(word))) for c in self.made)

    def gain(self, word: str) -> tuple[int, int]:
        """Bytes that a window is shorter with the toxic dictionary than with the ordinary and than with the neutral one.

        A word whose head is in neither dictionary has no start to match and gains nothing.
        """
        if coded(word)[:HEAD] not in self.heads:
            return 0, 0
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known = {}
            toxic, ordinary, neutral = self.lengths(word)
            found = self.known[word] = (ordinary - toxic, neutral - toxic)
        return found

    def gains(self, words: list[str]) -> np.ndarray:
        return np.array([self.gain(w) for w in words] or [(0, 0)])

    @staticmethod
    def width() -> int:
        return 4 + 2 * (len(_MORE) + len(_SAVED))

    @staticmethod
    def features(gains: np.ndarray) -> np.ndarray:
        more, saved = gains[:, 0], gains[:, 1]
        counts = np.array([*[(more >= k).sum() for k in _MORE], *[(saved >= k).sum() for k in _SAVED]], float)
        return np.concatenate([[1.0, np.clip(more.max(), -1, 8), np.clip(saved.max(), -1, 8)], np.log1p(counts), np.log1p(100 * counts / len(gains)), [np.log(len(gains))]])

    def score(self, text: str | None) -> tuple[float, str | None, int, int]:
        """Score, the word that saves most by the toxic dictionary (null if none saves anything), its savings, and the words there are."""
        words = words_of(text)
        gains = self.gains(words)
        at = int(gains[:, 1].argmax())
        best = int(gains[at, 1])
        return 1 / (1 + np.exp(-float(np.clip(self.features(gains) @ self.weights, -30, 30)))), words[at] if words and best > 0 else None, best, len(words)


def _dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """The toxic dictionary of the telling words, and the ordinary one of the ordinary words that save most by it, these last."""
    own = _dictionary(telling_words(toxic, ordinary), TOXIC_BYTES)
    model = ToxicityModel(own, _END)
    alike = sorted((n, w) for w in {w for ws in ordinary for w in ws} if (n := model.gain(w)[1]) >= ALIKE)
    return own, _dictionary([w for _, w in alike], ORDINARY_BYTES)


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1e-2, start: np.ndarray | None = None) -> np.ndarray:
    """Weights by Newton's method with a small ridge; each row counts as so many ``rows``, which are scaled to 1 on average."""
    w, rows = np.zeros(x.shape[1]) if start is None else start.copy(), rows / rows.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (rows * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from labelled documents outside the held-out fold.

    The ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` labelled ids that come first by a hash are the sample; of each of their texts up to ``DOC_WORDS``
    different words, those that come first by a hash, come to the driver (of several texts under one id, the one with the smallest hash).
    The documents are dealt into ``FOLDS`` parts; each part is measured with dictionaries made of the others, which calibrates the score, and
    the dictionaries in use are made of all. In the calibration each kind weighs as much as its documents among all training labels, so that
    a score is a chance at the labels' own odds, whatever the bounds cut off. Labels other than 0 and 1, null texts and ids without a
    document are passed over. Without labels of both kinds every score is the share of toxic labels. Every constant above was chosen by
    cross-validation within the rows that may be learned from.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())  # two rows
    order = F.xxhash64("id", F.lit("toxicity"))
    sample = known.where("toxic = 1").orderBy(order, "id").limit(TOXIC_DOCS).union(known.where("toxic = 0").orderBy(order, "id").limit(ORDINARY_DOCS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "id")
    one = rows.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))

    @F.pandas_udf("array<string>")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(words_of(t), key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:DOC_WORDS])

    texts = one.select("id", "toxic", "row.hash", drawn("row.text").alias("words")).toPandas()  # at most the sample's rows, of bounded length
    texts = texts.sort_values("id").drop_duplicates(["toxic", "hash"]).sample(frac=1, random_state=3)  # copies would be measured with dictionaries that know them
    one_of: dict[str, str] = {}  # each word once, however many documents have it
    kinds = {kind: [[one_of.setdefault(w, w) for w in held] for held in texts[texts["toxic"] == kind]["words"]] for kind in (1, 0)}
    del texts
    if not all(kinds.values()):
        return ToxicityModel(_END, _END, np.array([30.0 if kinds[1] else -30.0, *[0.0] * (ToxicityModel.width() - 1)]))

    def made(fold: int | None) -> ToxicityModel:
        """Dictionaries of all documents outside a fold (of all, where that leaves none)."""
        own = {kind: [w for i, w in enumerate(held) if i % FOLDS != fold] or held for kind, held in kinds.items()}
        return ToxicityModel(*_dictionaries(own[1], own[0]))

    x, y = [], []
    for fold in range(FOLDS):
        part = made(fold)
        for kind, held in kinds.items():
            x += [part.features(part.gains(w)) for w in held[fold::FOLDS]]
            y += [kind] * len(held[fold::FOLDS])
    y = np.array(y, float)
    share = {kind: len(held) * counts[kind] / min(counts[kind], most) for (kind, held), most in zip(kinds.items(), (TOXIC_DOCS, ORDINARY_DOCS), strict=True)}
    model = made(None)
    model.weights = _logistic(np.stack(x), y, np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum()))
    return model


def toxicity_of(model: ToxicityModel):
    """A column function of a text column: struct of score, word, saved and words."""
    @F.pandas_udf("score double, word string, saved long, words long")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in texts], columns=["score", "word", "saved", "words"])

    return scored


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the word that is most like toxic ones (null if none is), the bytes it saves and the different words there are.

    Null text counts as empty; a text without words has a score like any other. Repeated rows stay, a null id is kept and not held out.
    Very long texts are scored whole. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("found", toxicity_of(model)("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.word", "found.saved", "found.words")
