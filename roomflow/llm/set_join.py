"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

Documents with equal shingle sets form a class and are joined through one representative. Each independent tree
starts with all representatives in its root. A node picks some of the minwise tokens; a document goes to one child for
each picked token, so similar documents share a child with high probability. Nodes of up to ``SMALL`` documents are compared
exhaustively. A larger node first links documents to its pivot, on full sets; where that leaves all of its documents in one
component, nothing is left to find and the node is done, and else all of its documents branch again. So the work on a family of near
copies ends with the first levels, and no level emits more than 1.25 rows for each of its documents on average.

Small nodes are compared in two passes. First, sketches give each node a forest of its likest pairs, and those are confirmed on full
shingle sets. Then, in nodes that still hold several components with candidates between them, the full sets of those documents are
compared with each other in place; the same group found in several nodes is compared once. No pass emits all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflow.llm.chunks import slices
from roomflow.llm.common import Stage, groups
from roomflow.llm.components import components
from roomflow.llm.shingles import minwise, shingle_sets

TOKENS = 64
#: trees; tokens that a root picks (an inner node picks one, and one in four picks two, 1 / 0.8 on average); largest node that is
#: compared exhaustively. A pair at the threshold 0.8 misses all 12 children of the roots once in 2 * 10**8, and keeps as many shared
#: nodes on each level below on average.
TREES, ROOT_PICKS, SMALL = 3, 4, 2048
#: Sketch estimate (standard error 0.05 at 0.8) from which a pair is compared on full sets: four standard errors below 0.8.
CANDIDATE = 0.6
_NIBBLES = 0x1111111111111111
SKETCH = ["s0", "s1", "s2", "s3"]
#: Documents and shingles for which a task is worth starting.
TASK_DOCS, TASK_SHINGLES = 2048, 1 << 19


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, most=2_000_000):
                sets, sizes = shingle_sets(piece.column("text").to_pylist(), size)
                tokens = minwise(sets, sizes, TOKENS)
                some = np.flatnonzero(sizes)
                ends = np.cumsum(sizes[some])
                keys = np.zeros((len(sizes), 2), np.int64)
                for row, end, n in zip(some.tolist(), ends.tolist(), sizes[some].tolist(), strict=True):
                    keys[row] = np.frombuffer(xxhash.xxh3_128_digest(sets[end - n : end].tobytes()), np.int64)
                full = np.zeros((len(sizes), TOKENS), np.uint32)
                full[some] = tokens
                nibbles = (full & np.uint32(15)).astype(np.uint64).reshape(len(sizes), 4, 16)
                sketch = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * TOKENS, pa.int32()), pa.array(full.ravel().view(np.int32)))
                columns = [piece.column("doc_id"), piece.column("text_key"), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, *(pa.array(sketch[:, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "k0", "k1", "tokens", *SKETCH])

    return run


def _likeness(other: list[str]) -> Column:
    """Estimated Jaccard similarity of two sketches of 64 four-bit tokens: chance agreements (1 in 16) are taken off."""
    misses = F.lit(0)
    for a, b in zip(SKETCH, other, strict=True):
        x = F.col(a).bitwiseXOR(F.col(b))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        misses = misses + F.bit_count(x.bitwiseAND(F.lit(_NIBBLES)))
    return 1 - misses * (16 / 15 / TOKENS)


def _children(rows: DataFrame, level: int) -> DataFrame:
    """(node, doc, tokens) to (node, doc): one child for each token that the node picks."""
    def key(k: int) -> Column:
        at = F.pmod(F.xxhash64("node", F.lit(1000 * level + k)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", F.lit(level), at, F.get("tokens", at))

    if level == 1:
        keys = F.array(*[key(k) for k in range(ROOT_PICKS)])
    else:
        keys = F.when(F.pmod(F.xxhash64("node", F.lit("picks")), F.lit(4)) == 0, F.array(key(0), key(1))).otherwise(F.array(key(0)))
    return rows.select("doc", F.explode(F.array_distinct(keys)).alias("node"))


def _trees(reps: DataFrame, texts_of, stage: Stage, size: int, percent: int, tasks: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs the trees: (node, doc, sketch) of all small nodes, and the links to pivots of large ones (None without large nodes).

    A level costs at most 1.25 rows for each document in large nodes of several components; where documents differ, nodes shrink by
    their similarity on each level, so the levels end. Joins on a large node are split by Spark's skew handling. A step has at most
    ``tasks`` tasks, which follow the input, so that the many small steps do not pay for each partition of a shuffle.
    """
    rows = reps.select("doc", "tokens", F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("tree")).select("doc", "tokens", F.xxhash64("tree").alias("node"))
    found, links, level = None, None, 0
    while True:
        level += 1
        lean = _children(rows, level)
        pivot = F.min(F.struct(F.xxhash64("doc", F.lit(level)), "doc")).getField("doc").alias("pivot")
        sizes = stage.write(lean.groupBy("node").agg(F.count("*").alias("n"), pivot).where("n > 1").coalesce(tasks), f"sizes-{level}")
        held = stage.write(lean.join(sizes, "node").coalesce(tasks).join(reps.select("doc", *SKETCH), "doc").coalesce(tasks), f"held-{level}")
        leaves = held.where(f"n <= {SMALL}").select("node", "doc", *SKETCH)
        found = leaves if found is None else found.unionByName(leaves)
        large = sizes.where(f"n > {SMALL}")
        if large.isEmpty():
            return found, links
        centres = large.join(reps.select(F.col("doc").alias("pivot"), *[F.col(s).alias(f"p{s}") for s in SKETCH]), "pivot")
        inside = held.where(f"n > {SMALL}").select("node", "doc", *SKETCH)
        like = inside.join(centres.select("node", "pivot", *[f"p{s}" for s in SKETCH]), "node").where((F.col("doc") != F.col("pivot")) & (_likeness([f"p{s}" for s in SKETCH]) >= CANDIDATE))
        pairs = like.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).coalesce(tasks).distinct()
        if links is not None:
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        pairs = stage.write(pairs.coalesce(tasks), f"like-pivot-{level}")
        texts = texts_of(pairs, f"near-pivot-{level}")
        star = _confirm(pairs, texts, size, percent, tasks)
        links = stage.write(star if links is None else links.unionByName(star), f"to-pivot-{level}")
        labels = components(links, stage, f"pivot-{level}").withColumnRenamed("node", "doc")
        labelled = inside.select("node", "doc").join(labels, "doc", "left").select("node", "doc", F.coalesce("component", "doc").alias("label")).coalesce(tasks)
        open_nodes = stage.write(labelled.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node").coalesce(tasks), f"open-{level}")
        rows = inside.select("node", "doc").join(open_nodes, "node").coalesce(tasks).join(reps.select("doc", "tokens"), "doc").coalesce(tasks)
        stage.drop(f"like-pivot-{level}", f"near-pivot-{level}", f"to-pivot-{level - 1}", f"sizes-{level - 1}", f"open-{level - 1}")


def _estimates(sketch: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Estimated similarities of the sketches ``of`` (rows) to all."""
    x = of[:, None, :] ^ sketch[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    misses = np.bitwise_count(x & np.uint64(_NIBBLES)).sum(axis=2, dtype=np.int32)
    return 1 - misses * (16 / 15 / TOKENS)


def _forest(sketch: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that spans all pairs of at least ``CANDIDATE``, likest first (Prim)."""
    n = len(sketch)
    like = _estimates(sketch, sketch) if n <= 128 else None
    if n == 2:
        return [(0, 1)] if like[0, 1] >= CANDIDATE else []
    if n <= 128 and not (np.triu(like, 1) >= CANDIDATE).any():
        return []
    best, origin, out = np.full(n, -1.0), np.zeros(n, np.int64), []
    waiting = np.ones(n, bool)
    for _ in range(n):
        k = int(np.where(waiting, best, -2).argmax())
        if best[k] >= CANDIDATE:
            out.append((int(origin[k]), k))
        waiting[k] = False
        row = _estimates(sketch, sketch[k : k + 1])[0] if like is None else like[k]
        closer = waiting & (row > best)
        best[closer], origin[closer] = row[closer], k
    return out


def _sketches(rows: dict) -> np.ndarray:
    return np.stack([rows[s] for s in SKETCH], axis=1).view(np.uint64)


def _likest(batches):
    """Pass one: a forest of the likest pairs of each node."""
    out = []
    for rows in groups(batches, "node"):
        docs = rows["doc"]
        out += [(docs[i], docs[j]) for i, j in _forest(_sketches(rows))]
    pairs = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _families(near: np.ndarray) -> list[np.ndarray]:
    """Connected groups of a symmetric table of candidates; rows without any are left out."""
    left, out = near.any(axis=1), []
    while left.any():
        seen = np.zeros(len(near), bool)
        new = seen.copy()
        new[left.argmax()] = True
        while new.any():
            seen |= new
            new = near[new].any(axis=0) & ~seen
        out.append(np.flatnonzero(seen))
        left &= ~seen
    return out


def _open(batches):
    """Pass two: the documents of a node that have a candidate in another component, in families that candidates connect.

    A family is named by its members, so that it has one name in all nodes that hold it.
    """
    out: dict[str, list] = {k: [] for k in ("family", "doc", "label")}
    for rows in groups(batches, "node"):
        label = rows["label"]
        if (label == label[0]).all():
            continue
        sketch = _sketches(rows)
        near = np.concatenate([(_estimates(sketch, sketch[i : i + 128]) >= CANDIDATE) & (label[i : i + 128, None] != label[None, :]) for i in range(0, len(label), 128)])
        for members in _families(near):
            docs = np.sort(rows["doc"][members])
            name = np.frombuffer(xxhash.xxh64_digest(docs.tobytes()), np.int64)
            for k, values in zip(out, (np.repeat(name, len(docs)), rows["doc"][members], label[members]), strict=True):
                out[k].append(values)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in out.values()], names=list(out))


def _common(sets: np.ndarray, sizes: np.ndarray, of: np.ndarray, most: int = 2_000_000, width: int = 4096) -> np.ndarray:
    """How many shingles the documents ``of`` (rows) have in common with each document.

    Shingles are taken in ranges of about ``most`` elements; those that two documents hold become columns of 0 and 1.
    """
    owner, out = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.zeros((len(of), len(sizes)), np.float32)
    bits = max(0, int(np.ceil(np.log2(max(1, len(sets) / most)))))
    part = (sets >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(sets), np.int32)
    for k in range(1 << bits):
        some = np.flatnonzero(part == k)
        _, column, held = np.unique(sets[some], return_inverse=True, return_counts=True)
        shared = held[column] > 1
        row, column = owner[some[shared]], (np.cumsum(held > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            at = slice(*np.searchsorted(column, (first, first + width)))
            table = np.zeros((len(sizes), width), np.float32)
            table[row[at], column[at] - first] = 1
            out += table[of] @ table.T
    return out.astype(np.int64)


def _compare(size: int, percent: int):
    """Links between components of a family, on full sets; one link joins two of them."""

    def sets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends, parts = np.cumsum([len(t) for t in texts]) // 2_000_000, []
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            parts.append(shingle_sets(texts[run[0] : run[-1] + 1], size))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def run(batches):
        out = []
        for rows in groups(batches, "family"):
            label, docs = rows["label"].copy(), rows["doc"]
            sets, sizes = sets_of(rows["text"].tolist())
            names, tally = np.unique(label, return_counts=True)
            outside = np.flatnonzero(label != names[tally.argmax()])  # pairs within the largest component need no link
            common = _common(sets, sizes, outside)
            linked = 100 * common >= percent * (sizes[None, :] + sizes[outside, None] - common)
            for k, hit in zip(outside, linked, strict=True):
                near = np.flatnonzero(hit & (label != label[k]))
                for other, first in zip(*np.unique(label[near], return_index=True), strict=True):
                    out.append((docs[k], docs[near[first]]))
                    label[label == other] = label[k]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int, tasks: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            good, known = [], {}
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            columns = [batch.column(c) for c in ("text_a", "text_b")]
            for i, (a, b) in enumerate(zip(*ids, strict=True)):
                if len(known) > 64:
                    known = {k: known[k] for k in (a, b) if k in known}
                for k, column in ((a, columns[0]), (b, columns[1])):
                    if k not in known:
                        known[k] = shingle_sets([column[i].as_py()], size)[0]
                both = len(np.intersect1d(known[a], known[b], assume_unique=True))
                good.append(100 * both >= percent * (len(known[a]) + len(known[b]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").coalesce(tasks)
    return left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are known by their id and a hash of their text; rows that have both in common are copies."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))


def _linked(docs: DataFrame, stage: Stage, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the classes (doc, k0, k1, first row's rep and text_key, its copies) and, for classes with links, their component.

    Classes get numbers of their own, so ids may be null or repeated.
    """
    slim = _rows(docs, id_col, text_col)
    signed = stage.write(slim.mapInArrow(_signatures(size), "doc_id long, text_key long, n_shingles long, k0 long, k1 long, tokens array<int>, " + ", ".join(f"{s} long" for s in SKETCH)), "signed")
    rows, shingles = signed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    tasks = int(max(rows // TASK_DOCS, shingles // TASK_SHINGLES) + 1)
    full = signed.where("n_shingles > 0")
    first_row = [F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key")]
    classes = stage.write(full.groupBy("k0", "k1").agg(*first_row).coalesce(tasks).withColumn("doc", F.monotonically_increasing_id()), "classes")
    same = F.col("doc_id").eqNullSafe(F.col("rep"))
    reps = full.join(classes, ["k0", "k1", "text_key"]).where(same).coalesce(tasks).groupBy("doc").agg(F.first("tokens").alias("tokens"), *[F.first(s).alias(s) for s in SKETCH], F.count("*").alias("copies"))
    reps = stage.write(reps.coalesce(tasks), "reps")

    def texts_of(pairs: DataFrame, name: str, hint: str | None = None) -> DataFrame:
        """(doc, text) of the classes in pairs (a, b)."""
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc")
        sought = stage.write(wanted.join(classes.select("doc", "rep", F.col("text_key").alias("key")), "doc").coalesce(tasks), f"{name}-sought")
        found = slim.join(sought.hint(hint) if hint else sought, same & (F.col("text_key") == F.col("key"))).select("doc", "text").coalesce(tasks).dropDuplicates(["doc"])
        return stage.write(found.coalesce(tasks), name)

    leaves, links = _trees(reps, texts_of, stage, size, percent, tasks)
    first = leaves.repartition("node").sortWithinPartitions("node").mapInArrow(_likest, "a long, b long").distinct()
    first = stage.write(first.coalesce(tasks), "pairs")
    texts = texts_of(first, "texts", "merge")
    confirmed = _confirm(first, texts, size, percent, tasks)
    links = stage.write(confirmed if links is None else links.unionByName(confirmed), "links")
    labels = components(links, stage, "c1").withColumnRenamed("node", "doc").withColumnRenamed("component", "label")
    labelled = leaves.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")).coalesce(tasks)
    families = labelled.repartition("node").sortWithinPartitions("node").mapInArrow(_open, "family long, doc long, label long")
    families = stage.write(families.dropDuplicates(["family", "doc"]).coalesce(tasks), "families")
    more = families.join(texts, "doc").coalesce(tasks).repartition("family").sortWithinPartitions("family").mapInArrow(_compare(size, percent), "a long, b long")
    every = stage.write(links.union(more), "all")
    joined = stage.write(components(every, stage, "c2").withColumnRenamed("node", "doc").join(classes.select("doc", "rep"), "doc").coalesce(tasks), "joined")
    classes = stage.write(classes.join(reps.select("doc", "copies"), "doc").coalesce(tasks), "known")
    stage.keep("signed", "known", "joined")
    return signed, classes, joined


def near_duplicates(docs: DataFrame, stage: Stage, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when the Jaccard similarity of their shingle sets is at least ``percent`` / 100; component_id is the
    smallest id that a document reaches over links. A null or empty text, or one without words, has no shingle and links with
    nothing. Texts shorter than a shingle count as one shingle. Repeated rows stay and share their component. Each row
    is compared by its text, whatever its id: texts under one id are documents of their own, and a row without id links
    like any other, has a component_id where it reaches an id, and is never marked as kept (see ``distinct_documents``).
    An empty table gives an empty result. Other columns are ignored. Very long texts are used whole.
    """
    signed, classes, joined = _linked(docs, stage, size, percent, id_col, text_col)
    tops = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = classes.select("k0", "k1", "doc", "rep").join(joined.select("doc", "component").join(tops, "component"), "doc", "left").select("k0", "k1", F.coalesce("component_id", "rep").alias("component_id"))
    ids = stage.write(ids, "ids")
    found = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "k0", "k1").join(ids, ["k0", "k1"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def distinct_documents(docs: DataFrame, stage: Stage, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component of near-duplicates: the one with the smallest id.

    A row without id comes after those with one and stays where its component has no other; under one id the text with the
    smallest hash stays, and of equal rows one. Rows without words link with nothing and all stay.
    """
    signed, classes, joined = _linked(docs, stage, size, percent, id_col, text_col)
    ranked = classes.join(joined.select("doc", "component"), "doc", "left").select(F.coalesce("component", "doc").alias("component"), F.struct(F.isnull("rep").alias("none"), "rep", "text_key", "copies").alias("row"))
    rows = ranked.groupBy("component").agg(F.min("row").alias("row")).select("row.rep", F.col("row.text_key").alias("key"), "row.copies")
    wordless = signed.where("n_shingles = 0").select(F.col("doc_id").alias("rep"), F.col("text_key").alias("key"), F.lit(1).cast("long").alias("copies")).distinct()
    rows = stage.write(rows.unionByName(wordless), "rows")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__key": F.xxhash64(text_col)})
    same = F.col("__id").eqNullSafe(F.col("rep")) & (F.col("__key") == F.col("key"))
    kept = keyed.join(rows.where("copies = 1"), same, "left_semi")
    if not rows.where("copies > 1").isEmpty():
        kept = kept.unionByName(keyed.join(rows.where("copies > 1"), same, "left_semi").dropDuplicates(["__id", "__key"]))
    return kept.select(*docs.columns)
