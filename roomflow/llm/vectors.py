"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.llm.common import Stage, groups
from roomflow.llm.components import components

#: Share of pairs at the threshold that may be missed; vectors in a block of a large bucket; sketch bits.
MISS, BLOCK, BITS = 1e-5, 256, 256


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits in a key and tables: keys grow with log2 of the rows, tables follow from the pairs that may be missed."""
    bits = min(28, max(8, n.bit_length()))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _signed(bits: int, tables: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            got: list[list] = [[] for _ in range(8)]
            for vec_id, label, cell in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                if label is None or vec_id is None or not cell.is_valid or cell.values.null_count or not len(cell.values):
                    continue
                v = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all() or not v.any() or not 0 < float(v @ v) < math.inf:
                    continue
                got[0].append(vec_id), got[1].append(label), got[2].append(v + 0.0)
            for dim in {len(v) for v in got[2]}:
                rows = [i for i, v in enumerate(got[2]) if len(v) == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim, tables * bits + BITS))
                vectors = np.stack([got[2][i] for i in rows])
                signs = vectors @ planes[dim] > 0
                keys = signs[:, : tables * bits].reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                sketch = np.packbits(signs[:, tables * bits :], axis=1).copy().view(np.int64)
                digest = [np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64) for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([got[0][i] for i in rows], pa.int64()), pa.array([got[1][i] for i in rows], pa.int32()), pa.array([dim] * len(rows), pa.int32()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()),
                        pa.array(list(vectors), pa.list_(pa.float64())), pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(sketch), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "label", "dim", "k0", "k1", "vector", "keys", "sketch"],
                )

    return run


def _near(most: int):
    """Rows of a block that have a candidate partner by their sketches."""

    def run(batches):
        out: list[tuple] = []
        for g in groups(batches, "block"):
            if len(g["block"]) < 2:
                continue
            s = np.stack(g["sketch"]).view(np.uint64)
            close = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(axis=2) <= most
            np.fill_diagonal(close, False)
            hit = close.any(axis=1)
            out += list(zip(g["block"][hit].tolist(), g["rep"][hit].tolist(), g["first"][hit].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["block", "rep", "first"])

    return run


def _linked(threshold: float):
    """Exact cosines in a block: link counts of each vector and a spanning forest of the links.

    A pair is counted in the first table whose keys agree, and in the one block that holds both parts of a large bucket.
    """

    def run(batches):
        for g in groups(batches, "block"):
            if len(g["block"]) < 2:
                continue
            v, rep, size = np.stack(g["vector"]), g["rep"], g["size"]
            norm = np.sqrt((v * v).sum(axis=1))
            link = (v @ v.T) / (norm[:, None] * norm[None, :]) >= threshold
            np.fill_diagonal(link, False)
            side, other = g["side"], g["other"]
            if side[0] != other[0]:  # a block of two parts compares across
                link &= g["first"][:, None] != g["first"][None, :]
            table = int(g["table"][0])
            a, b = np.nonzero(link)
            if table and len(a):
                keys = np.stack(g["keys"])[:, :table]
                new = np.concatenate([~(keys[a[i : i + 65_536]] == keys[b[i : i + 65_536]]).any(axis=1) for i in range(0, len(a), 65_536)])
                a, b = a[new], b[new]
            if not len(a):
                continue
            counts = np.bincount(a, weights=size[b], minlength=len(rep)).astype(np.int64)
            parent = list(range(len(rep)))

            def top(k, parent=parent):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if i < j and (x := top(i)) != (y := top(j)):
                    parent[y] = x
            some = np.flatnonzero(counts)
            tops = np.array([top(k) for k in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(counts[some]), pa.array(rep[tops])], names=["rep", "links", "top"])

    return run


def near_vectors(table: DataFrame, stage: Stage, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; vectors of one label link at a cosine of ``threshold`` or more.

    Equal vectors form a class, which is compared once and counts with its size. Candidates share a key of sign bits in some
    table; links are counted where they are found, so pairs never leave a task: only counts and the block's components do. A
    bucket of any size is compared in blocks of ``BLOCK`` by ``BLOCK`` vectors, so a bucket of n different vectors makes n * n / ``BLOCK``
    rows before the sketches are compared: link counts need every pair, and copies count once. Null, zero and non-finite vectors, and rows without
    label or id, link with nothing (a row without id has no component and isn't kept). Vectors of different lengths never link.
    Repeated rows count as other vectors. An empty table gives an empty result. Other columns are ignored.
    """
    slim = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("int").alias("label"))
    bits, tables = plan(table.count(), threshold)
    schema = "vec_id long, label int, dim int, k0 long, k1 long, vector array<double>, keys array<int>, sketch array<long>"
    signed = stage.write(slim.mapInArrow(_signed(bits, tables), schema), "signed")
    kind = ["label", "dim", "k0", "k1"]
    classes = stage.write(signed.groupBy(*kind).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    members = stage.write(signed.select("vec_id", *kind).join(classes, kind).select("vec_id", "rep", "size"), "members")
    reps = stage.write(signed.join(classes.withColumnRenamed("rep", "vec_id"), [*kind, "vec_id"]).dropDuplicates([*kind, "vec_id"]).withColumnRenamed("vec_id", "rep"), "reps")
    lean = reps.select("rep", F.posexplode("keys").alias("table", "key"), "label", "dim").select("rep", "table", F.xxhash64("label", "dim", "table", "key").alias("bucket"))
    sizes = stage.write(lean.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    held = stage.write(lean.join(sizes, "bucket"), "held")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("rep", "table"), F.col("parts")).cast("int")
    dealt = held.withColumn("parts", parts).withColumn("first", part).withColumn("second", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = dealt.select("bucket", "table", "rep", "first", F.least("first", "second").alias("side"), F.greatest("first", "second").alias("other")).withColumn("block", F.xxhash64("bucket", "side", "other"))
    sketched = sides.join(reps.select("rep", "sketch"), "rep").select("block", "rep", "first", "sketch").repartition("block").sortWithinPartitions("block")
    angle = math.acos(threshold) / math.pi
    most = math.ceil(BITS * angle + 7 * math.sqrt(BITS * angle * (1 - angle)))
    near = stage.write(sketched.mapInArrow(_near(most), "block long, rep long, first int"), "near")
    full = near.join(sides.select("block", "rep", "table", "side", "other"), ["block", "rep"]).join(reps.select("rep", "vector", "keys", "size"), "rep")
    full = full.select("block", "rep", "first", "table", "side", "other", "size", "vector", "keys").repartition("block").sortWithinPartitions("block")
    found = stage.write(full.mapInArrow(_linked(threshold), "rep long, links long, top long"), "found")
    joined = components(found.select(F.col("rep").alias("a"), F.col("top").alias("b")).where("a <> b"), stage).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    out = members.join(links, "rep", "left").join(joined, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = slim.select("vec_id", "embedding", "label").where(~_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _valid():
    """Whether a row can link, by the same rule as the tasks that sign vectors."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & ~odd & (square > 0) & (square < float("inf")), F.lit(False))
