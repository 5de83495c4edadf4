"""Outliers, imputation, splits, sampling and balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflow.operators.profile import group_quantiles, quantiles, target_size
from roomflow.sources.places import stored


def _bounds(df: DataFrame, column: str, group: str | None, method: str, factor: float, shares: tuple[float, float]) -> DataFrame:
    """One row for each group, or for the whole table: bounds and rows."""
    ends = list(shares) if method == "percentile" else [0.25, 0.75]
    low, high = F.col("quantiles")[0], F.col("quantiles")[1]
    if method != "percentile":
        low, high = low - (high - low) * factor, high + (high - low) * factor
    bounds = [F.greatest(F.lit(0.0), low).alias("__low"), high.alias("__high")]
    if group is None:
        return quantiles(df, column, ends).select(*bounds, F.lit(None).cast("long").alias("__n"))
    return quantiles(df, column, ends, [group]).select(group, *bounds, F.col("n").alias("__n"))


def flag_outliers(df: DataFrame, column: str, group: str | None = None, method: str = "iqr", factor: float = 0.8, shares: tuple[float, float] = (0.05, 0.95), name: str = "outlier") -> DataFrame:
    """Q5: true outside the bounds of Q1-Q4; a missing value is outside; groups under 5 rows have no bounds; rows without group are null."""
    bounds = _bounds(df, column, group, method, factor, shares)
    if group:
        both = df.join(bounds, group, "left")
        small = F.col("__n") < 5
    else:
        both, small = df.join(F.broadcast(bounds)), F.lit(False)  # one row
    inside = small | F.coalesce(F.col(column).between(F.col("__low"), F.col("__high")), F.lit(False))
    flag = F.when(F.col(group).isNotNull(), ~inside) if group else ~inside
    return both.withColumn(name, flag).drop("__low", "__high", "__n")


def drop_outliers(df: DataFrame, column: str, group: str | None = None, method: str = "iqr", factor: float = 0.8, shares: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Q1-Q4: strict factor 0.8 and shares 5-95 %, loose 1.5 and 1-99 %, older sets 1.5 and 15-85 %."""
    return flag_outliers(df, column, group, method, factor, shares, "__out").where("NOT __out").drop("__out")


def fill_median(df: DataFrame, columns: Sequence[str], discrete: bool = False) -> DataFrame:
    """The medians are one row each; ``discrete``: the lower one of two middle values."""
    for c in columns:
        df = df.join(F.broadcast(group_quantiles(df, c, [0.5], discrete=discrete).select(F.col("quantiles")[0].alias(f"__{c}")))).withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    return df


def draw_key(seed: int, *columns: str) -> Column:
    """A text that orders rows at random, the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


#: Rows of one class that one task ranks, about.
BUCKET_ROWS = 20_000


def _ranked(df: DataFrame, group: str | None, seed: int, key: str, most: int | None = None) -> DataFrame:
    """Adds ``__rank`` (from 1) by the draw key within a group, spread over tasks.

    The first hex digits cut a group into buckets of about ``BUCKET_ROWS`` rows, by the size ``most`` of the largest group (counted where
    it isn't given); a row's rank is the rows of earlier buckets and its rank in its own bucket, so no task ranks a whole class.
    """
    groups = [group] if group else []
    if most is None:
        most = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    keyed = _drawn(df, seed, key, most)
    offsets = _offsets(keyed, groups).drop("__held")
    within = Window.partitionBy(*groups, "__bucket").orderBy("__draw")
    condition = [*groups, "__bucket"]
    return keyed.join(offsets, condition).withColumn("__rank", F.col("__before") + F.row_number().over(within)).drop("__draw", "__bucket", "__before")


def _drawn(df: DataFrame, seed: int, key: str, most: int) -> DataFrame:
    digits = next(d for d in range(1, 12) if 16**d * BUCKET_ROWS >= most)
    return df.withColumn("__draw", draw_key(seed, key)).withColumn("__bucket", F.substring("__draw", 1, digits))


def _offsets(keyed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of each bucket and of those before it."""
    sizes = keyed.groupBy(*groups, "__bucket").agg(F.count("*").alias("__held"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*groups, "__bucket", "__held", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"))


def _draws_at(df: DataFrame, group: str, seed: int, key: str, ranks: DataFrame, most: int) -> DataFrame | None:
    """The draw keys at some ranks of each group: ``ranks`` has (group, __name, __rank), and one row for each that there is comes back, with ``__draw``.

    Counts by bucket tell which bucket has a rank, and only the rows of these are ranked. None if rows with one key lie on both sides of
    such a rank: then the key alone doesn't tell them apart.
    """
    keyed = _drawn(df.select(group, key), seed, key, most)
    wanted = _offsets(keyed, [group]).join(ranks, group).where("__rank > __before AND __rank <= __before + __held")
    wanted = stored(wanted.select(group, "__bucket", "__before", "__name", "__rank"), "ranks")
    near = keyed.join(wanted.select(group, "__bucket", "__before").distinct(), [group, "__bucket"]).withColumn("__at", F.col("__before") + F.row_number().over(Window.partitionBy(group, "__bucket").orderBy("__draw")))
    spans = near.groupBy(group, "__bucket", "__draw").agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"))
    found = stored(spans.join(wanted, [group, "__bucket"]).where("__rank BETWEEN __low AND __high").select(group, "__name", "__draw", (F.col("__rank") < F.col("__high")).alias("__tied")), "draws")
    return None if not found.where("__tied").isEmpty() else found.drop("__tied")


def quotas(counts: dict, shares: Sequence[float]) -> dict:
    """Rows of each class for each part: the parts after the first are split off with their total rounded up, and so on within them.

    Each class gets its share rounded down, and the largest remainders get the rest.
    """
    left, out = dict(counts), {k: [] for k in counts}
    for part in range(len(shares) - 1):
        total = sum(left.values())
        want = math.ceil(round(total * (sum(shares[part + 1 :]) / sum(shares[part:])), 6))
        exact = {k: n * want / total if total else 0.0 for k, n in left.items()}
        rest = {k: int(x) for k, x in exact.items()}
        for k in sorted(exact, key=lambda k: (rest[k] - exact[k], str(k)))[: want - sum(rest.values())]:
            rest[k] += 1
        for k in out:
            out[k].append(left[k] - rest[k])
        left = rest
    for k in out:
        out[k].append(left[k])
    return out


def stratified_split(df: DataFrame, label: str, key: str, shares: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42, names: Sequence[str] = ("train", "validation", "test"), counts: dict | None = None) -> DataFrame:
    """Adds ``split``; exact quotas per class, seeded, disjoint and covering. Only the class counts come to the driver."""
    counts = counts or {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    table = [(k, *_cuts(q)) for k, q in quotas(counts, shares).items()]
    if not table:
        return df.withColumn("split", F.lit(None).cast("string"))
    cuts = df.sparkSession.createDataFrame(table, df.select(label).schema.add("__a", "long").add("__b", "long"))
    ranks = cuts.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("__name"), F.col(c).alias("__rank")) for c in ("__a", "__b")])).alias("r")).select(label, "r.*")
    if (found := _draws_at(df, label, seed, key, ranks, max(counts.values()))) is not None:
        ends = cuts.select(label).join(found.groupBy(label).agg(*[F.max(F.when(F.col("__name") == c, F.col("__draw"))).alias(c) for c in ("__a", "__b")]), label, "left")
        draw = draw_key(seed, key)  # no rank up to a cut: no draw there, and no row in that part
        split = F.when(draw <= F.col("__a"), F.lit(names[-1])).when(draw <= F.col("__b"), F.lit(names[1])).otherwise(F.lit(names[0]))
        return df.join(ends, label).withColumn("split", split).drop("__a", "__b")
    ranked = _ranked(df, label, seed, key, max(counts.values())).join(cuts, label)
    split = F.when(F.col("__rank") <= F.col("__a"), F.lit(names[-1])).when(F.col("__rank") <= F.col("__b"), F.lit(names[1])).otherwise(F.lit(names[0]))
    return ranked.withColumn("split", split).drop("__rank", "__a", "__b")


def _cuts(quota: Sequence[int]) -> tuple[int, int]:
    """Ranks up to the first go to the last part, up to the second to the middle one."""
    return quota[-1], quota[-1] + (quota[1] if len(quota) > 2 else 0)


def plain_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """W8 without classes: the share by a hash of the key; about exact, and each row's part needs no other row."""
    cut = format(int(test * 16**8), "08x")
    return df.withColumn("split", F.when(F.substring(draw_key(seed, key), 1, 8) < cut, F.lit("test")).otherwise(F.lit("train")))


def sample_per_class(df: DataFrame, group: str, n: int | Column, key: str, seed: int = 42, most: int | None = None) -> DataFrame:
    """Exactly n rows of each class (all, if it has fewer); ``most``: rows of the largest class, if known."""
    if isinstance(n, int):
        if most is None:
            most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        ranks = df.where(F.col(group).isNotNull()).select(group).distinct().withColumns({"__name": F.lit("n"), "__rank": F.lit(n).cast("long")})
        if n > 0 and (found := _draws_at(df, group, seed, key, ranks, most)) is not None:
            inside = F.col("__draw").isNull() | (draw_key(seed, key) <= F.col("__draw"))  # no such rank: the class has fewer rows
            return df.where(F.col(group).isNotNull()).join(found.drop("__name"), group, "left").where(inside).drop("__draw")
    return _ranked(df, group, seed, key, most).where(F.col("__rank") <= n).drop("__rank")


def draws(df: DataFrame, group: str, wanted: DataFrame, key: str, seed: int = 42, name: str = "draw", most: int | None = None) -> DataFrame:
    """Rows drawn with replacement; ``wanted`` has (group, n). The i-th draw of a class takes rank hash(seed, class, i) mod size + 1."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__size"))
    each = wanted.where("n > 0").join(sizes, group).select(group, "__size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias(name))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(name).cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = each.withColumn("__rank", number % F.col("__size") + 1).drop("__size")
    some = df.join(wanted.where("n > 0").select(group), group, "left_semi")
    return drawn.join(_ranked(some, group, seed, key, most), [group, "__rank"]).drop("__rank")


def balance(df: DataFrame, group: str, key: str, numeric: Sequence[str], share: float = 0.7, seed: int = 42, jitter: float = 0.0, copula: bool = False) -> DataFrame:
    """Q6, Q7: every class gets the target size (A26); larger ones are sampled, smaller ones get generated rows.

    A generated row has the text of one draw of its class. Its numbers are those of a second draw, each moved by up to ``jitter`` of itself
    (a bootstrap), or with ``copula`` drawn from a model of the class (``operators.copula``). ``row_origin`` tells real and generated apart.
    """
    from roomflow.operators.copula import generate

    held = stored(df.where(F.col(group).isNotNull()), "unbalanced")  # read by all that follows
    target = target_size(held, group, share).first()[0] or 0
    sizes = held.groupBy(group).agg(F.count("*").alias("size"))
    wanted = sizes.select(group, F.greatest(F.lit(target) - F.col("size"), F.lit(0)).alias("n"))
    most = sizes.agg(F.max("size")).first()[0] or 0
    real = sample_per_class(held, group, target, key, seed, most).withColumn("row_origin", F.lit("Real"))
    text = draws(held, group, wanted, key, seed + 1, most=most).drop(*numeric)
    numbers = generate(held, group, wanted, key, numeric, seed + 2) if copula else draws(held.select(group, key, *numeric), group, wanted, key, seed + 2, most=most).drop(key)
    made = text.join(numbers, [group, "draw"])
    if jitter and not copula:
        for i, c in enumerate(numeric):
            unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-{i}"), F.col(group).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 2**31 - 1
            made = made.withColumn(c, F.col(c) * (1 + unit * jitter))
    made = made.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("-g"), F.col("draw").cast("string"))).drop("draw").withColumn("row_origin", F.lit("AI_Generated"))
    return real.withColumn(key, F.col(key).cast("string")).unionByName(made)


def suspect_labels(df: DataFrame, label: str, predicted: str, confidence: str, least: float = 0.9) -> DataFrame:
    """Q8, Q9: rows whose prediction differs from the label at a confidence of at least ``least``."""
    return df.where((F.col(label) != F.col(predicted)) & (F.col(confidence) >= least))
