"""Aggregations and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflow.sources.places import stored


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """A1, O3: null isn't counted; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """A2. The window runs over one row per value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def column_values(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """A5: per column the number of distinct values and the sorted values joined by ' | ' (at most ``most`` of them if given)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value IS NOT NULL").distinct()
    values = F.array_sort(F.collect_list("value"))
    return long.groupBy("column").agg(F.count("*").alias("n_values"), F.array_join(values if most is None else F.slice(values, 1, most), " | ").alias("values"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], groups: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Interpolated quantiles as an array, a row for each group (one for a whole table); ``approximate`` by sketches, for one pass."""
    if approximate:
        return sketch_quantiles(sketches(df, column, groups), shares, groups)
    return group_quantiles(df, column, shares, groups)


def whole_quantiles(df: DataFrame, column: str, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """A6, A8 over a whole table: one row with the interpolated quantiles as an array; null without values."""
    return group_quantiles(df, column, shares, (), name)


def group_quantiles(df: DataFrame, column: str, shares: Sequence[float], groups: Sequence[str] = (), name: str = "quantiles", discrete: bool = False) -> DataFrame:
    """Interpolated quantiles of each group as an array, and ``n``, its rows; null where a group has no values. A null group is a group.
    ``discrete``: the first value up to which that share of the rows lies, instead of an interpolated one.

    Equal values of a group are counted first; the counts are range partitioned and written with their place, and the values at the wanted
    ranks are picked by running sums within partitions and one total for each group in each partition. So no task holds the values of a
    group, though one may have nearly all rows.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    counts = df.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("v").asc_nulls_last()]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    placed = stored(ranged, "counted")
    present = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(F.lit(0))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per group and partition
    held = placed.groupBy(*keys, "part").agg(F.sum(present).alias("held"), F.sum("n").alias("rows"))
    totals = held.select(*[F.col(k).alias(f"t{k}") for k in keys], F.col("part").alias("tpart"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy(*keys)).alias("every"), F.sum("rows").over(Window.partitionBy(*keys)).alias("rows"))
    within = Window.partitionBy(*keys, "part").orderBy(F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("part") == F.col("tpart")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t{k}"))
    rows = placed.join(totals, same).withColumn("upto", F.col("start") + F.sum(present).over(within))
    picked, out = [F.max("every").alias("every"), F.max("rows").alias("rows")], []
    for i, share in enumerate(shares):
        at = F.greatest(F.ceil(F.lit(float(share)) * F.col("every")), F.lit(1)) - 1 if discrete else F.lit(float(share)) * (F.col("every") - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((F.col("upto") - present <= rank) & (rank < F.col("upto")), F.col("v"))).alias(f"{end}{i}"))
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    found = rows.groupBy(*keys).agg(*picked).select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], F.when(F.col("every") > 0, F.array(*out)).alias(name), F.col("rows").alias("n"))
    return found if groups else found.drop("n")


#: Size of a sketch; a value's rank is off by at most SKETCH_ERROR of the rows, at 99 % of the time.
SKETCH_K = 800
SKETCH_ERROR = 2.296 / SKETCH_K**0.9021


def sketches(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """A mergeable sketch of each group's values (``sketch``), of bounded size: one for each batch can be kept, and any of them put together."""
    return df.where(F.col(column).isNotNull()).groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), SKETCH_K).alias("sketch"))


def sketch_quantiles(kept: DataFrame, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Quantiles of each group over all of its sketches, and the rows that these have seen; values of the rows, with ranks about right."""
    merged = kept.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    found = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares])
    return merged.select(*groups, found.alias("quantiles"), F.kll_sketch_get_n_double("sketch").alias("n"))


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """A9."""
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])


def common_flags(df: DataFrame, group: str, names: Mapping[str, str], least: float = 0.7) -> DataFrame:
    """A10: display names of the flags that at least ``least`` of a group's rows have."""
    return flags_of_means(group_means(df, group, list(names)), group, names, least)


def flags_of_means(means: DataFrame, group: str, names: Mapping[str, str], least: float = 0.7) -> DataFrame:
    """A10 where the means are known."""
    means = means.unpivot([group], list(names), "flag", "share").where(F.col("share") >= least)
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("flag"))
    return means.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("common"))


def class_profile(df: DataFrame, group: str, price: str, area: str, flags: Mapping[str, str] | None = None) -> DataFrame:
    """p10, p90 and mean price, p10 and p90 area; with common flags if any are named. The rows are stored, since three steps read them."""
    held = stored(df.select(*dict.fromkeys((group, price, area, *(flags or ())))), "profiled")
    ends = lambda c: quantiles(held.where(F.col(group).isNotNull()), c, [0.1, 0.9], [group]).select(group, F.col("quantiles")[0].alias(f"{c}__10"), F.col("quantiles")[1].alias(f"{c}__90"))
    out = held.groupBy(group).agg(F.count("*").alias("n"), F.avg(price).alias("price_mean")).join(ends(price), group, "left").join(ends(area), group, "left")
    out = out.select(group, "n", F.col(f"{price}__10").alias("price_p10"), F.col(f"{price}__90").alias("price_p90"), "price_mean", F.col(f"{area}__10").alias("area_p10"), F.col(f"{area}__90").alias("area_p90"))
    return out.join(common_flags(held, group, flags), group, "left") if flags else out


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one aggregation, over the rows where both are present."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def box_summary(df: DataFrame, column: str, groups: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (outermost values within factor times the interquartile range) and outliers."""
    held = df.where(F.col(column).isNotNull())
    q = quantiles(held, column, [0.25, 0.5, 0.75], groups).withColumnRenamed("quantiles", "q").select(*groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    both = held.join(q, list(groups)) if groups else held.join(F.broadcast(q))  # one row
    x, width = F.col(column), (F.col("q3") - F.col("q1")) * factor
    inside = (x >= F.col("q1") - width) & (x <= F.col("q3") + width)
    return both.groupBy(*groups, "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outliers"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins between minimum and maximum; empty ones are there with 0."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col(column) - F.col("lo")) / width).cast("int"), F.lit(bins - 1)), F.lit(0))
    counts = df.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of each column."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def nested(df: DataFrame, keys: Sequence[str], first: Mapping[str, Column], room: Mapping[str, Column], order: str) -> DataFrame:
    """Per key its first row's attributes and the list of its rooms in order; rows with a null key are dropped.

    The list of one key must fit a row; a hotel's rooms do.
    """
    rows = df.na.drop("any", subset=list(keys)).select(*keys, F.col(order).alias("__o"), F.struct(*[c.alias(n) for n, c in first.items()]).alias("__first"), F.struct(F.col(order).alias("__o"), *[c.alias(n) for n, c in room.items()]).alias("__room"))
    grouped = rows.groupBy(*keys).agg(F.min_by("__first", "__o").alias("first"), F.sort_array(F.collect_list("__room")).alias("rooms"))
    return grouped.select(*keys, "first.*", F.transform("rooms", lambda r: F.struct(*[r[n].alias(n) for n in room])).alias("rooms"))


def best_rate(df: DataFrame, room: Sequence[str], kind: str, price: str) -> DataFrame:
    """Floor of the mean of 'ota' prices, else of 'ta' prices; rooms without either are dropped.

    Prices are added up as decimals, to a millionth: sums of doubles depend on the order of the rows, and the floor of a mean that is a whole
    number with them.
    """
    exact = F.col(price).try_cast("decimal(38, 6)")

    def mean(k: str) -> Column:
        own = F.when(F.col(kind) == k, exact)
        return F.try_divide(F.sum(own).cast("double"), F.count(own))

    return df.groupBy(*room).agg(F.floor(F.coalesce(mean("ota"), mean("ta"))).alias("rate")).where("rate IS NOT NULL")


def target_size(df: DataFrame, group: str, share: float = 0.7) -> DataFrame:
    """A quantile over the classes' sizes, as an integer."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(F.percentile("n", share).cast("int").alias("target"))


def shape(df: DataFrame) -> DataFrame:
    """Per column its type, non-null count and the table's rows."""
    one = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"__{i}").alias("present"), F.col("__rows").alias("rows")) for i, f in enumerate(df.schema)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
