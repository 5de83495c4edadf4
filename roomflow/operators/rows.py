"""De-duplication, surrogate keys, joins, set operations and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflow.sources.places import stored


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``; null keys are equal.

    An aggregation rather than a window, so copies are dropped before the shuffle and a key with very many copies is no hot spot. All
    columns travel with the aggregate: select those that are wanted before it.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def keep_best(df: DataFrame, keys: Sequence[str], best: str, tie: Sequence[str]) -> DataFrame:
    """Per key the row with the highest ``best`` (missing last), then the first by ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(best).isNull(), -F.col(best), *tie)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def distinct_sample(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """W4."""
    return df.select(*columns).distinct().orderBy(*columns).limit(n)


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """1..n in sort order without a global window.

    Rows are range partitioned, sorted and written once to the shared folder with their place in their partition; both the counts of the
    partitions and the ids come from what is written, so they agree however Spark coalesces. Only one count per partition is gathered.
    The order must be total.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(ranged, "ids").withColumn("__part", F.shiftrightunsigned("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before", "__at")  # one row per partition


def padded_id(number: Column, prefix: str, width: int) -> Column:
    """W6."""
    return F.format_string(f"{prefix}%0{width}d", number)


def left_details(left: DataFrame, details: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Every left row, with details where there are any. Spark broadcasts details that are small when it runs."""
    return left.join(details, on, "left")


def left_by_urls(rooms: DataFrame, hotels: DataFrame, room_url: str, hotel_url: str, suffix: str = "_hotel") -> DataFrame:
    """Keys with different names; clashing columns of the right side get a suffix."""
    clash = {c: f"{c}{suffix}" for c in hotels.columns if c in rooms.columns}
    right = hotels.withColumnsRenamed(clash)
    key = clash.get(hotel_url, hotel_url)
    return rooms.join(right, rooms[room_url] == right[key], "left")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents, key, "left_anti")


def rekey(parents: DataFrame, children: DataFrame, scope: str, old: str, new: str, prefix: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Parents get new padded ids in the order of (scope, old id); children follow by both, since old ids repeat between scopes."""
    numbered = dense_ids(parents, [scope, old], "__n").withColumn(new, padded_id(F.col("__n"), prefix, width)).drop("__n")
    return numbered, children.join(numbered.select(scope, old, new), [scope, old], "left")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two models' rows side by side by a carried key; raises when the row counts differ."""
    if a.count() != b.count():
        raise ValueError("the tables have different numbers of rows")
    return a.join(b, key)


#: Longest gram of the containment index.
GRAM = 3


def _grams(text: Column, n: Column | int) -> Column:
    """Different substrings of length n; of a shorter text itself."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def containing_candidates(short: DataFrame, long: DataFrame, scope: str, a: str, b: str) -> DataFrame:
    """scope, a, b: pairs within a scope whose ``b`` has the rarest gram of ``a``, and so every pair whose ``b`` contains ``a``.

    Both sides must be distinct. A text's rarest gram is the one that fewest texts of the other side have in its scope; a text with a gram
    that none has is in none. So a scope with very many texts is spread over its grams, and common ones are not met.
    """
    index = long.select(scope, b, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col(b), n) for n in range(1, GRAM + 1)]))).alias("__gram"))
    counts = index.groupBy(scope, "__gram").agg(F.count("*").alias("__held"))
    asked = short.where(F.col(a).isNotNull()).select(scope, a, F.explode(_grams(F.col(a), F.least(F.lit(GRAM), F.length(a)))).alias("__gram")).join(counts, [scope, "__gram"], "left")
    held = F.coalesce("__held", F.lit(0))
    rarest = asked.groupBy(scope, a).agg(F.min_by("__gram", F.struct(held, "__gram")).alias("__gram"), F.min(held).alias("__least")).where("__least > 0").drop("__least")
    return rarest.join(index, [scope, "__gram"]).select(scope, a, b)


#: Rooms of a page up to which listings meet them all in a list.
PAGE_ROOMS = 64


def match_rooms(listings: DataFrame, page_rooms: DataFrame, link: str, name: str, page_name: str, position: str, key: str) -> DataFrame:
    """For each listing the first room of its page where either name contains the other, without case and spaces.

    A page of at most ``PAGE_ROOMS`` rooms travels once, as a list that its listings look through. Larger ones, if there are any, are met
    through an index of their names' grams.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    listed = listings.withColumn("__l", plain(F.col(name)))
    paged = page_rooms.withColumn("__p", plain(F.col(page_name))).where(F.col("__p").isNotNull() & F.col(position).isNotNull())
    wide = stored(page_rooms.groupBy(link).agg(F.count("*").alias("__n")).where(F.col("__n") > PAGE_ROOMS).select(link), "wide-pages")
    if wide.isEmpty():
        return _match_by_lists(listed, paged, link, position).select(*listings.columns, "match")
    few = _match_by_lists(listed.join(wide, link, "left_anti"), paged.join(wide, link, "left_anti"), link, position)
    many = _match_by_index(listed.join(wide, link, "left_semi"), paged.join(wide, link, "left_semi"), link, position)
    return few.select(*listings.columns, "match").unionByName(many.select(*listings.columns, "match"))


def _match_by_lists(listed: DataFrame, paged: DataFrame, link: str, position: str) -> DataFrame:
    rest = [c for c in paged.columns if c not in (link, position, "__p")]
    pages = paged.groupBy(link).agg(F.sort_array(F.collect_list(F.struct(position, "__p", *rest))).alias("__rooms"))
    fits = lambda x: x["__p"].contains(F.col("__l")) | F.col("__l").contains(x["__p"])
    first = F.get(F.filter("__rooms", fits), F.lit(0))
    both = listed.join(pages, link, "left").withColumn("__first", first)
    match = F.struct(*[F.col(f"__first.{c}").alias(c) for c in paged.columns if c not in (link, "__p")])
    return both.withColumn("match", F.when(F.col("__first").isNotNull(), match))


def _match_by_index(listed: DataFrame, paged: DataFrame, link: str, position: str) -> DataFrame:
    """Names meet once for each page however many rows have them."""
    columns = [c for c in paged.columns if c not in (link, "__p")]
    pages = paged.groupBy(link, "__p").agg(F.min_by(F.struct(*columns), position).alias("match"), F.min(position).alias("__at"))
    names = listed.select(link, "__l").distinct()
    inside = containing_candidates(names, pages, link, "__l", "__p").where(F.col("__p").contains(F.col("__l")))
    around = containing_candidates(pages.select(link, "__p"), names.where("__l IS NOT NULL"), link, "__p", "__l").where(F.col("__l").contains(F.col("__p")))
    hits = inside.unionByName(around).join(pages, [link, "__p"])
    best = hits.groupBy(link, "__l").agg(F.min_by("match", "__at").alias("match"))
    return listed.join(best, [link, "__l"], "left")


def union_all(*tables: DataFrame) -> DataFrame:
    """By name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def canonical_links(df: DataFrame, link: str) -> DataFrame:
    """Fragments off, distinct, sorted."""
    return df.select(F.regexp_replace(link, "#.*", "").alias(link)).distinct().orderBy(link)


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the seen ones."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def ordered_distinct(items: Column) -> Column:
    """U7."""
    return F.array_distinct(items)


def best_setting(results: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score; the earliest among equals."""
    return results.orderBy(F.desc(score), F.asc(order)).limit(1)
