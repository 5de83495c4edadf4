"""Queries over joins, de-duplication, keys, set operations, ordering, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.operators import conform, quality, rows
from roomflow.plans.registry import query
from roomflow.plans.tables import rooms
from roomflow.sources import readers, sinks
from roomflow.sources.places import stored


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of all parts; every third one under a key that no room has."""
    shifted = F.when(F.col("p_partkey") % 3 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    return readers.table(spark, sf_dir, "part").select(shifted.alias("l_partkey"), F.col("p_size").alias("area"), F.col("p_brand").alias("brand"))


@query("J4", """
    SELECT s_name, n_name, l_orderkey, l_linenumber, l_partkey FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey END""", rooms=False)
def hotels_with_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hotel with all of its rooms, and hotels without any."""
    hotels = readers.table(spark, sf_dir, "supplier").join(readers.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hotels = hotels.select("s_name", "n_name", F.when(F.col("s_suppkey") % 4 == 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("l_suppkey"))
    return rows.left_details(hotels, readers.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), "l_suppkey").drop("l_suppkey")


@query("J1 J2 J3 O2 N22", "SELECT row_id, l_partkey, coalesce(p_size, 0) AS area, p_brand AS brand FROM rooms LEFT JOIN part ON l_partkey = CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END")
def left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select("row_id", "l_partkey")
    return rows.left_details(r, _details(spark, sf_dir), "l_partkey").select("row_id", "l_partkey", F.coalesce("area", F.lit(0)).alias("area"), "brand").orderBy("row_id")


@query("J5", "WITH h AS (SELECT s_suppkey, 'https://' || CASE WHEN s_suppkey % 4 = 0 THEN 'moved.example/' ELSE 'stay.example/' END || s_suppkey AS url, s_name AS hotel_name, s_acctbal FROM supplier) SELECT row_id, rooms.hotel_name, h.hotel_name AS hotel_name_hotel, s_acctbal FROM rooms LEFT JOIN h ON regexp_replace(hotel_link, '#.*', '') = url")
def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("s_suppkey") % 4 == 0, F.lit("https://moved.example/")).otherwise(F.lit("https://stay.example/"))
    hotels = readers.table(spark, sf_dir, "supplier").select(F.concat(host, F.col("s_suppkey").cast("string")).alias("url"), F.col("s_name").alias("hotel_name"), "s_acctbal")
    r = rooms(spark, sf_dir).select("row_id", "hotel_name", F.regexp_replace("hotel_link", "#.*", "").alias("link"))
    return rows.left_by_urls(r, hotels, "link", "url").select("row_id", "hotel_name", "hotel_name_hotel", "s_acctbal")


@query("J6", "SELECT l_partkey, count(*) AS n FROM rooms WHERE l_partkey NOT IN (SELECT CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END FROM part) GROUP BY 1")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.orphans(rooms(spark, sf_dir).select("row_id", "l_partkey"), _details(spark, sf_dir), "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("J7 W5 W6", """
    WITH p AS (SELECT n_name AS city, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS hotel_id, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    k AS (SELECT *, 'HTL_' || lpad(row_number() OVER (ORDER BY city, hotel_id)::varchar, 5, '0') AS new_id FROM p)
    SELECT row_id, k.city, k.hotel_id, new_id FROM rooms JOIN k ON l_suppkey = s_suppkey""")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nation = readers.table(spark, sf_dir, "nation")
    supplier = readers.table(spark, sf_dir, "supplier")
    per_city = Window.partitionBy("city").orderBy("s_suppkey")
    hotels = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("n_name").alias("city"), "s_suppkey").withColumn("hotel_id", F.row_number().over(per_city))
    children = rooms(spark, sf_dir).select("row_id", F.col("l_suppkey").alias("s_suppkey")).join(hotels, "s_suppkey")
    _, moved = rows.rekey(hotels, children, "city", "hotel_id", "new_id", "HTL_", 5)
    return moved.select("row_id", "city", "hotel_id", "new_id")


@query("J9", "SELECT row_id, room_class AS a, CASE WHEN substr(md5('m1' || row_id), 1, 1) < '4' THEN 'SMALL' ELSE room_class END AS b FROM rooms")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select("row_id", "room_class")
    other = r.select("row_id", F.when(F.substring(F.md5(F.concat(F.lit("m1"), F.col("row_id"))), 1, 1) < "4", F.lit("SMALL")).otherwise(F.col("room_class")).alias("b"))
    return rows.aligned(r.withColumnRenamed("room_class", "a"), other, "row_id").select("row_id", "a", "b")


@query("J10", """
    WITH l AS (SELECT row_id, l_orderkey, lower(room_class) AS l FROM rooms), p AS (SELECT l_orderkey, row_id AS page_row, regexp_replace(lower(room_type), '\\s', '', 'g') AS p, row_id AS position FROM rooms),
    h AS (SELECT l.row_id, p.page_row, row_number() OVER (PARTITION BY l.row_id ORDER BY position) AS nth FROM l JOIN p USING (l_orderkey) WHERE contains(p, l) OR contains(l, p))
    SELECT row_id, page_row FROM rooms LEFT JOIN (SELECT row_id, page_row FROM h WHERE nth = 1) USING (row_id)""")
def matched_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir)
    page = r.select("l_orderkey", F.col("row_id").alias("page_row"), F.col("room_type").alias("page_name"))
    found = rows.match_rooms(r.select("row_id", "l_orderkey", "room_class"), page, "l_orderkey", "room_class", "page_name", "page_row", "row_id")
    return found.select("row_id", F.col("match.page_row").alias("page_row"))


@query("W1 W3", "SELECT hotel_name, room_class, l_linenumber, row_id FROM (SELECT *, row_number() OVER (PARTITION BY hotel_name, room_class, l_linenumber ORDER BY row_id) AS nth FROM rooms) WHERE nth = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.keep_first(rooms(spark, sf_dir).select("hotel_name", "room_class", "l_linenumber", "row_id"), ["hotel_name", "room_class", "l_linenumber"], ["row_id"])


@query("W2 O1", """
    SELECT hotel_name, room_class, location, row_id, rating FROM (
     SELECT *, try_cast(replace(CASE WHEN score_raw = 'nan' THEN NULL ELSE score_raw END, ',', '.') AS double) AS rating, row_number() OVER (PARTITION BY hotel_name, room_class, location ORDER BY try_cast(replace(CASE WHEN score_raw = 'nan' THEN NULL ELSE score_raw END, ',', '.') AS double) DESC NULLS LAST, row_id) AS nth FROM rooms) WHERE nth = 1""")
def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.functions.parse import score

    r = rooms(spark, sf_dir).select("hotel_name", "room_class", "location", "row_id", score(F.col("score_raw")).alias("rating"))
    return rows.keep_best(r, ["hotel_name", "room_class", "location"], "rating", ["row_id"]).orderBy("hotel_name", F.asc_nulls_last("location"), F.desc_nulls_last("rating"), "row_id")


@query("W4 O5", "SELECT DISTINCT room_class, hotel_name FROM rooms ORDER BY 1, 2 LIMIT 20")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distinct_sample(rooms(spark, sf_dir), ["room_class", "hotel_name"], 20)


@query("W5 W6", "SELECT row_id, row_number() OVER (ORDER BY hotel_name, row_id) AS id, 'ROOM_' || printf('%06d', row_number() OVER (ORDER BY hotel_name, row_id)) AS room_code FROM rooms")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows.dense_ids(rooms(spark, sf_dir).select("hotel_name", "row_id"), ["hotel_name", "row_id"])
    return r.select("row_id", "id", rows.padded_id(F.col("id"), "ROOM_", 6).alias("room_code"))


@query("U5", "SELECT DISTINCT regexp_replace(hotel_link, '#.*', '') AS hotel_link FROM rooms WHERE regexp_replace(hotel_link, '#.*', '') NOT IN (SELECT 'https://' || CASE WHEN s_suppkey % 5 = 0 THEN 'stay.example/' ELSE 'moved.example/' END || s_suppkey FROM supplier)")
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("s_suppkey") % 5 == 0, F.lit("https://stay.example/")).otherwise(F.lit("https://moved.example/"))
    seen = readers.table(spark, sf_dir, "supplier").select(F.concat(host, F.col("s_suppkey").cast("string")).alias("hotel_link"))
    return rows.unseen(rows.canonical_links(rooms(spark, sf_dir), "hotel_link"), seen, "hotel_link")


@query("U7", "SELECT event_id, array_to_string(list_filter(['x', event_type, 'y', event_type, 'x'], lambda v, i: i = 1 OR NOT list_contains((['x', event_type, 'y', event_type, 'x'])[1:i - 1], v)), ' | ') AS tags FROM events", rooms=False)
def ordered_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(rows.ordered_distinct(F.array(F.lit("x"), "event_type", F.lit("y"), "event_type", F.lit("x"))), " | ").alias("tags"))


@query("O3 A1", "SELECT hotel_name, count(*) AS n FROM rooms GROUP BY 1 ORDER BY n DESC, hotel_name LIMIT 10")
def top_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.operators.profile import value_counts

    return value_counts(rooms(spark, sf_dir), "hotel_name").limit(10)


@query("O6", "WITH s AS (SELECT l_linenumber AS setting, round(avg(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END), 2) AS score FROM lineitem GROUP BY 1) SELECT setting, score FROM s ORDER BY score DESC, setting LIMIT 1", rooms=False)
def best_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readers.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("setting")).agg(F.round(F.avg((F.col("l_quantity") >= 25).cast("int")), 2).alias("score"))
    return rows.best_setting(s, "score", "setting")


@query("S7", """
    WITH n AS (SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey + 10000000, p_size FROM part WHERE p_partkey % 10 = 1)
    SELECT coalesce(t.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.p_size, t.p_size) AS p_size, t.p_brand FROM part t FULL JOIN n ON t.p_partkey = n.p_partkey""", rooms=False)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = readers.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    new = part.where("p_partkey % 4 = 0").selectExpr("p_partkey", "p_size + 100 AS p_size").union(part.where("p_partkey % 10 = 1").selectExpr("p_partkey + 10000000", "p_size"))
    return sinks.upsert(part, new, "p_partkey", ["p_size"])


@query("S12", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", rooms=False)
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.key_violations(readers.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("S1 S13", "SELECT page_id, url FROM pages WHERE (page_id BETWEEN 0 AND 99 OR page_id BETWEEN 150 AND 100000000) AND starts_with(url, 'https')", rooms=False)
def ranged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.ranged(readers.table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", [(0, 99), (150, 100_000_000)], "url", "https")


@query("F8 H10", r"SELECT page_id, regexp_matches(url, '^https?://') AND regexp_extract(url, '^https?://([^/?#]*)', 1) = 'spam-farm.example.org' AND regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/[a-z]{2}/\d+') AS detail FROM pages", rooms=False)
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "pages").select("page_id", conform.detail_link(F.col("url"), "spam-farm.example.org", r"^/[a-z]{2}/\d+").alias("detail"))


@query("W7", """
    WITH c AS (SELECT room_class, count(*) AS n FROM rooms GROUP BY 1), k AS (SELECT row_id, room_class, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth FROM rooms),
    t AS (SELECT ceil(round(sum(n) * 0.3, 6))::bigint AS want, sum(n) AS total FROM c),
    e AS (SELECT room_class, n, floor(n * want / total)::bigint AS low, n * want / total - floor(n * want / total) AS part, want FROM c, t),
    f AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS rest FROM e),
    t2 AS (SELECT sum(rest) AS total, ceil(round(sum(rest) * 0.5, 6))::bigint AS want FROM f),
    e2 AS (SELECT f.room_class, f.rest, floor(f.rest * t2.want / t2.total)::bigint AS low, f.rest * t2.want / t2.total - floor(f.rest * t2.want / t2.total) AS part, t2.want FROM f, t2),
    q AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS test, rest - low - CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS validation FROM e2)
    SELECT row_id, room_class, CASE WHEN nth <= test THEN 'test' WHEN nth <= test + validation THEN 'validation' ELSE 'train' END AS split FROM k JOIN q USING (room_class)""")
def split_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(rooms(spark, sf_dir).select("row_id", "room_class"), "to-split")  # read for counts, cuts and rows
    return quality.stratified_split(r, "room_class", "row_id").select("row_id", "room_class", "split")


@query("W8", "SELECT row_id, CASE WHEN substr(md5('42|' || row_id), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM rooms")
def split_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.plain_split(rooms(spark, sf_dir).select("row_id"), "row_id", 0.2).select("row_id", "split")


@query("W8", """
    WITH c AS (SELECT room_class, count(*) AS n FROM rooms GROUP BY 1), k AS (SELECT row_id, room_class, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth FROM rooms),
    t AS (SELECT ceil(round(sum(n) * 0.2, 6))::bigint AS want, sum(n) AS total FROM c),
    e AS (SELECT room_class, floor(n * want / total)::bigint AS low, n * want / total - floor(n * want / total) AS part, want FROM c, t),
    q AS (SELECT room_class, low + CASE WHEN row_number() OVER (ORDER BY part DESC, room_class) <= want - sum(low) OVER () THEN 1 ELSE 0 END AS test FROM e)
    SELECT row_id, room_class, CASE WHEN nth <= test THEN 'test' ELSE 'train' END AS split FROM k JOIN q USING (room_class)""")
def split_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(rooms(spark, sf_dir).select("row_id", "room_class"), "to-split")
    return quality.stratified_split(r, "room_class", "row_id", (0.8, 0.2), names=("train", "test", "test")).select("row_id", "room_class", "split")


@query("W9", "SELECT row_id, room_class FROM (SELECT row_id, room_class, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth FROM rooms) WHERE nth <= 300")
def class_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample_per_class(rooms(spark, sf_dir).select("row_id", "room_class"), "room_class", 300, "row_id").select("row_id", "room_class")


@query("W10", """
    WITH k AS (SELECT row_id, room_class, row_number() OVER (PARTITION BY room_class ORDER BY md5('42|' || row_id)) AS nth, count(*) OVER (PARTITION BY room_class) AS size FROM rooms),
    d AS (SELECT DISTINCT room_class, size, unnest(range(1, 201)) AS draw FROM k),
    h AS (SELECT room_class, draw, ('0x' || substr(md5('42|' || room_class || '|' || draw), 1, 12))::bigint % size + 1 AS nth FROM d)
    SELECT room_class, draw, row_id FROM h JOIN k USING (room_class, nth)""")
def class_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select("row_id", "room_class")
    wanted = r.select("room_class").distinct().withColumn("n", F.lit(200))
    return quality.draws(r, "room_class", wanted, "row_id").select("room_class", "draw", "row_id")
