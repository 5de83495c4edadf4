"""Queries over the five sites' files, and over readers and sinks: each writes to the shared folder and reads back."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.functions import parse
from roomflow.operators import conform, rows
from roomflow.plans import site_maps
from roomflow.plans.registry import query
from roomflow.plans.tables import joined, rooms, rooms_of
from roomflow.sources import readers, sinks
from roomflow.sources.places import shared_folder, stored_by

#: Each site's file, as text made from the room rows: column names are the site's, values are ours. The hotels of two sites are files of
#: their own, made from suppliers; some have no id, so that some rooms find no hotel.
_HOTELS = "SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_TOURS_LINK = "concat('https://tours.example/', cast({key} as string))"
SITES = {
    "booking": """SELECT hotel_name AS "Hotel Name", hotel_link AS "Hotel Link", search_location AS "Search Location", address AS "Address", cast(l_linenumber % 5 as double) AS "Stars_Clean", cast(l_linenumber as double) / 2 AS "Rating_Clean",
        review_text AS "Review Count", room_type AS "Room Type", room_class AS "Room_Class", bed_type AS "Bed Type", cast(l_linenumber * 10 as double) + 0.5 AS "Area_m2_cleaned", l_linenumber AS "Total_Guests", cast(floor(original_price) as bigint) AS "Original Price",
        cast(floor(final_price) as bigint) AS "Final Price", cast(l_linenumber as string) AS "Discount %", free_cancel = 'Yes' AS "Free_Cancel_Bool", l_linenumber = 2 AS "Breakfast_Bool", facilities AS "Facilities_cleaned", check_in AS "Check-in" FROM rooms""",
    "trips": """SELECT cast(l_suppkey as string) AS "hotelId", hotel_name AS "hotelName", hotel_link AS "imageUrl", location AS "cityName", address, cast(l_linenumber as double) AS latitude, cast(l_linenumber as double) + 100 AS longitude, cast(l_linenumber % 5 as double) AS star,
        cast(l_linenumber as double) / 2 AS "commentScore", review_text AS "commenterNumber", room_type AS "roomNames", room_class AS "categoryName", cast(floor(final_price) as bigint) AS "minPrice", cast(floor(original_price) as bigint) AS "maxPrice", check_in AS "checkInDates", cast(NULL as string) AS "checkOutDates" FROM rooms""",
    "stays hotels": f"SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast(s_suppkey as string) END AS hotel_id, s_name AS hotel_name, concat('https://stays.example/', cast(s_suppkey as string)) AS hotel_link, n_name AS city FROM ({_HOTELS}) h",
    "stays rooms": "SELECT cast(l_suppkey as string) AS hotel_id, room_type AS room_name, bed_type, area_raw AS area_m2, l_linenumber AS max_occupancy, cast(floor(final_price) as bigint) AS price, facilities AS amenities FROM rooms",
    "advisor": """SELECT hotel_name, hotel_link AS hotel_url, address, cast(l_linenumber as double) / 2 AS "ratingValue", review_text AS "reviewCount", room_type AS room_types, facilities AS amenities, CASE WHEN l_linenumber = 3 THEN price_raw || ' - ' || price_raw ELSE price_raw END AS "priceRange" FROM rooms""",
} | {
    f"tours hotels {i}": f"""SELECT s_name AS ten, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {_TOURS_LINK.format(key='s_suppkey')} END AS link, concat(n_name, ', Việt Nam') AS dia_chi, cast(s_suppkey % 10 as double) AS diem_danh_gia, concat(cast(s_suppkey as string), ' đánh giá') AS so_luong_danh_gia,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'pool | tv' END AS tien_nghi, '1.000.000 ₫' AS gia_niem_yet, '900.000 ₫' AS gia_hien_tai, '-10%' AS discount FROM ({_HOTELS}) h WHERE s_suppkey % 2 = {i - 1}"""
    for i in (1, 2)
} | {
    f"tours rooms {i}": f"""SELECT hotel_name, {_TOURS_LINK.format(key='l_suppkey')} AS hotel_link, room_type AS room_name, people_raw AS people, area_raw AS area, bed_type AS bed, facilities AS room_amenities, price_raw AS list_price, price_raw AS final_price, cast(l_linenumber as string) AS discount_pct,
        free_cancel AS breakfast, free_cancel AS cancel_policy FROM rooms WHERE l_suppkey % 2 = {i - 1}"""
    for i in (1, 2)
}


def sites(spark: SparkSession, sf_dir: str, once: bool = False) -> dict[str, DataFrame]:
    """All files as tables. ``once``: rooms are joined once, and kept by hotel, as most files name it; their texts are made where they are read."""
    held = {t: readers.table(spark, sf_dir, t) for t in ("supplier", "nation")}
    made = rooms_of(spark, stored_by(joined(spark, sf_dir), "site-rooms", "s_name")) if once else rooms(spark, sf_dir)
    names = {"rooms": made} | held
    out = {}
    for site, text in SITES.items():
        text = text.replace('"', "`").replace("FROM rooms", "FROM {rooms}").replace("FROM supplier JOIN nation", "FROM {supplier} JOIN {nation}")
        out[site] = spark.sql(text, **{n: t for n, t in names.items() if f"{{{n}}}" in text})
    return out


def _counted(every: DataFrame) -> DataFrame:
    every = conform.snake_names(every)
    return every.groupBy(*every.columns).agg(F.count("*").alias("n"))


def _counted_by_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows name their source, so those of two sources are never equal, and each source is counted by itself where its rows lie."""
    return rows.union_all(*[_counted(t) for t in tables.values()])


def _files(*names: str) -> str:
    """SQL that has the named files as tables."""
    return "WITH " + ", ".join(f'"{n}" AS ({SITES[n]})' for n in names)


_DIGITS = "try_cast(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS bigint)"
_FIRST_RUN = "try_cast(nullif(regexp_extract(translate({}, ',.₫', ''), '([0-9]+)', 1), '') AS double)"
_WHOLE = "try_cast(trim(regexp_replace(lower({}), 'm²|m2', '', 'g')) AS double)"
_INTEGER = r"try_cast(nullif(regexp_extract({}, '(\d+)', 1), '') AS bigint)"


@query("P8 U2 F7 J3 J5", f"""
    {_files("booking", "trips", "stays hotels", "stays rooms", "advisor", "tours hotels 1", "tours hotels 2", "tours rooms 1", "tours rooms 2")},
    hotels AS (FROM "tours hotels 1" UNION ALL FROM "tours hotels 2"), beds AS (FROM "tours rooms 1" UNION ALL FROM "tours rooms 2"),
    every AS (
        SELECT 'booking' AS source, "Hotel Name" AS hotel_name, "Hotel Link" AS hotel_link, "Address" AS address, "Rating_Clean" AS rating, "Room Type" AS room_type, "Bed Type" AS bed_type, "Area_m2_cleaned" AS area_m2, "Facilities_cleaned" AS facilities, "Final Price"::double AS price FROM booking
        UNION ALL SELECT 'trips', "hotelName", "imageUrl", address, "commentScore", "roomNames", NULL, NULL, "categoryName", "minPrice" FROM trips
        UNION ALL SELECT 'stays', hotel_name, hotel_link, city, NULL, room_name, bed_type, {_WHOLE.format('area_m2')}, amenities, price FROM "stays rooms" LEFT JOIN "stays hotels" USING (hotel_id)
        UNION ALL SELECT 'advisor', hotel_name, hotel_url, address, "ratingValue", room_types, NULL, NULL, amenities, {_FIRST_RUN.format('"priceRange"')} FROM advisor
        UNION ALL SELECT 'tours', ten, hotel_link, dia_chi, diem_danh_gia, room_name, bed, {_WHOLE.format('area')}, coalesce(room_amenities, '') || ' | ' || coalesce(tien_nghi, ''), {_FIRST_RUN.format('final_price')} FROM beds LEFT JOIN hotels ON hotel_link = link)
    SELECT *, count(*) AS n FROM every WHERE hotel_name IS NOT NULL GROUP BY ALL""")
def ten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted_by_source(site_maps.ten_tables(sites(spark, sf_dir, once=True)))


@query("P9 U2 J3 J5", f"""
    {_files("booking", "trips", "stays hotels", "stays rooms", "advisor", "tours hotels 1", "tours hotels 2", "tours rooms 1", "tours rooms 2")},
    tours AS (SELECT * FROM "tours rooms 1" LEFT JOIN "tours hotels 1" ON hotel_link = link UNION ALL SELECT * FROM "tours rooms 2" LEFT JOIN "tours hotels 2" ON hotel_link = link),
    every AS (
        SELECT 'booking' AS source, NULL::varchar AS hotel_id, "Hotel Name" AS hotel_name, "Hotel Link" AS hotel_url, "Search Location" AS city, "Address" AS address, NULL::double AS latitude, NULL::double AS longitude, "Stars_Clean" AS stars, "Rating_Clean" AS rating, "Review Count" AS review_count,
            "Room Type" AS room_name, "Room_Class" AS room_class, "Bed Type" AS bed_type, {_INTEGER.format('"Area_m2_cleaned"::varchar')} AS area_m2, "Total_Guests"::int AS max_occupancy, "Original Price"::varchar AS price_original, "Final Price"::varchar AS price_final, "Discount %" AS discount_pct,
            "Free_Cancel_Bool"::int AS free_cancel, "Breakfast_Bool"::int AS breakfast, "Facilities_cleaned" AS amenities, "Check-in" AS checkin_date, NULL::varchar AS checkout_date FROM booking
        UNION ALL SELECT 'trips', "hotelId", "hotelName", "imageUrl", "cityName", address, latitude, longitude, star, "commentScore", "commenterNumber", "roomNames", NULL, NULL, NULL, NULL, "maxPrice"::varchar, "minPrice"::varchar, NULL, NULL, NULL, NULL, "checkInDates", "checkOutDates" FROM trips
        UNION ALL SELECT 'stays', hotel_id, hotel_name, hotel_link, city, NULL, NULL, NULL, NULL, NULL, NULL, room_name, NULL, bed_type, {_INTEGER.format('area_m2')}, max_occupancy, price::varchar, price::varchar, '0', NULL, NULL, amenities, NULL, NULL FROM "stays rooms" LEFT JOIN "stays hotels" USING (hotel_id)
        UNION ALL SELECT 'advisor', NULL, hotel_name, hotel_url, NULL, address, NULL, NULL, NULL, "ratingValue", "reviewCount", room_types, NULL, NULL, NULL, NULL, "priceRange", "priceRange", NULL, NULL, NULL, amenities, NULL, NULL FROM advisor
        UNION ALL SELECT 'tours', NULL, hotel_name, hotel_link, NULL, dia_chi, NULL, NULL, NULL, diem_danh_gia, so_luong_danh_gia, room_name, NULL, bed, {_INTEGER.format('area')}, {_INTEGER.format('people')}::int, {_DIGITS.format('list_price')}::varchar, {_DIGITS.format('final_price')}::varchar, discount_pct,
            contains(lower(cancel_policy), 'có')::int, contains(lower(breakfast), 'có')::int, room_amenities, NULL, NULL FROM tours)
    SELECT *, count(*) AS n FROM every GROUP BY ALL""")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted_by_source(site_maps.wide_tables(sites(spark, sf_dir, once=True)))


@query("P10 P6 U2", f"""
    {_files("trips", "stays hotels", "stays rooms", "advisor", "tours hotels 1", "tours hotels 2", "tours rooms 1", "tours rooms 2")},
    hotels AS (FROM "tours hotels 1" UNION ALL FROM "tours hotels 2"), beds AS (FROM "tours rooms 1" UNION ALL FROM "tours rooms 2"),
    every AS (
        SELECT hotel_name, hotel_link, city AS search_location, NULL::varchar AS address, NULL::double AS stars_clean, NULL::double AS rating_clean, NULL::varchar AS review_count, NULL::varchar AS room_type, NULL::varchar AS bed_type, NULL::varchar AS area_m2_cleaned, NULL::varchar AS total_guests,
            NULL::double AS adults, NULL::varchar AS facilities_cleaned, NULL::varchar AS original_price, NULL::varchar AS final_price, NULL::varchar AS discount_percent, NULL::varchar AS breakfast_bool, NULL::varchar AS free_cancel_bool FROM "stays hotels"
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, room_name, bed_type, area_m2, max_occupancy::varchar, NULL, amenities, NULL, price::varchar, NULL, NULL, NULL FROM "stays rooms"
        UNION ALL SELECT hotel_name, hotel_url, NULL, address, NULL, "ratingValue", "reviewCount", NULL, NULL, NULL, NULL, NULL, amenities, NULL, NULL, NULL, NULL, NULL FROM advisor
        UNION ALL SELECT "hotelName", NULL, "cityName", address, star, "commentScore", "commenterNumber", NULL, NULL, NULL, NULL, NULL, NULL, "maxPrice"::varchar, "minPrice"::varchar, NULL, NULL, NULL FROM trips
        UNION ALL SELECT ten, link, NULL, dia_chi, NULL, diem_danh_gia, so_luong_danh_gia, NULL, NULL, NULL, NULL, NULL, tien_nghi, gia_niem_yet, gia_hien_tai, discount, NULL, NULL FROM hotels
        UNION ALL SELECT hotel_name, hotel_link, NULL, NULL, NULL, NULL, NULL, room_name, bed, area, NULL, {_INTEGER.format('people')}, room_amenities, list_price, final_price, discount_pct, breakfast, cancel_policy FROM beds)
    SELECT *, count(*) AS n FROM every GROUP BY ALL""")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sites(spark, sf_dir)
    both = {f"tours {kind}": rows.union_all(files[f"tours {kind} 1"], files[f"tours {kind} 2"]) for kind in ("hotels", "rooms")}
    return _counted(site_maps.export_columns(files | both))


@query("P2 P5", "SELECT hotel_name, row_id AS id, final_price AS price FROM rooms")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select("row_id", F.col("hotel_name").alias("Hotel_Name"), F.col("final_price").alias("PRICE"), "location")
    found = {"hotel_name": conform.resolve(r, "hotel", "hotel_name"), "id": conform.resolve(r, "ID", "ROW_ID"), "price": conform.resolve(r, "price"), "absent": conform.resolve(r, "nowhere")}
    named = r.select(*[F.col(c).alias(n) for n, c in found.items() if c])
    return conform.select_present(named, ["hotel_name", "absent", "id", "price"])


@query("F10 A9", "SELECT event_type, avg((event_type = 'click')::int) AS is_click, avg((value > 50)::int) AS has_value FROM events GROUP BY 1", rooms=False)
def flag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("event_type") == "click").cast("int").alias("is_click"), (F.col("value") > 50).cast("int").alias("has_value"))
    return e.groupBy("event_type").agg(*[F.avg(c).alias(c) for c in conform.columns_with_prefix(e, "has_", "is_")])


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_TEXTS = "row_id string, hotel_name string, room_type string, facilities string, original_price double"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms(spark, sf_dir).select("row_id", "hotel_name", "room_type", "facilities", "original_price")


@query("S2 S8", "SELECT row_id, hotel_name, room_type, facilities, original_price FROM rooms")
def csv_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "people")
    sinks.csv_for_people(_texts(spark, sf_dir), path)
    return readers.csv(spark, path, conform.schema(_TEXTS))


@query("S3", "SELECT row_id, hotel_name, room_type, facilities, original_price FROM rooms")
def csv_with_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "semicolons")
    sinks.csv(_texts(spark, sf_dir), path, ";")
    return readers.csv(spark, path, conform.schema(_TEXTS), ";")


@query("S2 S8", "SELECT row_id, hotel_name, room_type || chr(10) || '\"x\"' AS room_type, facilities, original_price FROM rooms")
def csv_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, read back from byte ranges."""
    path = _place(spark, "ranges")
    sinks.csv_for_people(_texts(spark, sf_dir).withColumn("room_type", F.concat("room_type", F.lit('\n"x"'))), path)
    return readers.split_csv(spark, path, conform.schema(_TEXTS))


@query("S4", "SELECT 'there' AS data_source, 'whole' AS state, count(*) AS rows, 0::bigint AS broken_records FROM rooms UNION ALL SELECT 'notes', 'partly', count(*) FILTER (l_linenumber <> 2), count(*) FILTER (l_linenumber = 2) FROM rooms UNION ALL SELECT 'nowhere', 'missing', 0, 0")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole source, one with records that don't fit, and one that isn't there."""
    r = rooms(spark, sf_dir).select("row_id", "l_linenumber", "hotel_name")
    there, notes = _place(spark, "there"), _place(spark, "notes")
    sinks.overwrite(r.select("l_linenumber", "hotel_name"), there)
    sinks.csv(r.select(F.when(F.col("l_linenumber") == 2, F.lit("two")).otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"), "hotel_name"), notes)
    sources = {"there": ("parquet", there), "notes": ("csv", notes), "nowhere": ("json", _place(spark, "nowhere"))}
    _, report = readers.tolerant_sources(spark, sources, conform.schema("l_linenumber int, hotel_name string"))
    return report.select("data_source", "state", "rows", "broken_records")


@query("S4 S5", "SELECT row_id, hotel_name FROM rooms")
def sources_that_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _place(spark, "there"), conform.schema("row_id string, hotel_name string")
    r = rooms(spark, sf_dir).select("row_id", "hotel_name")
    sinks.overwrite(r.where("false"), path)
    sinks.overwrite(r, path)
    return rows.union_all(readers.tolerant(spark, path, schema), readers.tolerant(spark, _place(spark, "missing"), schema))


@query("S6", "SELECT user_id, count(*) AS n FROM events GROUP BY 1", rooms=False)
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = _place(spark, "batches"), readers.table(spark, sf_dir, "events").select("user_id", "event_type")
    for kind in ("click", "purchase"):
        sinks.append(e.where(F.col("event_type") == kind), path)
    sinks.append(e.where(~F.coalesce(F.col("event_type").isin("click", "purchase"), F.lit(False))), path)
    return spark.read.schema(e.schema).parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("S6 S7", """
    WITH last AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS spent, max_by(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY 1),
    known AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 3)
    SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(spent, c_acctbal) AS c_acctbal, coalesce(c_mktsegment, segment) AS c_mktsegment, 2::bigint AS versions FROM known FULL JOIN last ON c_custkey = o_custkey""", rooms=False)
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of all nations but one, then each customer's last order as their balance; the second batch comes twice."""
    from roomflow.sources.merge import MergeTable

    customers = readers.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    orders = readers.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    table = MergeTable(spark, _place(spark, "merged"), customers.select("c_custkey", "c_acctbal", "c_mktsegment").schema, ["c_custkey"])
    table.merge(customers.where("c_nationkey <> 3"), "customers")
    for _ in range(2):
        table.merge(orders, "orders", columns=["c_acctbal"], order="o_orderkey")
    return table.read().withColumn("versions", F.lit(len(table.versions())).cast("long"))


@query("S9 A23", "SELECT hotel_name, count(*) AS n_rooms, round(sum(original_price), 2) AS total, min(row_id) AS first_room FROM rooms GROUP BY 1")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "documents")
    hotels = rooms(spark, sf_dir).groupBy("hotel_name").agg(F.collect_list(F.struct("row_id", "original_price")).alias("rooms"))
    sinks.nested_json(hotels, path)
    back = spark.read.schema(hotels.schema).json(path)
    total = F.aggregate("rooms", F.lit(0.0), lambda a, r: a + r["original_price"])
    return back.select("hotel_name", F.size("rooms").cast("long").alias("n_rooms"), F.round(total, 2).alias("total"), F.array_min("rooms.row_id").alias("first_room"))


@query("S10", """
    WITH r AS (SELECT row_id, location, try_cast(nullif(regexp_extract(area_raw, '(\\d+)', 1), '') AS bigint) * 4 AS area FROM rooms)
    SELECT row_id, location, area, location IS NOT NULL AND location <> 'Unknown' AND coalesce(area, 0) <= 120 AS accepted FROM r""")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "quarantine")
    r = rooms(spark, sf_dir).select("row_id", "location", (parse.area_integer(F.col("area_raw")) * 4).alias("area"))
    sinks.quarantine(conform.with_reject_reason(r, "location", "area"), path)
    kept, dropped = spark.read.schema(r.schema).parquet(f"{path}/accepted=true"), spark.read.schema(r.schema).parquet(f"{path}/accepted=false")
    return rows.union_all(kept.withColumn("accepted", F.lit(True)), dropped.withColumn("accepted", F.lit(False)))


@query("S11", "SELECT n_nationkey, n_name FROM nation", rooms=False)
def kept_when_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = _place(spark, "kept"), readers.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.overwrite_unless_empty(n, path)
    sinks.overwrite_unless_empty(n.where("n_nationkey < 0"), path)
    return spark.read.parquet(path)


@query("S14", "SELECT c_custkey, c_name, c_mktsegment FROM customer", rooms=False)
def exported_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = _place(spark, "export"), readers.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sinks.csv(c, path)
    return readers.csv(spark, path, c.schema)


@query("S15", "SELECT DISTINCT trim(url) AS link FROM pages WHERE trim(coalesce(url, '')) <> ''", rooms=False)
def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "links")
    sinks.lines(readers.table(spark, sf_dir, "pages").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("link")).distinct().unionByName(spark.range(1).select(F.lit(" ").alias("link"))), "link", path)
    return readers.links(spark, path)


@query("U3 P4", "SELECT 'hotels of ' || n_name AS city, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", rooms=False)
def city_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of hotels for each nation, read and put together with its name as a tag."""
    path, nation = _place(spark, "cities"), readers.table(spark, sf_dir, "nation")
    hotels = readers.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name")
    hotels.write.partitionBy("n_name").parquet(path)
    back = spark.read.schema(hotels.schema).parquet(path)
    return conform.tag(back, "hotels of ", "city").select(F.concat("city", "n_name").alias("city"), "s_suppkey", "s_name")
