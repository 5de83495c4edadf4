"""Room rows over the benchmark tables. One SQL text makes them, on Spark and on any other engine that holds the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Messy text beside exact columns, made from line items, parts, suppliers and nations.
ROOMS_SQL = """
SELECT md5(concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))) AS row_id,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name AS hotel_name,
 concat('https://stay.example/', cast(s_suppkey as string), CASE WHEN l_orderkey % 2 = 0 THEN '#rooms' ELSE '' END) AS hotel_link,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 11 = 1 THEN 'Unknown' ELSE n_name END AS location,
 p_type AS room_class, concat(p_name, ' ', p_type) AS room_type,
 CASE l_partkey % 9 WHEN 0 THEN 'Deluxe Suite' WHEN 1 THEN 'Phòng Superior' WHEN 2 THEN 'Căn hộ studio' WHEN 3 THEN 'Grandview Room' WHEN 4 THEN 'Family room 2 bedroom apartment' WHEN 5 THEN 'xyz' WHEN 6 THEN '' WHEN 7 THEN 'Biệt thự VIP' ELSE NULL END AS room_text,
 CASE l_suppkey % 8 WHEN 0 THEN '1 King bed' WHEN 1 THEN '2 giường đơn' WHEN 2 THEN 'Double đôi' WHEN 3 THEN 'King and sofa' WHEN 4 THEN 'Phòng dorm tập thể' WHEN 5 THEN 'twin' WHEN 6 THEN 'n/a' ELSE NULL END AS bed_type,
 CASE l_suppkey % 6 WHEN 0 THEN 'Double & King' WHEN 1 THEN 'Large' WHEN 2 THEN 'Twin' WHEN 3 THEN 'Standard' WHEN 4 THEN 'Sofa' ELSE NULL END AS bed_tags,
 CASE l_orderkey % 8 WHEN 0 THEN '12 Lê Lợi, Quận 1' WHEN 1 THEN 'Đường A, quận bình thạnh, TP' WHEN 2 THEN 'vung tau beach' WHEN 3 THEN 'phường 12, tp. đà lạt' WHEN 4 THEN 'somewhere' WHEN 5 THEN 'binh duong' WHEN 6 THEN '' ELSE NULL END AS address,
 CASE l_orderkey % 3 WHEN 0 THEN 'ho chi minh' WHEN 1 THEN 'nan' ELSE NULL END AS search_location,
 l_extendedprice AS original_price, l_extendedprice * (1 - l_discount) AS final_price,
 CASE l_linenumber % 4 WHEN 0 THEN cast(cast(floor(l_extendedprice) as bigint) as string)
  WHEN 1 THEN concat(cast(cast(floor(l_extendedprice / 1000) as bigint) as string), '.', lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as string), 3, '0'), ' VND')
  WHEN 2 THEN concat(cast(cast(floor(l_extendedprice / 1000) as bigint) as string), ',', lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as string), 3, '0'), ' ₫')
  ELSE CASE WHEN l_partkey % 2 = 0 THEN 'N/A' END END AS price_raw,
 CASE l_partkey % 5 WHEN 0 THEN concat(cast(p_size as string), ' m²') WHEN 1 THEN concat(cast(p_size as string), 'm2') WHEN 2 THEN concat(cast(p_size as string), ',5 m2') WHEN 3 THEN concat('khoảng ', cast(p_size as string), ' m²') ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'N/A' END END AS area_raw,
 CASE WHEN l_linenumber % 6 = 5 THEN NULL ELSE concat(cast(cast(l_quantity as int) % 6 + 1 as string), ' người') END AS people_raw,
 CASE l_partkey % 6 WHEN 0 THEN 'Wifi, Air conditioning , ,pool' WHEN 1 THEN 'terrace; tv' WHEN 2 THEN 'N/A' WHEN 3 THEN 'parking,Wifi' WHEN 4 THEN 'bếp, tủ lạnh, view' ELSE NULL END AS facilities,
 CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'không có' ELSE NULL END AS free_cancel,
 CASE l_orderkey % 6 WHEN 0 THEN '8,9' WHEN 1 THEN '7.5' WHEN 2 THEN 'nan' WHEN 3 THEN 'N/A' WHEN 4 THEN 'abc' ELSE NULL END AS score_raw,
 CASE l_orderkey % 5 WHEN 0 THEN '1,2 km' WHEN 1 THEN '350 m' WHEN 2 THEN '7' WHEN 3 THEN 'N/A' ELSE NULL END AS distance_raw,
 CASE l_linenumber % 4 WHEN 0 THEN 'None' WHEN 1 THEN '' WHEN 2 THEN 'Early deal' ELSE NULL END AS badge,
 CASE l_linenumber % 3 WHEN 0 THEN '1.234 đánh giá' WHEN 1 THEN '56 reviews' ELSE 'new' END AS review_text,
 CASE l_linenumber % 3 WHEN 0 THEN '2025-03-0x' WHEN 1 THEN concat('2025-03-1', cast(l_linenumber % 10 as string)) ELSE NULL END AS check_in
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""
TABLES = ("lineitem", "part", "supplier", "nation")


#: What the room rows are made from; joins come before the texts, which are wider than this.
JOINED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "p_type", "p_name", "p_size", "s_suppkey", "s_name", "n_name"]
_FROM = ROOMS_SQL[ROOMS_SQL.index("FROM lineitem") :].strip()


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, supplier and nation. Joins are left to Spark, which broadcasts the small sides by their size."""
    tables = _FROM
    for t in TABLES:
        tables = tables.replace(f"{t} ", f"{{{t}}} ", 1)
    return spark.sql(f"SELECT {', '.join(JOINED)} {tables}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def rooms_of(spark: SparkSession, joined: DataFrame) -> DataFrame:
    """Room rows of joined line items, which may have been stored."""
    return spark.sql(ROOMS_SQL.replace(_FROM, "FROM {joined}"), joined=joined)


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins are left to Spark, which broadcasts the small sides by their size."""
    return spark.sql(ROOMS_SQL.replace("FROM lineitem JOIN part ", "FROM {lineitem} JOIN {part} ").replace("JOIN supplier ", "JOIN {supplier} ").replace("JOIN nation ", "JOIN {nation} "), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
