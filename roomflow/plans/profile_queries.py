"""Queries over profiles, quality, features, evaluation, pages and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.functions import classify
from roomflow.operators import evaluate, features, pages, profile, quality
from roomflow.plans import stages
from roomflow.plans.registry import query
from roomflow.plans.tables import rooms
from roomflow.sources import readers
from roomflow.sources.places import shared_folder, stored

_AREA = r"nullif(regexp_extract(replace(regexp_replace(lower(area_raw), 'm²|m2', '', 'g'), ',', '.'), '(\d+(\.\d+)?)', 1), '')::double"
_CLEAN = rf"""
    parsed AS (SELECT *, CASE WHEN try_cast(regexp_replace(price_raw, '[^0-9]', '', 'g') AS bigint) > 0 THEN try_cast(regexp_replace(price_raw, '[^0-9]', '', 'g') AS double) END AS price, {_AREA} AS area, nullif(regexp_extract(people_raw, '(\d+)', 1), '')::int AS people FROM rooms),
    clean AS (SELECT * FROM parsed WHERE price IS NOT NULL AND area IS NOT NULL AND people IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hotel_name, room_class, price, area, people ORDER BY row_id) = 1)"""


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("N7a N8b N9 C3 F4 W3 Q2 A11", f"""
    WITH {_CLEAN}, q AS (SELECT room_class, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, count(*) AS n FROM clean GROUP BY 1),
    kept AS (SELECT clean.* FROM clean JOIN q USING (room_class) WHERE n < 5 OR price BETWEEN greatest(0, q1 - 0.8 * (q3 - q1)) AND q3 + 0.8 * (q3 - q1))
    SELECT room_class, count(*) AS n, round(quantile_cont(price, 0.1), 6) AS price_p10, round(quantile_cont(price, 0.9), 6) AS price_p90, round(avg(price), 6) AS price_mean, round(quantile_cont(area, 0.1), 6) AS area_p10, round(quantile_cont(area, 0.9), 6) AS area_p90 FROM kept GROUP BY 1""")
def room_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stages.profile_rooms(rooms(spark, sf_dir)), "price_p10", "price_p90", "price_mean", "area_p10", "area_p90")


@query("A1 A2 O2", "SELECT location, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM rooms WHERE location IS NOT NULL GROUP BY 1")
def location_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.value_shares(rooms(spark, sf_dir), "location"), "share", digits=9)


@query("A4 A5", """
    WITH v AS (SELECT DISTINCT 'room_class' AS "column", room_class AS value FROM rooms UNION ALL SELECT DISTINCT 'bed_type', bed_type FROM rooms UNION ALL SELECT DISTINCT 'l_linenumber', l_linenumber::varchar FROM rooms)
    SELECT "column", count(*) AS n_values, string_agg(value, ' | ' ORDER BY value) AS values FROM v WHERE value IS NOT NULL GROUP BY 1""")
def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_values(rooms(spark, sf_dir), ["room_class", "bed_type", "l_linenumber"])


@query("A6 A7 A8", "SELECT room_class, round(quantile_cont(final_price, 0.1), 6) AS p10, round(quantile_cont(final_price, 0.5), 6) AS median, round(quantile_cont(final_price, 0.9), 6) AS p90 FROM rooms GROUP BY 1 UNION ALL SELECT 'all', round(quantile_cont(final_price, 0.1), 6), round(quantile_cont(final_price, 0.5), 6), round(quantile_cont(final_price, 0.9), 6) FROM rooms")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir)
    each = profile.quantiles(r, "final_price", [0.1, 0.5, 0.9], ["room_class"]).select("room_class", "quantiles").unionByName(profile.quantiles(r, "final_price", [0.1, 0.5, 0.9]).withColumn("room_class", F.lit("all")))
    return each.select("room_class", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("p10", "median", "p90"))])


@query("A7", """
    WITH s(share) AS (VALUES (0.1), (0.5), (0.9)), c AS (SELECT event_type, count(value) AS n FROM events GROUP BY 1)
    SELECT event_type, n, share::double AS share, true AS within FROM c, s""", rooms=False)
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches that were kept for each day, and whether their true rank is within twice the sketches' error."""
    e = readers.table(spark, sf_dir, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    kept = stored(profile.sketches(e, "value", ["event_type", "day"]), "sketches")
    shares = [0.1, 0.5, 0.9]
    told = profile.sketch_quantiles(kept, shares, ["event_type"]).select("event_type", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("quantiles").alias("value"))).alias("x")).select("event_type", "n", "x.share", F.col("x.value").alias("told"))
    ranks = e.join(told, "event_type").groupBy("event_type", "n", "share", "told").agg((F.count_if(F.col("value") < F.col("told")) / F.col("n")).alias("below"), (F.count_if(F.col("value") <= F.col("told")) / F.col("n")).alias("upto"))
    error = 2 * profile.SKETCH_ERROR
    return ranks.select("event_type", "n", "share", ((F.col("below") <= F.col("share") + error) & (F.col("upto") >= F.col("share") - error)).alias("within"))


def _flag(pattern: str, *columns: str) -> str:
    return "CASE WHEN " + " OR ".join(f"coalesce(regexp_matches(lower(trim({c})), '{pattern}'), false)" for c in columns) + " THEN 1 ELSE 0 END"


_FLAGS = ", ".join([f"{_flag(p, 'room_type', 'bed_type', 'facilities')} AS {n}" for n, p in classify.BED_FLAGS.items()] + [f"{_flag(p, 'facilities')} AS {n}" for n, p in classify.FACILITY_FLAGS.items()])
_NAMES = [*classify.BED_FLAGS, *classify.FACILITY_FLAGS]
_FEATURES = f"""{_CLEAN}, feats AS (SELECT row_id, price, people, area, coalesce(price / nullif(area, 0), 0) AS price_per_m2, coalesce(area / nullif(people, 0), 0) AS m2_per_person,
    CASE WHEN facilities IS NULL THEN 0 ELSE len(string_split(lower(facilities), ',')) END AS num_facilities, {_flag(classify.LUXURY_WORDS, 'room_type')} AS has_luxury_keyword, room_class, {_FLAGS} FROM clean)"""


@query("A9 A10 E14", f"""
    WITH {_FEATURES}, m AS (SELECT room_class, {', '.join(f'avg({n}) AS {n}' for n in _NAMES)} FROM feats GROUP BY 1), u AS (UNPIVOT m ON {', '.join(_NAMES)} INTO NAME flag VALUE share)
    SELECT room_class, flag, round(share, 9) AS share, share >= 0.15 AS common FROM u""")
def class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.feature_table(stages.clean_rooms(rooms(spark, sf_dir), *stages.FEATURES), "room_type", "bed_type", "facilities", "price", "area", "people", "room_class")
    means = stored(profile.group_means(table, "room_class", _NAMES), "means")  # one row per class, read twice
    long = features.melt(means, ["room_class"], _NAMES, "flag", "share")
    common = profile.flags_of_means(means, "room_class", {n: n for n in _NAMES}, 0.15)
    both = long.join(common, "room_class", "left")
    return both.select("room_class", "flag", F.round("share", 9).alias("share"), F.coalesce(F.array_contains(F.split("common", ", "), F.col("flag")), F.lit(False)).alias("common"))


@query("E1 E2 E3 E4 E5", f"WITH {_FEATURES} SELECT row_id, price, people, area, round(price_per_m2, 9) AS price_per_m2, round(m2_per_person, 9) AS m2_per_person, num_facilities, has_luxury_keyword, room_class, {', '.join(_NAMES)} FROM feats")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.feature_table(stages.clean_rooms(rooms(spark, sf_dir), *stages.FEATURES), "room_type", "bed_type", "facilities", "price", "area", "people", "room_class")
    return _rounded(table, "price_per_m2", "m2_per_person", digits=9)


@query("A22 E8 E9 E10 E13", f"""
    WITH {_FEATURES}, r AS (SELECT min(price) AS a, max(price) AS b, min(area) AS c, max(area) AS d FROM feats), l AS (SELECT room_class, row_number() OVER (ORDER BY room_class) - 1 AS i FROM (SELECT DISTINCT room_class FROM feats))
    SELECT row_id, round(coalesce((price - a) / nullif(b - a, 0), 0), 9) AS price, round(coalesce((area - c) / nullif(d - c, 0), 0), 9) AS area, i AS room_class_index, room_class, CASE WHEN room_class = 'PROMO' THEN -1 ELSE i END AS seen_index FROM feats JOIN l USING (room_class), r""")
def scaled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = stored(stages.clean_rooms(rooms(spark, sf_dir), "row_id").select("row_id", "price", "area", "room_class"), "clean")
    scaled = features.scale(clean, features.fit_ranges(clean, ["price", "area"]), ["price", "area"])
    labels = stored(features.fit_labels(clean, "room_class"), "labels")
    seen = features.encode(scaled, labels.where("room_class <> 'PROMO'"), "room_class", -1).withColumnRenamed("room_class_index", "seen_index")
    coded = features.decode(features.encode(seen, labels, "room_class").drop("room_class"), labels, "room_class", "room_class_index")
    return _rounded(coded, "price", "area", digits=9).select("row_id", "price", "area", "room_class_index", "room_class", "seen_index")


@query("A19 F9", """
    SELECT 'final_price' AS a, 'l_linenumber' AS b, round(corr(final_price, l_linenumber), 8) AS r FROM rooms UNION ALL SELECT 'final_price', 'original_price', round(corr(final_price, original_price), 8) FROM rooms UNION ALL SELECT 'l_linenumber', 'original_price', round(corr(l_linenumber, original_price), 8) FROM rooms""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.operators.conform import numeric_columns

    r = rooms(spark, sf_dir).select("room_class", "final_price", "l_linenumber", "original_price")
    return _rounded(profile.correlations(r, numeric_columns(r)), "r", digits=8)


def _box(group: str) -> str:
    by, comma = (f"GROUP BY {group}", f"{group}, ") if group else ("", "")
    join = f"USING ({group})" if group else "ON true"
    return f"""q AS (SELECT {comma}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events {by})
    SELECT {comma}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS high,
    count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q {join} GROUP BY {comma}q1, median, q3"""


@query("A20", f"WITH {_box('event_type')}", rooms=False)
def boxes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.box_summary(readers.table(spark, sf_dir, "events"), "value", ["event_type"]), "q1", "median", "q3", "low", "high")


@query("A20", f"WITH {_box('')}", rooms=False)
def box_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.box_summary(readers.table(spark, sf_dir, "events"), "value"), "q1", "median", "q3", "low", "high")


@query("A21", """
    WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::int AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT g.bin::int AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) g LEFT JOIN c ON g.bin = c.bin""", rooms=False)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(readers.table(spark, sf_dir, "events"), "value", 30)


@query("A22 A29", "SELECT count(*) AS rows, count(location) AS located, count(bed_type) AS beds, round(min(final_price), 6) AS low, round(max(final_price), 6) AS high, round(avg(l_linenumber), 6) AS mean FROM rooms")
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir)
    one = profile.shape(r.select("location", "bed_type"))
    counts = one.groupBy().agg(F.max("rows").alias("rows"), F.max(F.when(F.col("column") == "location", F.col("present"))).alias("located"), F.max(F.when(F.col("column") == "bed_type", F.col("present"))).alias("beds"))
    ends = profile.ranges(r, ["final_price"]).select(F.round("final_price_min", 6).alias("low"), F.round("final_price_max", 6).alias("high"))
    return counts.join(F.broadcast(ends)).join(F.broadcast(r.agg(F.round(F.avg("l_linenumber"), 6).alias("mean"))))


@query("A23 J1", f"""
    WITH {_CLEAN}, g AS (SELECT hotel_name, location, people, row_id, room_class, coalesce(facilities, badge) AS amenities, price::bigint AS price, row_number() OVER (PARTITION BY hotel_name, location ORDER BY row_id) AS nth FROM clean WHERE location IS NOT NULL)
    SELECT hotel_name, location, max(people) FILTER (nth = 1) AS rating, count(*) AS n_rooms, string_agg(row_id, ',' ORDER BY row_id) AS room_ids, sum(price)::bigint AS total, string_agg(amenities, ';' ORDER BY row_id) AS amenities FROM g GROUP BY 1, 2""")
def hotel_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stages.nested_hotels(stages.clean_rooms(rooms(spark, sf_dir), "location", "room_type", "facilities", "badge"))
    amenities = F.nullif(F.array_join(F.transform("rooms", lambda r: r["amenities"]), ";"), F.lit(""))
    some = F.size(F.filter("rooms", lambda r: r["amenities"].isNotNull())) > 0
    return d.select("hotel_name", "location", "rating", F.size("rooms").cast("long").alias("n_rooms"), F.array_join("rooms.room_id", ",").alias("room_ids"), F.aggregate("rooms", F.lit(0).cast("long"), lambda a, r: a + r["price"]).alias("total"), F.when(some, F.coalesce(amenities, F.lit(""))).alias("amenities"))


@query("A25", """
    WITH v AS (SELECT user_id, event_type, try_cast(value AS decimal(38, 6)) AS value FROM events),
    m AS (SELECT user_id, (sum(value) FILTER (event_type = 'purchase'))::double / nullif(count(value) FILTER (event_type = 'purchase'), 0) AS ota, (sum(value) FILTER (event_type = 'click'))::double / nullif(count(value) FILTER (event_type = 'click'), 0) AS ta FROM v GROUP BY 1)
    SELECT user_id, floor(coalesce(ota, ta))::bigint AS rate FROM m WHERE coalesce(ota, ta) IS NOT NULL""", rooms=False)
def user_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", F.lit("ota")).when(F.col("event_type") == "click", F.lit("ta"))
    return profile.best_rate(readers.table(spark, sf_dir, "events").withColumn("kind", kind), ["user_id"], "kind", "value")


@query("A26", "WITH c AS (SELECT hotel_name, count(*) AS n FROM rooms GROUP BY 1) SELECT trunc(quantile_cont(n, 0.7))::int AS target FROM c")
def balance_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.target_size(rooms(spark, sf_dir), "hotel_name", 0.7)


def _bounds_sql(method: str) -> str:
    if method == "percentile":
        return "greatest(0, quantile_cont(value, 0.05)) AS low, quantile_cont(value, 0.95) AS high"
    return "greatest(0, quantile_cont(value, 0.25) - 0.8 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))) AS low, quantile_cont(value, 0.75) + 0.8 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS high"


@query("Q1 Q5", f"WITH b AS (SELECT {_bounds_sql('iqr')} FROM events) SELECT event_id, NOT value BETWEEN low AND high AS outlier FROM events, b", rooms=False)
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_outliers(readers.table(spark, sf_dir, "events"), "value").select("event_id", "outlier")


@query("Q3", f"WITH b AS (SELECT event_type, {_bounds_sql('percentile')} FROM events GROUP BY 1) SELECT event_id, value FROM events JOIN b USING (event_type) WHERE value BETWEEN low AND high", rooms=False)
def trimmed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_outliers(readers.table(spark, sf_dir, "events"), "value", "event_type", "percentile").select("event_id", "value")


@query("N24", "WITH p AS (SELECT row_id, try_cast(regexp_replace(price_raw, '[^0-9]', '', 'g') AS double) AS price FROM rooms) SELECT row_id, coalesce(price, (SELECT median(price) FROM p)) AS price FROM p")
def filled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.functions.parse import price_digits_or_zero

    r = rooms(spark, sf_dir).select("row_id", price_digits_or_zero(F.col("price_raw")).cast("double").alias("price"))
    return quality.fill_median(r, ["price"])


@query("Q6 Q7", """
    WITH h AS (SELECT hotel_name, row_id, original_price AS price, room_class FROM rooms), c AS (SELECT hotel_name, count(*) AS n FROM h GROUP BY 1), t AS (SELECT trunc(quantile_cont(n, 0.7))::int AS target FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY hotel_name ORDER BY md5('42|' || row_id)) AS nth, row_number() OVER (PARTITION BY hotel_name ORDER BY md5('43|' || row_id)) AS at1, row_number() OVER (PARTITION BY hotel_name ORDER BY md5('44|' || row_id)) AS at2 FROM h),
    d AS (SELECT hotel_name, n, unnest(range(1, greatest(target - n, 0)::bigint + 1)) AS draw FROM c, t),
    x AS (SELECT hotel_name, draw, ('0x' || substr(md5('43|' || hotel_name || '|' || draw), 1, 12))::bigint % n + 1 AS at1, ('0x' || substr(md5('44|' || hotel_name || '|' || draw), 1, 12))::bigint % n + 1 AS at2 FROM d)
    SELECT hotel_name, row_id, price, room_class, 'Real' AS row_origin FROM k, t WHERE nth <= target
    UNION ALL SELECT x.hotel_name, a.row_id || '-g' || draw, b.price, a.room_class, 'AI_Generated' FROM x JOIN k a ON x.hotel_name = a.hotel_name AND x.at1 = a.at1 JOIN k b ON x.hotel_name = b.hotel_name AND x.at2 = b.at2""")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select("hotel_name", "row_id", F.col("original_price").alias("price"), "room_class")
    return quality.balance(r, "hotel_name", "row_id", ["price"])


_PRED = "SELECT row_id, room_class, CASE WHEN substr(md5('m1' || row_id), 1, 1) < '4' THEN 'SMALL' ELSE room_class END AS predicted FROM rooms"
_PRED2 = "SELECT row_id, room_class, CASE WHEN substr(md5('m2' || row_id), 1, 1) < '6' THEN 'PROMO' ELSE room_class END AS predicted FROM rooms"


def _predictions(spark: SparkSession, sf_dir: str, seed: str = "m1", cut: str = "4", other: str = "SMALL") -> DataFrame:
    wrong = F.substring(F.md5(F.concat(F.lit(seed), F.col("row_id"))), 1, 1) < cut
    return rooms(spark, sf_dir).select("row_id", "room_class").withColumn("predicted", F.when(wrong, F.lit(other)).otherwise(F.col("room_class")))


def _ovr(table: str) -> str:
    return f"""(SELECT c.class, count(*) FILTER (room_class = class AND predicted = class) AS tp, count(*) FILTER (room_class <> class AND predicted = class) AS fp, count(*) FILTER (room_class <> class AND predicted <> class) AS tn, count(*) FILTER (room_class = class AND predicted <> class) AS fn
     FROM {table}, (SELECT DISTINCT room_class AS class FROM {table} UNION SELECT DISTINCT predicted FROM {table}) c GROUP BY 1)"""


@query("A12 A13 O7", f"WITH p AS ({_PRED}) SELECT room_class, round(avg(CASE WHEN room_class = predicted THEN 1 ELSE 0 END) * 100, 6) AS accuracy FROM p GROUP BY 1 UNION ALL SELECT 'all', round(avg(CASE WHEN room_class = predicted THEN 1 ELSE 0 END) * 100, 6) FROM p")
def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    total = evaluate.accuracy(p, "room_class", "predicted").select(F.lit("all").alias("room_class"), (F.col("accuracy") * 100).alias("accuracy"))
    return _rounded(evaluate.accuracy_by_class(p, "room_class", "predicted").unionByName(total), "accuracy")


@query("A14", f"""WITH p AS ({_PRED}) SELECT room_class, {', '.join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))} FROM p GROUP BY 1""")
def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_predictions(spark, sf_dir), "room_class", "predicted", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("A15 A16", f"WITH p AS ({_PRED}) SELECT class, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM {_ovr('p')}")
def one_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.one_vs_rest(_predictions(spark, sf_dir), "room_class", "predicted"), "precision", "recall", digits=9)


@query("A17", f"""
    WITH p AS ({_PRED}), m AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tp + fn AS support FROM {_ovr('p')}), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m),
    a AS (SELECT avg(CASE WHEN room_class = predicted THEN 1 ELSE 0 END) AS x FROM p),
    u AS (SELECT class, precision, recall, f1, support FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::bigint FROM f UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint FROM f UNION ALL SELECT 'accuracy', x, x, x, NULL FROM a)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.report(_predictions(spark, sf_dir), "room_class", "predicted"), "precision", "recall", "f1")


@query("A18 J9", f"""
    WITH p AS ({_PRED}), r AS ({_PRED2}), a AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM {_ovr('p')}), b AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM {_ovr('r')})
    SELECT coalesce(a.class, b.class) AS class, round(a.precision, 6) AS precision_a, round(a.recall, 6) AS recall_a, round(b.precision, 6) AS precision_b, round(b.recall, 6) AS recall_b, CASE WHEN a.recall > b.recall THEN 'a' WHEN a.recall < b.recall THEN 'b' ELSE 'tie' END AS winner, round(abs(a.recall - b.recall), 6) AS gain FROM a FULL JOIN b ON a.class = b.class""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.compare(_predictions(spark, sf_dir), _predictions(spark, sf_dir, "m2", "6", "PROMO"), "room_class", "predicted"), "precision_a", "recall_a", "precision_b", "recall_b", "gain")


@query("A28", "WITH p AS (SELECT original_price AS y, final_price AS p FROM rooms) SELECT round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(y) FROM p)) * (y - (SELECT avg(y) FROM p))), 6) AS r2 FROM p")
def regression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rooms(spark, sf_dir).select(F.log1p("original_price").alias("y"), F.log1p("final_price").alias("p"))
    return evaluate.regression_metrics(r, "y", "p").select(F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("Q8 Q9", f"WITH p AS ({_PRED}) SELECT row_id, predicted FROM p WHERE room_class <> predicted AND ('0x' || substr(md5('c' || row_id), 1, 4))::bigint / 65536 >= 0.9")
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.conv(F.substring(F.md5(F.concat(F.lit("c"), F.col("row_id"))), 1, 4), 16, 10).cast("long") / 65536
    return quality.suspect_labels(_predictions(spark, sf_dir).withColumn("confidence", confidence), "room_class", "predicted", "confidence").select("row_id", "predicted")


@query("A3", """
    WITH r AS (SELECT room_class, location, try_cast(nullif(regexp_extract(area_raw, '(\\d+)', 1), '') AS bigint) * 4 AS area FROM rooms)
    SELECT room_class, count(*) AS rejected FROM r WHERE location IS NULL OR location = 'Unknown' OR area > 120 GROUP BY 1""")
def rejected_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.functions.parse import area_integer
    from roomflow.operators.conform import with_reject_reason

    r = with_reject_reason(rooms(spark, sf_dir).select("room_class", "location", (area_integer(F.col("area_raw")) * 4).alias("area")), "location", "area")
    return r.where("reject_reason IS NOT NULL").groupBy("room_class").agg(F.count("*").alias("rejected")).orderBy("room_class")


@query("A24", f"SELECT count({_AREA}) AS present, round(avg({_AREA}), 6) AS mean FROM rooms")
def cleaned_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.functions.parse import area_comma

    return rooms(spark, sf_dir).select(area_comma(F.col("area_raw")).alias("area")).agg(F.count("area").alias("present"), F.round(F.avg("area"), 6).alias("mean"))


def _cut(source: str, group: str, low: float, high: float, factor: float | None = None) -> str:
    """Rows of ``source`` inside the bounds of a group's percentiles, or of quartiles and a factor."""
    ends = f"greatest(0, quantile_cont(value, {low})) AS lo, quantile_cont(value, {high}) AS hi" if factor is None else f"greatest(0, quantile_cont(value, 0.25) - {factor} * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))) AS lo, quantile_cont(value, 0.75) + {factor} * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi"
    return f"SELECT e.* FROM {source} e JOIN (SELECT {group}, {ends} FROM {source} GROUP BY 1) b USING ({group}) WHERE value BETWEEN lo AND hi"


@query("Q4", f"WITH a AS ({_cut('events', 'event_type', 0.15, 0.85)}), b AS ({_cut('a', 'event_type', 0, 0, 1.5)}), c AS ({_cut('b', 'event_type', 0.01, 0.99)}) SELECT event_id, value FROM c", rooms=False)
def older_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e = quality.drop_outliers(e, "value", "event_type", "percentile", shares=(0.15, 0.85))
    e = quality.drop_outliers(e, "value", "event_type", "iqr", factor=1.5)
    return quality.drop_outliers(e, "value", "event_type", "percentile", shares=(0.01, 0.99)).select("event_id", "value")


@query("E6 E7 N16", "SELECT row_id, len(facilities) - len(replace(facilities, ',', '')) + 1 AS n_facilities, l_linenumber * (l_linenumber % 5) AS area_stars, (l_linenumber / 2.0)::double * l_linenumber AS score_area, CASE WHEN original_price > 0 AND original_price < final_price THEN final_price ELSE original_price END AS original, CASE WHEN original_price > 0 AND original_price < final_price THEN original_price ELSE final_price END AS final FROM rooms")
def older_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.functions.parse import swap_prices

    area, rated = F.col("l_linenumber"), F.col("l_linenumber") / 2
    area_stars, score_area = features.interactions(area, area % 5, rated)
    original, final = swap_prices(F.col("original_price"), F.col("final_price"))
    return rooms(spark, sf_dir).select("row_id", features.count_commas(F.col("facilities")).alias("n_facilities"), area_stars.alias("area_stars"), score_area.alias("score_area"), original.alias("original"), final.alias("final"))


_MODEL = ["price", "people", "area", "price_per_m2", "m2_per_person", "num_facilities"]


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.operators.models import label_rank

    table = features.feature_table(stages.clean_rooms(rooms(spark, sf_dir), *stages.FEATURES), "room_type", "bed_type", "facilities", "price", "area", "people", "room_class")
    made = stored(table.withColumn("people", F.col("people").cast("double")), "features")  # read for labels, counts, cuts and rows
    return quality.stratified_split(label_rank(made, "room_class"), "room_class", "row_id")


#: The sizes that are tried for forests, and the fixed one.
TREES, FIXED_TREES, DEPTH = (50, 100, 200), 100, 10


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = stored(_training(spark, sf_dir), "training")
    return t.where("split = 'train'"), t.where("split = 'validation'"), t.where("split = 'test'")


@query("L1 L6 O6")
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomflow.operators import models

    train, validation, test = _parts(spark, sf_dir)
    chosen = [*_MODEL, *_NAMES]
    model, _, _ = models.random_forest(train, validation, chosen, "label", trees=TREES, depth=DEPTH)
    return models.score(model, test, chosen, "label").select("row_id", "room_class", "prediction", F.round("confidence", 6).alias("confidence"), "correct")


@query("L2 L4 O4")
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features that count most in the forest of fixed size."""
    from roomflow.operators import models

    train, validation, _ = _parts(spark, sf_dir)
    chosen = [*_MODEL, *_NAMES]
    model, _, _ = models.random_forest(train, validation, chosen, "label", trees=(FIXED_TREES,), depth=DEPTH)
    return models.importance(model, chosen, spark)


#: Rounds and depth of the boosted classes.
ROUNDS, BOOST_DEPTH = 200, 6
_ALL_FEATURES = [*_MODEL, "has_luxury_keyword", *_NAMES]


@query("L3 L4 Q8")
def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted classes scored on all rows, with the labels that a confident model contradicts (unseen in fold 0) and those that
    confident learning suspects out of fold."""
    from roomflow.operators import audit

    t = stored(_training(spark, sf_dir), "training")
    found, _ = audit.audit_labels(t, _ALL_FEATURES, "label", "row_id", 6, ROUNDS, depth=BOOST_DEPTH)
    confidence = F.array_max("first")
    prediction = (F.array_position("first", confidence) - 1).cast("double")
    wrong = prediction != F.col("y")
    return found.select(F.col("key").alias("row_id"), F.col("fold"), prediction.alias("prediction"), F.round(confidence, 6).alias("confidence"), (~wrong).cast("int").alias("correct"), (wrong & (confidence >= 0.9)).alias("misaligned"), "suggested", "suspect")


#: Tried settings of each kind of boosted trees, and rounds after each rung of halving; rounds of the stacked learners.
TRIALS, RUNGS, STACK_ROUNDS = 6, (8, 16, 32), 100
_PRICE = ["area", "people", "stars", "rating", "review_count", "distance_km", "facility_count", "room_score", "area_stars", "score_area", "has_luxury_keyword", *_NAMES, "class_index", "place_index", "bed_index"]


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log prices with numbers, ratios, flags and categories by their rank (-1 for none); missing numbers stay missing."""
    from roomflow.functions import parse

    t = stages.clean_rooms(rooms(spark, sf_dir), *stages.FEATURES, "location", "room_text", "score_raw", "distance_raw", "review_text", "l_linenumber", "level", "bed_class")
    area_stars, score_area = features.interactions(F.col("area"), F.col("stars"), F.col("room_score"))
    t = t.withColumns({"stars": (F.col("l_linenumber") % 5).cast("double"), "rating": parse.score(F.col("score_raw")), "review_count": parse.review_count(F.col("review_text")), "distance_km": parse.distance_km(F.col("distance_raw")), "facility_count": features.count_facilities(F.col("facilities")), "room_score": classify.room_score(F.col("level"))})
    t = t.withColumns({"area_stars": area_stars, "score_area": score_area, "has_luxury_keyword": features.luxury_flag(F.lower("room_type"))})
    t = features.facility_flags(features.bed_flags(t, "room_type", "bed_type", "facilities"), "facilities")
    t = stored(t, "priced")
    for column, name in (("room_class", "class_index"), ("location", "place_index"), ("bed_class", "bed_index")):
        t = features.encode(t, features.fit_labels(t, column), column, unknown=-1).withColumnRenamed(f"{column}_index", name)
    return stored(t.select("row_id", "price", parse.log_price(F.col("price")).alias("log_price"), *_PRICE), "price-features")


@query("L7")
def tuned_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings that were tried, with the error that each had when it stopped, and the best of each kind."""
    from roomflow.operators import prices

    best, every = prices.successive_halving(_priced(spark, sf_dir), _PRICE, "log_price", "row_id", prices.random_trials(TRIALS), RUNGS)
    table = [(t.kind, t.number, t.spec.depth, t.spec.rate, t.spec.rows, t.spec.columns, t.rounds, round(t.error, 6), best[t.kind] == t) for t in every]
    return spark.createDataFrame(table, "kind string, number int, depth int, rate double, rows double, columns double, rounds int, error double, best boolean")


@query("L8 L9")
def stacked_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by the stacked best settings; a row's prediction is by models that have not seen it."""
    from roomflow.operators import prices

    t = _priced(spark, sf_dir)
    best, _ = prices.successive_halving(t, _PRICE, "log_price", "row_id", prices.random_trials(TRIALS), RUNGS)
    _, unseen = prices.stack(t, _PRICE, "log_price", "row_id", [b.spec for b in best.values()], STACK_ROUNDS)
    found = t.select("row_id", "price").join(unseen.select(F.col("key").alias("row_id"), "prediction"), "row_id")
    return evaluate.price_gap(found, "price", "prediction").select("row_id", F.round("gap", 2).alias("gap"))


@query("L9", "SELECT row_id, round(abs(final_price - original_price), 4) AS gap FROM rooms")
def price_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list price as a prediction of the final one."""
    r = rooms(spark, sf_dir).select("row_id", "final_price", F.log1p("original_price").alias("prediction"))
    return evaluate.price_gap(r, "final_price", "prediction").select("row_id", F.round("gap", 4).alias("gap"))


@query("L5")
def stored_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of fixed size, saved, loaded and applied."""
    import uuid

    from pyspark.ml.classification import RandomForestClassificationModel

    from roomflow.operators import models

    train, validation, test = _parts(spark, sf_dir)
    model, _, _ = models.random_forest(train, validation, _ALL_FEATURES, "label", trees=(FIXED_TREES,), depth=DEPTH)
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    models.save(model, path)
    return models.score(RandomForestClassificationModel.load(path), test, _ALL_FEATURES, "label").select("row_id", "prediction", F.round("confidence", 6).alias("confidence"))


@query("E11 E12", f"""
    WITH {_CLEAN}, p AS (SELECT row_id, room_class, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE price END AS price FROM clean), f AS (SELECT row_id, room_class, coalesce(price, (SELECT quantile_disc(price, 0.5) FROM p)) AS price FROM p), m AS (SELECT avg(price) AS mean, stddev_samp(price) AS sd FROM f)
    SELECT row_id, round((price - mean) / sd, 2) AS x, {', '.join(f"CASE WHEN room_class = '{c}' THEN 1.0 ELSE 0.0 END AS h{i}" for i, c in enumerate(('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')))} FROM f, m""")
def prepared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from roomflow.operators import models

    t = stages.clean_rooms(rooms(spark, sf_dir), "l_linenumber").select("row_id", "room_class", F.when(F.col("l_linenumber") % 5 != 0, F.col("price")).alias("price"))
    t = quality.fill_median(stored(t, "prepared"), ["price"], discrete=True)  # read by each fit
    out = models.preparation(["price"], ["room_class"], median_error=None).fit(t).transform(t).withColumn("v", vector_to_array("features"))
    return out.select("row_id", F.round(F.col("v")[0], 2).alias("x"), *[F.col("v")[i + 1].alias(f"h{i}") for i in range(6)])
