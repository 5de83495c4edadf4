"""Rules on small literal tables, golden numbers, sources, sinks and invariants."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomflow.functions import classify, parse
from roomflow.operators import conform, evaluate, features, pages, profile, quality, rows
from roomflow.sources import readers, sinks


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "values", "want"),
    [
        (parse.price_digits, ["500.000 VND", "1,234,567 ₫", "1.000 - 2.000", "0", "N/A", "", None], [500000, 1234567, 10002000, None, None, None, None]),
        (parse.price_digits_or_zero, ["500000.0", "0", "x", None], [5000000, 0, None, None]),
        (parse.price_first_run, ["1.000 - 2.000", "1,234,567 ₫", "N/A", None], [1000.0, 1234567.0, None, None]),
        (parse.price_plain, ["1.000", "1,000", "", None], [1000, None, None, None]),
        (parse.area_first, ["25.5 m²", "25,5 m2", "khoảng 20 m2", "N/A", None], [25.5, 25.0, 20.0, None, None]),
        (parse.area_comma, ["25 m²", "25,5 m2", "m2", None], [25.0, 25.5, None, None]),
        (parse.area_integer, ["25.5", "x", None], [25, None, None]),
        (parse.area_whole, ["25,5 m2", "25.5 m2", " 30 m² ", "khoảng 20 m2", "12f", "N/A", None], [None, 25.5, 30.0, None, None, None, None]),
        (parse.area_with_unit, ["25 m²", "25M2", "25", None], [25, 25, None, None]),
        (parse.people, ["2 người", "4", "x", None], [2, 4, None, None]),
        (parse.score, ["8,9", "8.9", "nan", "N/A", "abc", None], [8.9, 8.9, None, None, None, None]),
        (parse.distance_km, ["1,2 km", "350 m", "7", "N/A", None], [1.2, 0.35, 7.0, None, None]),
        (parse.flag_loose, ["Yes", "No", "có", "không có", "10", None], [1, 0, 1, 1, 1, 0]),
        (parse.flag_co, ["có", "no", None], [1, 0, None]),
        (parse.flag_exact, ["Yes", "yes", None], [True, False, False]),
        (parse.badge, ["None", "", "x", None], ["No Deal", "No Deal", "x", None]),
        (parse.tidy, [" a\t b\n ", "nan", "N/A", None], ["a b", "", "", ""]),
        (parse.facility_list, ["Wifi, Pool , ,TV", "N/A", None], ["wifi, pool, tv", None, None]),
        (parse.review_count, ["1.234 đánh giá", "56 reviews", "x", None], [1234, 56, None, None]),
        (parse.date, ["2025-01-02", "2025-13-01", None], [__import__("datetime").date(2025, 1, 2), None, None]),
        (lambda c: classify.tags(c, classify.BED_TAGS), ["Double đôi", "King and sofa", "Phòng", "xyz", "n/a", None], ["Double", "King & Sofa", "Standard", "Other", "Unknown", "Unknown"]),
        (classify.room_level, ["Villa Suite", "suite", "doanh nhân", "cao cấp", "superior", "family", "", None], ["Luxury", "Suite", "Executive", "Deluxe", "Superior", "Standard", "Standard", "Standard"]),
        (classify.room_level_words, ["Grandview", "grand luxury", "(blanks)", None, "x"], ["Standard", "Luxury", "Unknown", "Unknown", "Standard"]),
        (classify.room_family, ["hostel", "căn hộ studio", "2 bedroom apartment", "apartment", "phòng", "xyz", None], ["Dormitory", "Studio", "Apartment 2BR", "Apartment", "Standard Room", "Unknown", "Unknown"]),
        (classify.bed_family, ["king", "twin đơn", "king sofa", "x", None], ["King", "Single", "Mixed Beds", "Unknown", "Unknown"]),
        (classify.bed_class, ["Large", "Twin", "Double & King", "Standard", "", None], ["Large Double", "Single", "Mixed", "Unknown", "Unknown", "Unknown"]),
        (classify.bed_text, ["1 giường king", "2 giường đơn, king", "dorm king", "x", None], ["King", "Mixed", "Dormitory", "Unknown", "Unknown"]),
        (classify.city, ["Vung Tau, hcm", "ba ria", "x", None], ["Hồ Chí Minh", "Vũng Tàu", None, None]),
        (classify.room_score, ["Villa", "Dorm", "x", None], [8, 0, 2, 2]),
        (features.count_facilities, ["a, b", "a; b", "nan", None], [2, 1, 0, 0]),
    ],
)
def test_column_rules(spark, f, values, want):
    assert column(spark, values, f) == want


def test_district(spark):
    df = spark.createDataFrame([(0, "12 Lê Lợi, Quận 1", None), (1, "Quận Bình Thạnh, x", None), (2, "vung tau", None), (3, "x", "da nang"), (4, "x", "nan"), (5, None, None)], "i int, a string, s string")
    got = [r[0] for r in df.orderBy("i").select(classify.district(F.col("a"), F.col("s"))).collect()]
    assert got == ["Quận 1", "Quận Bình Thạnh", "TP. Vũng Tàu", "Da Nang", "Other", "Other"]


def test_discount(spark):
    df = spark.createDataFrame([(0, 100.0, 50.0), (1, 0.0, 5.0), (2, 50.0, 100.0), (3, 400.0, 399.0)], "i int, o double, f double")
    assert [r[0] for r in df.orderBy("i").select(parse.discount_percent(F.col("o"), F.col("f"))).collect()] == [50.0, 0.0, 0.0, 0.2]


def test_golden_quotas():
    counts = dict(enumerate((2063, 2040, 1902, 2034, 2060, 2037)))
    q = quality.quotas(counts, (0.7, 0.15, 0.15))
    assert [q[k][0] for k in range(6)] == [1444, 1428, 1331, 1424, 1442, 1426]
    assert [q[k][1] for k in range(6)] == [309, 306, 286, 305, 309, 305]
    assert [q[k][2] for k in range(6)] == [310, 306, 285, 305, 309, 306]


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("c"))
    a = quality.stratified_split(df, "c", "k")
    b = quality.stratified_split(df.repartition(7), "c", "k")
    assert a.count() == 5000 and a.exceptAll(b).isEmpty()
    assert {r[0]: r[1] for r in a.groupBy("split").count().collect()} == {"train": 3500, "validation": 750, "test": 750}


def test_outliers_small_groups(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 1000)] + [("b", float(x)) for x in (1, 2, 3, 4, 1000)] + [("b", None), (None, 1.0)], "g string, x double")
    kept = quality.drop_outliers(df, "x", "g")
    assert {r[0]: r[1] for r in kept.groupBy("g").count().collect()} == {"a": 4, "b": 4}


def test_scale_and_labels(spark):
    df = spark.createDataFrame([(1.0, 5.0, "b"), (3.0, 5.0, "a"), (None, 5.0, None)], "x double, y double, c string")
    scaled = features.scale(df, features.fit_ranges(df, ["x", "y"]), ["x", "y"])
    assert sorted(map(tuple, scaled.select("x", "y").collect()), key=str) == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    labels = features.fit_labels(df, "c")
    assert {r["c"]: r["c_index"] for r in features.encode(df, labels, "c", -1).collect()} == {"a": 0, "b": 1, None: -1}


def test_keep_first_and_best(spark):
    df = spark.createDataFrame([(None, 2, 1.0), (None, 1, None), ("a", 3, 2.0), ("a", 4, 2.0)], "k string, i int, r double")
    assert {(x["k"], x["i"]) for x in rows.keep_first(df, ["k"], ["i"]).collect()} == {(None, 1), ("a", 3)}
    assert {(x["k"], x["i"]) for x in rows.keep_best(df, ["k"], "r", ["i"]).collect()} == {(None, 2), ("a", 3)}


def test_aligned_needs_equal_counts(spark):
    with pytest.raises(ValueError):
        rows.aligned(spark.range(3), spark.range(4), "id")


def test_rekey_by_scope(spark):
    parents = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "city string, old long")
    children = spark.createDataFrame([("y", 1, "r1"), ("x", 2, "r2"), ("z", 9, "r3")], "city string, old long, room string")
    _, out = rows.rekey(parents, children, "city", "old", "new", "H_", 3)
    assert {r["room"]: r["new"] for r in out.collect()} == {"r1": "H_003", "r2": "H_002", "r3": None}


def test_sources_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    assert readers.tolerant(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "a.csv").write_bytes("﻿id;t\n1;\"x\ny\"\n2;z\n".encode())
    df = readers.csv(spark, str(tmp_path / "a.csv"), schema, ";")
    assert {tuple(r) for r in df.collect()} == {(1, "x\ny"), (2, "z")}
    sinks.overwrite(df, str(tmp_path / "p"))
    sinks.append(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert not sinks.overwrite_unless_empty(df.where("id > 5"), str(tmp_path / "p")) and spark.read.parquet(str(tmp_path / "p")).count() == 4
    marked = conform.with_reject_reason(spark.createDataFrame([("a", 10.0), ("Unknown", 1.0), ("a", 500.0), ("a", None)], "l string, x double"), "l", "x")
    sinks.quarantine(marked, str(tmp_path / "both"))
    assert (spark.read.parquet(str(tmp_path / "both/accepted=true")).count(), spark.read.parquet(str(tmp_path / "both/accepted=false")).count()) == (2, 2)
    sinks.lines(spark.createDataFrame([(" http://a ",), ("",)], "u string"), "u", str(tmp_path / "l"))
    assert [r[0] for r in readers.links(spark, str(tmp_path / "l")).collect()] == ["http://a"]
    sinks.csv(df, str(tmp_path / "c"))
    sinks.nested_json(df.select(F.struct("id", "t").alias("room")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    up = {r["id"]: r["t"] for r in sinks.upsert(df, spark.createDataFrame([(2, None), (3, "n")], schema), "id", ["t"]).collect()}
    assert up == {1: "x\ny", 2: None, 3: "n"}


def test_shape_and_conform(spark):
    df = spark.createDataFrame([("1", None)], "ID string, Extra string")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("new", T.StringType())])
    out = conform.conform(df, target)
    assert out.schema == target and tuple(out.first()) == (1, None) and conform.conform(out, target).first() == out.first()
    assert conform.snake_names(spark.createDataFrame([(1,)], ["Discount % x-y"])).columns == ["discount_percent_x_y"]
    assert conform.resolve(df, "nope", "extra") == "Extra"
    assert {r["column"]: r["present"] for r in profile.shape(df).collect()} == {"ID": 1, "Extra": 0}


def test_pages(spark):
    html = '<h1 class="x">Khách <b>sạn</b></h1><span>9,5<svg/></span><span>8.1</span><span>12 Lê Lợi, Quận 1, Việt Nam</span><p>1.234 đánh giá -18% 2.894.667 ₫</p><ul><li>Wifi</li><li>Pool</li><li>Wifi</li></ul><a href="/hotel/12-a.html#x">a</a>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    h = F.col("h")
    t = pages.visible(h)
    r = df.select(pages.name(h), pages.rating(h), pages.address(h, t), pages.reviews(t), pages.discount(t), pages.list_prices(t), pages.amenities(h)).first()
    assert tuple(r) == ("Khách sạn", "9,5", "12 Lê Lợi, Quận 1, Việt Nam", "1234", "-18%", ["2.894.667 ₫"], "Wifi | Pool")
    assert [x[0] for x in pages.links(df, "h", "https://stay.example", "stay.example", r"^/hotel/\d+-.*\.html$").collect()] == ["https://stay.example/hotel/12-a.html"]
    assert df.select(pages.facility_lines(F.lit("Wifi\nĐóng\n x \nPool"))).first()[0] == "Wifi, Pool"


def test_regression_and_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    r = {x["class"]: x for x in evaluate.one_vs_rest(df, "y", "p").collect()}
    assert (r["a"]["tp"], r["a"]["fp"], r["a"]["fn"], r["a"]["tn"]) == (1, 1, 1, 1) and r["c"]["precision"] == 0.0
    assert {x["class"] for x in evaluate.report(df, "y", "p").collect()} == {"a", "b", "c", "macro", "weighted", "accuracy"}


def test_nested_documents(spark):
    from roomflow.plans.stages import nested_hotels

    df = spark.createDataFrame([("h", "l", "2", "t", "c", 1.0, 5.0, "f", "b", 2), ("h", "l", "1", "t", "c", 1.0, 6.0, None, "b", 3), ("h", None, "3", "t", "c", 1.0, 6.0, None, "b", 3)], "hotel_name string, location string, row_id string, room_type string, room_class string, area double, price double, facilities string, badge string, people int")
    got = nested_hotels(df).collect()
    assert len(got) == 1 and [r["room_id"] for r in got[0]["rooms"]] == ["1", "2"] and got[0]["rating"] == 3 and got[0]["rooms"][0]["amenities"] == "b"


def test_dense_ids_keep_all_rows(spark):
    """Wide rows, many partitions and small coalescing: the written table has every row and 1..n."""
    from roomflow.sources.places import stored

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        df = spark.range(400_000).select(F.xxhash64("id").alias("k"), "id", F.rpad(F.col("id").cast("string"), 128, "x").alias("pad"))
        got = rows.dense_ids(df, ["k", "id"], "n")
        back = stored(got, "dense")
        assert back.agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n"), F.countDistinct("id")).first() == (400_000, 1, 400_000, 400_000, 400_000)
        small = back.where("n <= 50").orderBy("n").toPandas()
        assert small.k.is_monotonic_increasing
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_first_rows_carry_what_is_read(spark, sf):
    """Only the wanted columns go through the de-duplication of rooms."""
    from roomflow.plans.stages import clean_rooms
    from roomflow.plans.tables import rooms

    plan = clean_rooms(rooms(spark, sf), "facilities")._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "min_by" in line)
    assert "facilities" in aggregate and not any(c in aggregate for c in ("address", "room_text", "check_in", "bed_tags"))


def test_splits_by_cut_draws(spark, monkeypatch):
    """Rows are told apart by the draws at the cuts, without ranking all of them; where rows of one key meet a cut, the sizes are exact too."""
    monkeypatch.setattr(quality, "BUCKET_ROWS", 20)
    classes = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, "a").when(F.col("id") == 1, "one").otherwise("b")
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), classes.alias("c"))
    plain = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    parts, some = quality.stratified_split(df, "c", "k"), quality.sample_per_class(df, "c", 400, "k")
    assert "Window" not in plain(parts) and "Window" not in plain(some)
    most = df.groupBy("c").count().agg(F.max("count")).first()[0]
    ranked = {r["k"]: (r["c"], r["__rank"]) for r in quality._ranked(df, "c", 42, "k", most).collect()}
    sizes = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    quotas = quality.quotas(sizes, (0.7, 0.15, 0.15))
    want = {k: "test" if n <= quotas[c][2] else "validation" if n <= quotas[c][2] + quotas[c][1] else "train" for k, (c, n) in ranked.items()}
    assert {r["k"]: r["split"] for r in parts.collect()} == want
    assert {r["k"] for r in some.collect()} == {k for k, (_, n) in ranked.items() if n <= 400}
    tied = df.withColumn("k", F.lit("same")).where("c IS NOT NULL")
    sizes = {r["c"]: r["count"] for r in tied.groupBy("c").count().collect()}
    quotas = quality.quotas(sizes, (0.7, 0.15, 0.15))
    got = {(r["c"], r["split"]): r["count"] for r in quality.stratified_split(tied, "c", "k").groupBy("c", "split").count().collect()}
    assert got == {(c, s): n for c, q in quotas.items() for s, n in zip(("train", "validation", "test"), q, strict=True) if n}
