"""Literal rows of each site in the unified schemas, generated rows by copula, and how often balancing reads its tables."""

import re

import pytest
from pyspark.sql import functions as F

from roomflow.operators import copula
from roomflow.plans import site_maps, stages


@pytest.fixture(scope="module")
def sites(spark):
    def table(columns, *rows):
        return spark.createDataFrame(list(rows), columns)

    stays_rooms = "hotel_id string, room_name string, bed_type string, area_m2 string, max_occupancy int, price long, amenities string"
    tours_rooms = "hotel_name string, hotel_link string, room_name string, people string, area string, bed string, room_amenities string, list_price string, final_price string, discount_pct string, breakfast string, cancel_policy string"
    tours_hotels = "ten string, link string, dia_chi string, diem_danh_gia double, so_luong_danh_gia string, tien_nghi string"
    return {
        "booking": table(
            "`Hotel Name` string, `Hotel Link` string, `Search Location` string, `Address` string, `Stars_Clean` double, `Rating_Clean` double, `Review Count` string, `Room Type` string, `Room_Class` string, `Bed Type` string, `Area_m2_cleaned` double, `Total_Guests` int, `Original Price` long, `Final Price` long, `Discount %` string, `Free_Cancel_Bool` boolean, `Breakfast_Bool` boolean, `Facilities_cleaned` string, `Check-in` string",
            ("B", "b/1", "hue", "1 A", 4.0, 8.5, "12", "Deluxe", "Deluxe", "King", 25.5, 2, 2000, 1500, "25", True, False, "wifi", "2025-01-01"),
        ),
        "trips": table(
            "hotelId string, hotelName string, imageUrl string, cityName string, address string, latitude double, longitude double, star double, commentScore double, commenterNumber string, roomNames string, categoryName string, minPrice long, maxPrice long, checkInDates string, checkOutDates string",
            ("7", "T", "t/1", "Hue", "2 B", 1.5, 2.5, 3.0, 7.5, "4", "Twin", "hotel", 900, 1000, "d1", "d2"),
        ),
        "stays hotels": table("hotel_id string, hotel_name string, hotel_link string, city string", ("1", "S", "s/1", "Hanoi")),
        "stays rooms": table(stays_rooms, ("1", "r1", "bed", "25,5 m2", 2, 100, "a"), ("1", "r2", "bed", "25.5 m²", 2, 100, "a"), ("1", "r3", None, "khoảng 20 m2", 2, 100, None), ("9", "none", None, "30", 1, 5, None)),
        "advisor": table("hotel_name string, hotel_url string, address string, ratingValue double, reviewCount string, room_types string, amenities string, priceRange string", ("A", "a/1", "3 C", 4.5, "9", "Suite", "pool", "1.000 - 2.000"), ("A2", "a/2", None, None, None, None, None, "₫ on request")),
        "tours hotels 1": table(tours_hotels, ("Ten", "u/1", "4 D", 8.0, "5 đánh giá", "tv | pool")),
        "tours rooms 1": table(tours_rooms, ("room's hotel", "u/1", "x", "2 người", "20", "Double", "wifi", "2.000.000 ₫", "1.500.000 ₫ - 1.600.000 ₫", "25", "Có", "không")),
        "tours hotels 2": table(tours_hotels, ("Hai", "u/2", None, None, None, None)),
        "tours rooms 2": table(tours_rooms, ("other", "u/2", "y", None, "20,5 m2", None, None, None, "0", None, None, None), ("lost", "u/3", "z", None, None, None, None, None, None, None, None, None)),
    }


def test_ten_columns(sites):
    got = {(r.source, r.room_type, r.hotel_name): r for r in site_maps.ten_columns(sites).collect()}
    assert len(got) == 9  # rooms that find no hotel have no name and go
    assert tuple(got["booking", "Deluxe", "B"]) == ("booking", "B", "b/1", "1 A", 8.5, "Deluxe", "King", 25.5, "wifi", 1500.0)
    assert tuple(got["trips", "Twin", "T"]) == ("trips", "T", "t/1", "2 B", 7.5, "Twin", None, None, "hotel", 900.0)
    assert [got["stays", r, "S"].area_m2 for r in ("r1", "r2", "r3")] == [None, 25.5, None]  # all of it must be a number
    assert got["stays", "r1", "S"].address == "Hanoi" and got["stays", "r1", "S"].rating is None
    assert (got["advisor", "Suite", "A"].price, got["advisor", None, "A2"].price) == (1000.0, None)  # the first run of digits
    assert tuple(got["tours", "x", "Ten"]) == ("tours", "Ten", "u/1", "4 D", 8.0, "x", "Double", 20.0, "wifi | tv | pool", 1500000.0)
    assert tuple(got["tours", "y", "Hai"])[6:] == (None, None, " | ", 0.0)


def test_wide_columns(sites):
    got = {(r.source, r.room_name): r for r in site_maps.wide_columns(sites).collect()}
    assert len(got) == 11
    b = got["booking", "Deluxe"]
    assert (b.area_m2, b.max_occupancy, b.price_original, b.price_final, b.free_cancel, b.breakfast, b.checkin_date) == (25, 2, "2000", "1500", 1, 0, "2025-01-01")
    assert (got["trips", "Twin"].hotel_id, got["trips", "Twin"].price_original, got["trips", "Twin"].checkout_date) == ("7", "1000", "d2")
    assert [got["stays", r].area_m2 for r in ("r1", "r2", "r3", "none")] == [25, 25, 20, 30]  # the first integer
    assert (got["stays", "none"].hotel_name, got["stays", "r1"].hotel_name, got["stays", "r1"].discount_pct) == (None, "S", "0")
    assert got["advisor", "Suite"].price_final == "1.000 - 2.000"  # texts pass through
    t = got["tours", "x"]
    assert (t.hotel_name, t.address, t.max_occupancy, t.area_m2, t.price_original, t.price_final, t.free_cancel, t.breakfast) == ("room's hotel", "4 D", 2, 20, "2000000", "15000001600000", 0, 1)
    assert (got["tours", "z"].address, got["tours", "z"].hotel_name, got["tours", "y"].price_final) == (None, "lost", "0")


def test_copula(spark):
    """Marginals and correlations of generated rows are those of their class; only its values occur; every run gives the same."""
    base = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), F.randn(3).alias("x"), F.randn(4).alias("e"))
    rows = base.select("k", "c", F.round(F.exp("x"), 6).alias("price"), (F.when(F.col("c") == "a", F.col("x")).otherwise(-F.col("x")) * 0.9 + F.col("e") * 0.3).alias("area"), (F.abs(F.col("e")) * 3).cast("int").alias("people"))
    rows = rows.union(spark.createDataFrame([("z1", "one", 5.0, None, 2)], "k string, c string, price double, area double, people int"))
    wanted = spark.createDataFrame([("a", 2000), ("b", 1500), ("one", 3), ("none", 0)], "c string, n int")
    made = copula.generate(rows, "c", wanted, "k", ["price", "area", "people"], seed=7)
    again = copula.generate(rows.repartition(7), "c", wanted, "k", ["price", "area", "people"], seed=7)
    got, real = made.toPandas().sort_values(["c", "draw"]).reset_index(drop=True), rows.toPandas()
    assert got.equals(again.toPandas().sort_values(["c", "draw"]).reset_index(drop=True)[got.columns])
    assert got.groupby("c").size().to_dict() == {"a": 2000, "b": 1500, "one": 3} and dict(made.dtypes)["people"] == "int"
    one = got[got.c == "one"]
    assert one.price.tolist() == [5.0] * 3 and one.area.isna().all() and one.people.tolist() == [2] * 3
    for c in "ab":
        g, r = got[got.c == c], real[real.c == c]
        for v in ("price", "area", "people"):
            assert set(g[v]) <= set(r[v])
            for q in (0.1, 0.5, 0.9):
                assert abs((r[v] <= g[v].quantile(q)).mean() - (r[v] <= r[v].quantile(q)).mean()) < 0.05
        assert (g[["price", "area", "people"]].rank().corr() - r[["price", "area", "people"]].rank().corr()).abs().max().max() < 0.08


def test_normal(spark):
    row = spark.range(1).select(*[copula.quantile(F.lit(u)).alias(f"q{i}") for i, u in enumerate((0.001, 0.3, 0.5, 0.999))], copula.distribution(F.lit(1.96)).alias("p"), copula.distribution(F.lit(-1.96)).alias("m")).first()
    assert [round(x, 5) for x in row] == [-3.09023, -0.5244, 0.0, 3.09023, 0.975, 0.025]


def test_balancing_reads_little(spark, sf):
    """The raw rows are cleaned once; what follows reads stored tables."""
    from roomflow.plans.tables import rooms

    plan = stages.balanced_rooms(rooms(spark, sf))._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    assert len(scans) <= 3 and not any("lineitem.parquet" in s for s in scans)


def test_room_names_meet_through_their_grams(spark):
    """The same pairs as all with all, from far fewer candidates on a page with very many names."""
    import random

    from roomflow.operators import rows

    draw = random.Random(2)
    words = [f"{a}{b}" for a in ("delu", "suit", "king", "twin", "view", "fami") for b in ("xe", "e room", "ly", " bed")]
    page = [("hot", f"{draw.choice(words)} {draw.choice(words)} {i % 97}", i) for i in range(600)] + [("cold", "A", 0), ("cold", "", 1), ("cold", None, 2), (None, "A", 3)]
    listed = [(i, "hot", draw.choice(words) + draw.choice(["", " 5", "zz"])) for i in range(200)] + [(900, "cold", "a room"), (901, "cold", ""), (902, "cold", None), (903, None, "a"), (904, "gone", "a"), (905, "cold", " A ")]
    listings, pages = spark.createDataFrame(listed, "id long, link string, name string"), spark.createDataFrame(page, "link string, page string, at long")
    got = {r.id: r.match.at if r.match else None for r in rows.match_rooms(listings, pages, "link", "name", "page", "at", "id").collect()}
    plain = lambda t: re.sub(r"\s", "", t.lower())
    want = {i: next((at for other, p, at in page if link is not None and other == link and None not in (n, p) and (plain(n) in plain(p) or plain(p) in plain(n))), None) for i, link, n in listed}
    assert got == want and sum(x is not None for x in want.values()) > 100
    names, texts = listings.selectExpr("link", "regexp_replace(lower(name), '\\\\s', '') AS l").distinct(), pages.selectExpr("link", "regexp_replace(lower(page), '\\\\s', '') AS p").where("p IS NOT NULL").distinct()
    assert rows.containing_candidates(names, texts, "link", "l", "p").where("link = 'hot'").count() < 0.2 * names.where("link = 'hot'").count() * texts.where("link = 'hot'").count()


@pytest.mark.parametrize("name", ["ten_columns", "wide_columns"])
def test_rooms_made_once(spark, sf, name):
    """All sites read the rooms that were made once, and a site whose rows name the hotel is counted without a shuffle."""
    from roomflow.plans import source_queries
    from roomflow.plans.queries import QUERIES

    found = source_queries.sites(spark, sf, once=True)
    tables = getattr(site_maps, name.replace("columns", "tables"))(found)
    assert "Exchange" not in source_queries._counted(tables["trips"])._jdf.queryExecution().executedPlan().toString()
    assert not any("lineitem" in f for f in QUERIES[name](spark, sf).inputFiles())
