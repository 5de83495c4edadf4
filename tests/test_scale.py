"""What only shows on larger tables: sums in another order, ids with more digits."""

import contextlib
import io
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from roomflow.functions import classify, parse
from roomflow.operators import conform, copula, models, profile, quality, rows
from roomflow.plans import stages, tables
from roomflow.plans.queries import ORACLE_SQL, QUERIES

#: Means that are whole numbers, whose sums as doubles fall short of them in this order.
SHORT = {1: [3.42, 1.22, 0.11, 3.52, 2.04, 1.69], 2: [3.7, 4.52, 1.67, 2.11]}


def test_user_rates(spark):
    prices = [(u, x) for u, values in SHORT.items() for x in values]
    events = spark.createDataFrame([(u, "purchase", "ota", x) for u, x in prices] + [(3, "click", "ta", 7.99), (3, "purchase", "ota", None), (4, "view", None, 1.0), (5, "click", "ta", float("nan"))], "user_id long, event_type string, kind string, value double")
    got = {r.user_id: r.rate for r in profile.best_rate(events.coalesce(1), ["user_id"], "kind", "value").collect()}
    assert got == {1: 2, 2: 3, 3: 7}
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", [list(r)[:2] + [r.value] for r in events.collect()])
    assert dict(con.execute(ORACLE_SQL["user_rates"]).fetchall()) == got


def test_room_codes_of_seven_digits(spark):
    """Ids that outgrow the code's width keep all digits."""
    con = duckdb.connect()
    con.execute("CREATE TABLE rooms AS SELECT 'h' AS hotel_name, i AS row_id FROM range(1000001) t(i)")
    sql = ORACLE_SQL["surrogate_ids"]
    want = dict(con.execute(f"SELECT id, room_code FROM ({sql[sql.rindex('SELECT row_id'):]}) WHERE id IN (1, 999999, 1000000, 1000001)").fetchall())
    ids = spark.createDataFrame([(i,) for i in want], "id long").select("id", rows.padded_id(F.col("id"), "ROOM_", 6).alias("code"))
    assert {r.id: r.code for r in ids.collect()} == want and want[1000000] == "ROOM_1000000"


def _method_bytes(df):
    """Byte code of the longest method of each compiled stage; the JVM doesn't compile methods of over 8000."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]


@pytest.mark.parametrize("columns", [("row_id",), stages.FEATURES, ("location", "room_type", "facilities", "badge")])
def test_cleaning_is_compiled(spark, sf, columns):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = _method_bytes(stages.clean_rooms(tables.rooms(spark, sf), *columns))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_computed_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, `x y` string")
    got = conform.computed(df, {"n": F.length("`x y`"), "id": F.col("id") * 2}).where("n IS NOT NULL")
    assert got.columns == ["x y", "n", "id"] and sorted((r.id, r.n) for r in got.collect()) == [(2, 3), (6, 0)]


def test_flags_read_the_rows_once(spark, sf):
    """What is left to do after the rows were stored reads no line items."""
    for name in ("class_flags", "prepared_features"):
        assert not any("lineitem" in f for f in QUERIES[name](spark, sf).inputFiles()), name


def test_discrete_median(spark):
    df = spark.createDataFrame([(x,) for x in (4.0, 1.0, None, 3.0, 2.0)], "x double")
    assert sorted(r.x for r in quality.fill_median(df, ["x"], discrete=True).collect()) == [1.0, 2.0, 2.0, 3.0, 4.0]
    assert sorted(r.x for r in quality.fill_median(df, ["x"]).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_rooms_meet_without_grams(spark, sf):
    """Pages of few rooms are lists: no row for each gram of a name, which took over 100 times the input's disk."""
    plan = QUERIES["matched_rooms"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "__gram" not in plan and "collect_list" in plan


@pytest.mark.parametrize("most", [0, 3, 64])
def test_rooms_meet_alike_in_lists_and_index(spark, monkeypatch, most):
    """Pages of 1 to 9 rooms by lists, by the index and by both; the plain rule by a join of all with all."""
    monkeypatch.setattr(rows, "PAGE_ROOMS", most)
    words = F.split(F.lit("sea view,Sea View Suite,SUITE,double,double sea,,x"), ",")
    all_ = spark.range(200).select(F.col("id").alias("at"), F.expr("cast(sqrt(id) as int)").alias("link"), F.when(F.col("id") % 11 != 0, words[(F.col("id") * 7 % 5 + F.col("id") % 3).cast("int")]).alias("page"))
    listings = all_.select(F.col("at").alias("id"), F.when(F.col("at") % 17 != 0, F.col("link")).alias("link"), words[(F.col("at") % 7).cast("int")].alias("name"))
    got = {r.id: r.match and (r.match.at, r.match.page) for r in rows.match_rooms(listings, all_, "link", "name", "page", "at", "id").collect()}
    pages, flat = [tuple(r) for r in all_.collect()], lambda x: "".join(x.lower().split())
    for r in listings.collect():
        hits = [(at, p) for at, link, p in pages if link == r.link and p is not None and (flat(p) in flat(r.name) or flat(r.name) in flat(p))]
        assert got[r.id] == min(hits, default=None), r


def test_forests_keep_all_cores_busy(spark):
    """A table of one partition is fitted in as many tasks as there are cores, with all of its rows."""
    df = spark.range(1000).coalesce(1).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("x"), F.lit("unused").alias("text"))
    got = models._spread(df, ["x"], "label")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.columns == ["label", "features"] and got.count() == 1000



def test_page_texts_are_made_once(spark, sf):
    """a page's text is asked for every word and made once; made anew for each, the code outgrew what the JVM takes."""
    plan = QUERIES["located_pages"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(script|style)") == 1



def test_no_cast_is_tried_in_vain(spark):
    """texts that can't be numbers are not cast, since a cast that fails costs many times one that doesn't; the values are those of the cast."""
    values = ["inf", " Infinity ", "-INF", "nan", "1e5", "1d", "0x1p3", "12.", ".5", "+7", " 7 ", "\x7f7", " 7", None, "", "abc", "٣", "-7.9", "99999999999", "1.234 VND"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    c = F.col("c")
    plain = c.try_cast("double")
    got = df.where(~parse.number(c).eqNullSafe(F.when(~F.isnan(plain), plain)) | ~parse.integer(c, 0).eqNullSafe(F.coalesce(c.try_cast("int"), F.lit(0))))
    assert got.collect() == []
    plan = df.select(parse.number(c).alias("a"), parse.integer(c, 0).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") >= 2


def test_strip_takes_all_white_space(spark):
    """the ends are looked at without a pattern, and lose what Unicode counts as white space."""
    points = [*range(0x250), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF]
    df = spark.createDataFrame([(p, f"{chr(p)}a{chr(p)} b{chr(p)}{chr(p)}") for p in points], "p int, c string")
    c = F.col("c")
    assert df.where(parse.strip(c) != F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).collect() == []
    plan = df.select(parse.strip(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan



def test_classes_run_few_patterns(spark, sf):
    """tags are counted without patterns, and no step makes a method that the JVM doesn't compile."""
    df = spark.createDataFrame([(None,), ("",), ("King",), ("KingKing",), ("King & Sofa",), ("Standard",), ("Twin",), ("Large",), ("2 giường đôi",), ("twin sofa",)], "c string")
    got = [(r.a, r.b) for r in df.select(classify.bed_class(F.col("c")).alias("a"), classify.bed_family(F.col("c")).alias("b")).collect()]
    assert got == [("Unknown", "Unknown"), ("Unknown", "Unknown"), ("King", "King"), ("Mixed", "King"), ("Mixed", "Mixed Beds"), ("Unknown", "Unknown"), ("Single", "Single"), ("Large Double", "Unknown"), ("Unknown", "Double"), ("Unknown", "Mixed Beds")]
    plan = QUERIES["classes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert max(_method_bytes(QUERIES["classes"](spark, sf))) < 8000 and max(_method_bytes(QUERIES["located_pages"](spark, sf))) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_short_classes_are_modelled(spark, monkeypatch):
    """rows of classes that get no generated rows are not sorted for a model."""
    seen, plain = [], copula.dense_ids
    monkeypatch.setattr(copula, "dense_ids", lambda df, *a: seen.append({r.c for r in df.select("c").distinct().collect()}) or plain(df, *a))
    held = spark.range(60).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 50, "large").otherwise("small").alias("c"), F.col("id").cast("double").alias("x"))
    wanted = spark.createDataFrame([("large", 0), ("small", 7)], "c string, n int")
    made = copula.generate(held, "c", wanted, "k", ["x"]).collect()
    assert seen == [{"small"}] and len(made) == 7 and {r.c for r in made} == {"small"} and all(50 <= r.x < 60 for r in made)


def test_trees_are_grown_once(spark, monkeypatch, tmp_path):
    """a larger forest has the trees of the smaller ones; groups of trees join to one forest that is saved, loaded and applied as any other."""
    grown, plain = [], models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **settings: grown.append(settings["numTrees"]) or plain(**settings))
    monkeypatch.setattr(models, "GROUP_TREES", 2)
    df = spark.range(400).select((F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) + F.rand(1) * 2).alias("x"), F.rand(2).alias("z"))
    model, _, n = models.random_forest(df, df, ["x", "z"], "label", trees=(2, 5), depth=3)
    assert sum(grown) == 5 and max(grown) == 2
    grown.clear()
    whole, accuracy, _ = models.random_forest(df, df, ["x", "z"], "label", trees=(5,), depth=3)
    assert sum(grown) == whole.getNumTrees == 5 and len(whole.featureImportances) == 2
    models.save(whole, str(tmp_path / "forest"))
    again = type(whole).load(str(tmp_path / "forest"))
    rows = models.score(again, df, ["x", "z"], "label")
    assert again.getNumTrees == 5 and rows.agg(F.avg("correct")).first()[0] == accuracy
    votes = [models.vector_to_array(F.col("probability"))[k].alias(f"p{k}") for k in range(3)]
    assert whole.transform(models.assemble(df, ["x", "z"])).select(votes).collect() == again.transform(models.assemble(df, ["x", "z"])).select(votes).collect()


def test_training_rows_are_cleaned_once(spark, sf):
    """labels, counts, cuts and rows come from a stored table; each of them cleaned and shuffled the line items anew."""
    from roomflow.plans import profile_queries

    assert not any("lineitem" in f for f in profile_queries._training(spark, sf).inputFiles())


def test_rooms_are_kept_before_their_texts(spark, sf):
    """What is shuffled and kept by hotel are the joined columns, not the texts that are made from them; rooms made from them are the same."""
    from roomflow.plans import source_queries, tables
    from roomflow.sources.places import stored_by

    kept = stored_by(tables.joined(spark, sf), "kept", "s_name")
    made, plain = tables.rooms_of(spark, kept), tables.rooms(spark, sf)
    assert made.schema == plain.schema and made.exceptAll(plain).isEmpty() and made.count() == plain.count()
    plan = source_queries.sites(spark, sf, once=True)["trips"]._jdf.queryExecution().optimizedPlan().toString()
    assert "stay.example" in plan  # the link is made where the kept rows are read
