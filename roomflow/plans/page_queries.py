"""Queries over stored pages. The tables' pages hold no rooms, so each page gets a listing card made from its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.functions import classify
from roomflow.operators import pages
from roomflow.plans.registry import query
from roomflow.sources import readers

_ID = "cast(page_id % 1000 as varchar(20))"
#: A page with its card, on Spark and DuckDB.
CARD_SQL = f"""concat(html,
 '<span>', CASE page_id % 4 WHEN 0 THEN concat('8,', cast(page_id % 10 as varchar(20)), '<svg></svg>') WHEN 1 THEN '7.5' WHEN 2 THEN '11' ELSE 'new' END, '</span><span>6.5</span>',
 '<span>', {_ID}, CASE page_id % 3 WHEN 0 THEN ' Lê Lợi, Quận 1, Việt Nam' WHEN 1 THEN ' đường Hồ Chí Minh, phường 2' ELSE ' road' END, '</span>',
 '<p>1.', lpad({_ID}, 3, '0'), CASE WHEN page_id % 5 = 0 THEN ' đánh giá' WHEN page_id % 5 = 1 THEN ' reviews' ELSE ' (12)' END, CASE WHEN page_id % 2 = 0 THEN ' -18% 2.894.667 ₫' ELSE ' 950.000 ₫' END, ' location: ', cast(page_id % 12 as varchar(20)), ',5</p>',
 CASE WHEN page_id % 3 = 0 THEN '<div data-testid="rating-stars" aria-label="4 of 5"></div>' WHEN page_id % 3 = 1 THEN '<svg/><svg/><svg/>' ELSE '' END,
 CASE WHEN page_id % 2 = 0 THEN '<div class="x" data-testid="review-score"><b>8,9</b> Very good</div><span data-testid="address">District 1</span>' ELSE '' END,
 CASE WHEN page_id % 6 = 0 THEN 'Free cancellation' WHEN page_id % 6 = 1 THEN 'bao bữa sáng' ELSE '' END,
 '<ul><li>25 m²</li><li>Hướng biển</li><li>2 giường đơn</li><li>', {_ID}, ' m²</li></ul><script>no(1)</script>', CASE WHEN page_id % 7 = 0 THEN ' không còn phòng' WHEN page_id % 7 = 1 THEN ' near Da Lat' WHEN page_id % 7 = 2 THEN ' Ho Chi Minh City' ELSE '' END)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html with the card, and its visible text, made once."""
    p = readers.table(spark, sf_dir, "pages").select("page_id", "url", F.expr(CARD_SQL).alias("html"))
    return p.withColumn("text", pages.visible(F.col("html")))


def _visible(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return rf"(SELECT CASE WHEN v IN ('nan', 'None', 'N/A') THEN '' ELSE v END FROM (SELECT trim(regexp_replace(coalesce({bare}, ''), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')) AS v))"


def _shown(x: str) -> str:
    """The visible text within a lambda, where no sub-query may stand (no element of these pages is a spelling of missing)."""
    return _visible(x).split("FROM (SELECT ", 1)[1].rsplit(" AS v))", 1)[0]


def _elements(tag: str) -> str:
    return rf"regexp_extract_all(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)"


def _first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


_CARDS = f"cards AS (SELECT page_id, url, {CARD_SQL} AS html FROM pages), seen AS (SELECT *, {_visible('html')} AS text FROM cards)"
_REVIEWS = rf"regexp_replace(coalesce({_first('lower(text)', r'(\d[\d.,]*)\s*đánh\s*giá')}, {_first('lower(text)', r'(\d[\d.,]*)\s*reviews?')}), '[.,]', '', 'g')"
_NUMBERS = r"list_transform(regexp_extract_all(text, '(\d{1,3}(?:[.,]\d{3})+)', 1), lambda x: regexp_replace(x, '[.,]', '', 'g')::bigint)"


def _marked(kind: str) -> str:
    found = rf"regexp_extract(html, '(?is)<(?:div|span|a)\b[^>]*data-testid=\"{kind}\"[^>]*>(.*?)</(?:div|span|a)>', 1)".replace('\\"', '"')
    return f"nullif({_visible(found)}, '')"


def _ordered(items: str) -> str:
    """Distinct in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_AMENITIES = _ordered(f"list_filter(list_transform({_elements('li')}, lambda y: {_shown('y')}), lambda z: z <> '')")


def _last(word: str) -> str:
    return f"coalesce(list_filter(items, lambda x: contains(lower(x), '{word}'))[-1], '')"


@query("H1 H3 H5 H6 H7 H8 H9 H11", rf"""
    WITH {_CARDS}, listed AS (SELECT *, {_AMENITIES} AS items, {_NUMBERS} AS numbers, {_marked('review-score')} AS graded, replace({_first('lower(text)', r'(?:location|địa điểm)\D{0,20}(\d{1,2}(?:[.,]\d)?)')}, ',', '.')::double AS place FROM seen)
    SELECT page_id, {_visible(f"coalesce({_elements('h1')}[1], '')")} AS name, {_REVIEWS} AS reviews, {_first('text', r'(-\s?\d{1,3}%)')} AS discount, array_to_string(regexp_extract_all(text, '(\d{{1,3}}(?:[.,]\d{{3}})+\s*₫)', 1), ';') AS prices,
    array_to_string(items, ' | ') AS amenities, substr(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2 AND NOT regexp_matches(lower(x), '{"|".join(pages.NOISE)}')), ', '), 1, 500) AS lines,
    coalesce({_first('html', r'(?is)data-testid="rating-(?:stars|squares)"[^>]*aria-label="(\d+)')}::double, nullif(len(regexp_extract_all(html, '(?i)<svg')) / 2, 0)) AS stars, list_max(numbers) AS original, list_min(numbers) AS final,
    try_cast(coalesce({_REVIEWS}, {_first('text', r'\((\d+)\)')}) AS bigint) AS card_reviews, replace({_first('graded', r'(\d{1,2}(?:[.,]\d)?)')}, ',', '.')::double AS score, nullif(trim(regexp_replace(graded, '[\d.,]+', '', 'g')), '') AS rating_text, {_marked('address')} AS address,
    CASE WHEN place <= 10 THEN place END AS location_score, CASE WHEN regexp_matches(lower(text), 'free cancellation|hủy miễn phí') THEN 'Yes' ELSE 'No' END AS free_cancel, CASE WHEN regexp_matches(lower(text), 'breakfast included|bao bữa sáng') THEN 'Yes' ELSE 'No' END AS breakfast,
    {_last('m²')} AS area, {_last('hướng')} AS view, {_last('giường')} AS bed, {_first('text', r'(\d+)')} AS occupancy FROM listed""", rooms=False)  # fmt: skip
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, text = F.col("html"), F.col("text")
    p = _cards(spark, sf_dir).withColumn("amenities", pages.amenities(html))
    p = p.withColumns({"card": pages.card_fields(html, text), "room": pages.room_attributes(F.split("amenities", r" \| "), text)})
    return p.select(
        "page_id", pages.name(html).alias("name"), pages.reviews(text).alias("reviews"), pages.discount(text).alias("discount"), F.array_join(pages.list_prices(text), ";").alias("prices"), "amenities",
        pages.facility_lines(F.regexp_replace(html, "<[^>]*>", "\n")).alias("lines"), "card.*", "room.area", "room.view", "room.bed", "room.occupancy",
    )


_SPANS = f"list_transform({_elements('span')}, lambda y: {_shown('y')})"
_RANK = "(contains(x, ',')::int + contains(lower(x), 'việt nam')::int + (contains(lower(x), 'hồ chí minh') OR contains(lower(x), 'ho chi minh'))::int) * 2 + least(length(x) / 50, 2.0)"


@query("H2 H4", rf"""
    WITH {_CARDS}, s AS (SELECT page_id, text, {_SPANS} AS texts, list_transform({_elements('span')}, lambda y: regexp_matches(y, '(?i)<svg')) AS icons FROM seen),
    g AS (SELECT *, list_filter(texts, lambda x, i: regexp_matches(x, '^\d{{1,2}}([.,]\d+)?$') AND try_cast(replace(x, ',', '.') AS double) <= 10) AS good, list_filter(texts, lambda x, i: icons[i] AND regexp_matches(x, '^\d{{1,2}}([.,]\d+)?$') AND try_cast(replace(x, ',', '.') AS double) <= 10) AS marked FROM s)
    SELECT page_id, coalesce(marked[1], good[1]) AS rating, coalesce(list_reverse_sort(list_transform(list_filter(texts, lambda x: length(x) >= 8), lambda x, i: {{'score': {_RANK}, 'turn': -i, 'text': x}}))[1].text, {_first('text', r'(?i)([^\n]{10,200}việt nam[^\n]{0,50})')}) AS address FROM g""", rooms=False)  # fmt: skip
def page_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("page_id", pages.rating(F.col("html")).alias("rating"), pages.address(F.col("html"), F.col("text")).alias("address"))


@query("H10 U5 F8", r"""
    WITH a AS (SELECT unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']+)["'']', 1)) AS href FROM pages), l AS (SELECT DISTINCT regexp_replace(CASE WHEN starts_with(href, '/') THEN 'https://stay.example' || href ELSE href END, '#.*', '') AS link FROM a)
    SELECT link FROM l WHERE regexp_matches(link, '^https?://stay\.example/[^?]+') AND NOT regexp_matches(link, '[\s<>"{}|\\^`%\[\]]')""", rooms=False)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(readers.table(spark, sf_dir, "pages"), "html", "https://stay.example", "stay.example", "^/.+")


_CITY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in classify.CITIES) + " END"


@query("C12 H12", f"""
    WITH {_CARDS}, open AS (SELECT * FROM seen WHERE NOT contains(lower(html), 'không còn phòng')), found AS (SELECT url, min({_CITY}) AS city FROM open GROUP BY 1)
    SELECT page_id, open.url AS link, coalesce(CASE WHEN page_id % 9 = 0 THEN 'Huế' END, city, 'Unknown') AS location FROM open LEFT JOIN found ON open.url = found.url""", rooms=False)
def located_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages.with_rooms(_cards(spark, sf_dir), "html", "không còn phòng")
    listings = p.select("page_id", F.col("url").alias("link"), F.when(F.col("page_id") % 9 == 0, F.lit("Huế")).otherwise(F.lit("Unknown")).alias("location"))
    return pages.fill_location(listings, p, "link", "url", "html", "location").select("page_id", "link", "location")
