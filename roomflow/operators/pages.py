"""Fields of stored pages (H1-H12) from HTML text, by native regular expressions.

They are not a DOM: an element ends at its first closing tag of the same name, which is enough for spans, headings, links and cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflow.functions.parse import first_match, strip, tidy
from roomflow.operators.conform import detail_link

#: Words that mark a line of a room dialog as no facility (H7).
NOISE = (
    "đóng", "close", "bắt đầu nội dung", "start of dialog", "kết thúc nội dung", "end of dialog", "hộp thoại", "mô tả", "description",
    "diện tích", "kích thước phòng", "room size", "trong phòng tắm riêng của bạn", "tầm nhìn", "hướng nhìn", "views",
)
PRICE = r"(\d{1,3}(?:[.,]\d{3})+\s*₫)"


def visible(html: Column) -> Column:
    """The text without scripts, styles, comments and tags; common entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return tidy(text)


def elements(html: Column, tag: str) -> Column:
    """Inner HTML of all elements of a kind, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def name(html: Column) -> Column:
    """H1: the first h1."""
    return visible(F.coalesce(F.get(elements(html, "h1"), F.lit(0)), F.lit("")))


def rating(html: Column) -> Column:
    """H2: the first span that is a number from 0 to 10 with an icon in it, else the first such number."""
    spans = F.transform(elements(html, "span"), lambda s: F.struct(visible(s).alias("text"), s.rlike("(?i)<svg").alias("icon")))
    good = F.filter(spans, lambda s: s["text"].rlike(r"^\d{1,2}([.,]\d+)?$") & (F.replace(s["text"], F.lit(","), F.lit(".")).try_cast("double") <= 10))
    marked = F.filter(good, lambda s: s["icon"])
    return F.coalesce(F.get(marked, F.lit(0))["text"], F.get(good, F.lit(0))["text"])


def reviews(text: Column) -> Column:
    """H3: the number before 'đánh giá', else before 'reviews', without separators; from the visible text."""
    text = F.lower(text)
    found = F.coalesce(first_match(text, r"(\d[\d.,]*)\s*đánh\s*giá"), first_match(text, r"(\d[\d.,]*)\s*reviews?"))
    return F.regexp_replace(found, "[.,]", "")


def address(html: Column, text: Column) -> Column:
    """H4: the best of the spans of 8 characters or more (comma, country and city 2 each, length up to 2), else the text around the country."""
    def rank(t: Column) -> Column:
        low = F.lower(t)
        return (t.contains(",").cast("int") + low.contains("việt nam").cast("int") + (low.contains("hồ chí minh") | low.contains("ho chi minh")).cast("int")) * 2 + F.least(F.length(t) / 50, F.lit(2.0))

    texts = F.filter(F.transform(elements(html, "span"), visible), lambda t: F.length(t) >= 8)
    ranked = F.transform(texts, lambda t, i: F.struct(rank(t).alias("score"), (-i).alias("turn"), t.alias("text")))
    return F.coalesce(F.array_max(ranked)["text"], first_match(text, r"(?i)([^\n]{10,200}việt nam[^\n]{0,50})"))


def discount(text: Column) -> Column:
    """H5: like -18%, in the visible text."""
    return first_match(text, r"(-\s?\d{1,3}%)")


def list_prices(text: Column) -> Column:
    """H5: all prices with the dong sign in the visible text, in order."""
    return F.regexp_extract_all(text, F.lit(PRICE), F.lit(1))


def amenities(html: Column, element: str = "li") -> Column:
    """H6: texts of the list's elements, distinct in order, joined by ' | '."""
    return F.array_join(F.array_distinct(F.filter(F.transform(elements(html, element), visible), lambda t: t != "")), " | ")


def facility_lines(text: Column, most: int = 500) -> Column:
    """H7: lines without noise words, joined, at most ``most`` characters (a rule of the field)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: (F.length(line) >= 2) & ~F.lower(line).rlike("|".join(NOISE)))
    return F.substring(F.array_join(lines, ", "), 1, most)


def stars(card: Column) -> Column:
    """The number at the start of the rating's label, else half its icons."""
    labelled = first_match(card, r'(?is)data-testid="rating-(?:stars|squares)"[^>]*aria-label="(\d+)').cast("double")
    icons = F.regexp_count(card, F.lit("(?i)<svg")) / 2
    return F.coalesce(labelled, F.nullif(icons, F.lit(0.0)))


def card_fields(html: Column, text: Column) -> Column:
    """Fields of a listing card, from its html and visible text.

    Stars, original and final price (largest and smallest), review count (before the words, else in brackets), score with its word and
    address (both from marked elements), location score, badge words.
    """
    marked = lambda kind: F.nullif(visible(F.regexp_extract(html, rf'(?is)<(?:div|span|a)\b[^>]*data-testid="{kind}"[^>]*>(.*?)</(?:div|span|a)>', 1)), F.lit(""))
    graded = marked("review-score")
    low = F.lower(text)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:[.,]\d{3})+)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]", "").cast("long"))
    place = first_match(low, r"(?:location|địa điểm)\D{0,20}(\d{1,2}(?:[.,]\d)?)")
    place = F.replace(place, F.lit(","), F.lit(".")).cast("double")
    return F.struct(
        stars(html).alias("stars"), F.array_max(numbers).alias("original"), F.array_min(numbers).alias("final"), F.coalesce(reviews(text), first_match(text, r"\((\d+)\)")).try_cast("long").alias("card_reviews"),
        F.replace(first_match(graded, r"(\d{1,2}(?:[.,]\d)?)"), F.lit(","), F.lit(".")).cast("double").alias("score"), F.nullif(strip(F.regexp_replace(graded, r"[\d.,]+", "")), F.lit("")).alias("rating_text"),
        marked("address").alias("address"),
        F.when(place <= 10, place).alias("location_score"), F.when(low.rlike("free cancellation|hủy miễn phí"), F.lit("Yes")).otherwise(F.lit("No")).alias("free_cancel"),
        F.when(low.rlike("breakfast included|bao bữa sáng"), F.lit("Yes")).otherwise(F.lit("No")).alias("breakfast"),
    )


def room_attributes(items: Column, pax: Column) -> Column:
    """H9: area, view and bed by keyword (the last hit wins), first integer as occupancy, all items joined by '; '."""
    last = lambda word: F.coalesce(F.try_element_at(F.filter(items, lambda x: F.lower(x).contains(word)), F.lit(-1)), F.lit(""))
    return F.struct(last("m²").alias("area"), last("hướng").alias("view"), last("giường").alias("bed"), first_match(pax, r"(\d+)").alias("occupancy"), F.array_join(items, "; ").alias("amenities"))


def links(pages: DataFrame, html: str, base: str, host: str, path: str) -> DataFrame:
    """Distinct sorted detail links of all pages, without fragments; relative ones get the base."""
    href = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["']"""), F.lit(1))).alias("href"))
    full = href.select(F.regexp_replace(F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href")), "#.*", "").alias("link"))
    return full.where(detail_link(F.col("link"), host, path)).distinct().orderBy("link")


def with_rooms(pages: DataFrame, html: str, phrase: str) -> DataFrame:
    """Pages without the phrase that says there are no rooms."""
    return pages.where(~F.coalesce(F.lower(html).contains(phrase.lower()), F.lit(False)))


def fill_location(listings: DataFrame, pages: DataFrame, link: str, url: str, html: str, location: str) -> DataFrame:
    """An unknown location is looked for in the text of the listing's page.

    A page's text is made once, in a step of its own, and asked for every word; a filter on the city goes after the aggregation, since one
    before it would be pushed down to the html with the making of the text in it, once for each word.
    """
    from roomflow.functions.classify import city

    seen = pages.select(F.col(url).alias(link), F.lower(visible(F.col(html))).alias("__low"))
    found = seen.select(link, city(F.col("__low"), True).alias("__found")).groupBy(link).agg(F.min("__found").alias("__found")).where("__found IS NOT NULL")
    known = F.when(F.col(location) != "Unknown", F.col(location))
    return listings.join(found, link, "left").withColumn(location, F.coalesce(known, "__found", F.lit("Unknown"))).drop("__found")
