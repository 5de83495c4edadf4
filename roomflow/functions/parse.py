"""Scalar cleaning and parsing (N1-N28). All are native column expressions; text in, null for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("nan", "None", "N/A", "")
#: The characters of Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Unicode strip; Spark's trim leaves no-break spaces unless it is told of them. It looks at the ends only, a pattern at each character."""
    return F.trim(c, F.lit(WHITE))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null instead of '' where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def tidy(c: Column) -> Column:
    """Strip, collapse white space, spellings of missing to ''."""
    text = strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _SPACE, " "))
    return F.regexp_replace(text, rf"^(?:{'|'.join(MISSING)})\z", "")  # names the text once: what it is made by may be long


def lower_strip(c: Column) -> Column:
    """N2."""
    return strip(F.lower(c))


def number(c: Column, default: float | None = None) -> Column:
    """N3 (with a default) and N4: numeric coercion; NaN counts as missing.

    A text without a digit is no number but an infinity; a cast that fails costs many times one that doesn't, so it isn't tried there.
    """
    n = F.when(c.cast("string").rlike("[0-9]|(?i)inf"), c.try_cast("double"))
    n = F.when(~F.isnan(n), n)
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def score(c: Column) -> Column:
    """Decimal comma or point; spellings of missing are null."""
    text = strip(c.cast("string"))
    return F.when(~text.isin(*MISSING), number(F.replace(text, F.lit(","), F.lit("."))))


def distance_km(c: Column) -> Column:
    """The first number; in metres when an m but no km stands in the text."""
    text = F.replace(F.lower(c.cast("string")), F.lit(","), F.lit("."))
    n = first_match(text, r"(\d+(\.\d+)?)").cast("double")
    metres = ~text.contains("km") & text.contains("m")
    return F.when(~c.cast("string").isin("N/A", "nan", ""), F.when(metres, n / 1000).otherwise(n))


def price_digits(c: Column) -> Column:
    """N7a for text: all digits as one number, null unless positive."""
    n = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.when(n > 0, n)


def price_numeric(c: Column) -> Column:
    """N7a for numbers: truncated; zero stays zero."""
    return F.when(~F.isnan(c.cast("double")), c.cast("bigint"))


def price_digits_or_zero(c: Column) -> Column:
    """Digits of the text form; zero is allowed."""
    return F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("bigint")


def price_first_run(c: Column) -> Column:
    """Separators and the dong sign go; the first run of digits."""
    return first_match(F.translate(c, ",.₫", ""), r"([0-9]+)").cast("double")


def price_plain(c: Column) -> Column:
    """N7d: dots go; a number only if nothing but digits is left."""
    text = F.replace(c, F.lit("."), F.lit(""))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def area_first(c: Column) -> Column:
    """The first decimal number; a comma ends it."""
    return first_match(c, r"(\d+(\.\d+)?)").cast("double")


def _unit_off(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), "m²|m2", ""), F.lit(","), F.lit("."))


def area_comma(c: Column) -> Column:
    """Unit off, decimal comma, first decimal number."""
    return first_match(_unit_off(c), r"(\d+(\.\d+)?)").cast("double")


def area_integer(c: Column) -> Column:
    """The first integer."""
    return first_match(c, r"(\d+)").try_cast("bigint")


def area_whole(c: Column) -> Column:
    """N8d: unit off, then the whole text must be a number; a decimal comma makes it none."""
    text = strip(F.regexp_replace(F.lower(c), "m²|m2", ""))
    return F.when(~text.rlike("[df]$"), number(text))  # Java reads such endings as number kinds


def area_with_unit(c: Column) -> Column:
    """N8e: an integer only before m² or m2."""
    return first_match(c, r"(?i)(\d+)\s*(m²|m2)").try_cast("bigint")


def people(c: Column) -> Column:
    """The first integer of a text."""
    return first_match(c.cast("string"), r"(\d+)").try_cast("int")


def facility_list(c: Column) -> Column:
    """Comma list, trimmed, lower-cased, without empties, order kept."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: strip(F.lower(x))), lambda x: x != "")
    return F.when(~c.isin("N/A"), F.nullif(F.array_join(items, ", "), F.lit("")))


def flag_loose(c: Column) -> Column:
    """Yes, có or 1 anywhere in the text (so 'không có' is 1 as well)."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return contains_any(text, ("yes", "có", "1")).cast("int")


def flag_co(c: Column) -> Column:
    """Null stays null; 1 when the text has có."""
    return F.lower(c).contains("có").cast("int")


def flag_exact(c: Column) -> Column:
    """Yes is true, all else false."""
    return F.coalesce(c == "Yes", F.lit(False))


def badge(c: Column) -> Column:
    """N14."""
    return F.when(c.isin("None", "N/A", "", "0"), F.lit("No Deal")).otherwise(c)


def integer(c: Column, default: int) -> Column:
    """N15. The cast, slow where it fails, is not tried on texts with characters that no whole number has."""
    return F.coalesce(F.when(~c.rlike(r"[^\x00-\x20\x7f0-9+.\-]"), c.try_cast("int")), F.lit(default))


def repair_original(original: Column, final: Column) -> Column:
    """An original price below the final one becomes the final one."""
    return F.when(original < final, final).otherwise(original)


def swap_prices(original: Column, final: Column) -> tuple[Column, Column]:
    """N16, the older rule: the two are swapped where 0 < original < final."""
    swap = (original > 0) & (original < final)
    return F.when(swap, final).otherwise(original), F.when(swap, original).otherwise(final)


def discount_percent(original: Column, final: Column) -> Column:
    """Percent off, 0 to 100, one decimal, half to even; 0 where it can't be told."""
    share = F.coalesce(F.try_divide(original - final, original) * 100, F.lit(0.0))
    return F.bround(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)), 1)


def discount_text(original: Column, final: Column) -> Column:
    """Like '12.3%'; '0.0%' where original is 0."""
    return F.when(original == 0, F.lit("0.0%")).otherwise(F.format_string("%.1f%%", (original - final) / original * 100))


def discounted_price(listed: Column, percent: Column) -> Column:
    """List price after a discount in percent, as dotted digits and the dong sign."""
    value = F.floor(listed * (100 - percent) / 100).cast("bigint")
    return F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(".")), F.lit(" ₫"))


def date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """N20."""
    return F.try_to_date(c, pattern)


def timestamp(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Strict; a bad value raises."""
    return F.to_timestamp(c, pattern)


def zero_int(c: Column) -> Column:
    """N22."""
    return F.coalesce(c.cast("int"), F.lit(0))


def unknown(c: Column) -> Column:
    """N23."""
    return F.coalesce(c, F.lit("Unknown"))


def join_facilities(a: Column, b: Column) -> Column:
    """N25."""
    return F.concat(F.coalesce(a, F.lit("")), F.lit(" | "), F.coalesce(b, F.lit("")))


def first_part(address: Column) -> Column:
    """N26."""
    return F.split_part(address, F.lit(","), F.lit(1))


def log_price(c: Column) -> Column:
    """N27; its inverse is F.expm1."""
    return F.log1p(c)


def review_count(c: Column) -> Column:
    """Dots go; the number before 'reviews' or 'đánh giá'."""
    return first_match(F.replace(F.lower(c), F.lit("."), F.lit("")), r"(\d+)\s*(?:reviews?|đánh giá)").try_cast("int")
