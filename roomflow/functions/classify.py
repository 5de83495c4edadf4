"""Keyword classification (C1-C11, C13, C14, E1, E2, E5). The tables are ordered; the first match wins where one wins."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomflow.functions.parse import contains_any, first_match

#: Keyword to tag, for beds and for rooms.
BED_TAGS = {
    "double": "Double", "đôi": "Double", "king": "King", "queen": "Queen", "large": "Large", "lớn": "Large",
    "single": "Single", "đơn": "Single", "twin": "Twin", "bunk": "Bunk", "tầng": "Bunk", "tập thể": "Bunk",
    "sofa": "Sofa", "futon": "Futon",
}
ROOM_TAGS = {
    "president": "Presidential", "tổng thống": "Presidential", "suite": "Suite", "penthouse": "Penthouse", "villa": "Villa",
    "biệt thự": "Villa", "bungalow": "Bungalow", "family": "Family", "gia đình": "Family", "connecting": "Connecting",
    "triple": "Triple", "3 người": "Triple", "quadruple": "Quadruple", "4 người": "Quadruple", "luxury": "Luxury",
    "business": "Business", "executive": "Executive", "deluxe": "Deluxe", "grand": "Grand", "apartment": "Apartment",
    "căn hộ": "Apartment", "studio": "Studio", "condo": "Condo", "standard": "Standard", "tiêu chuẩn": "Standard",
    "superior": "Superior", "classic": "Classic", "economy": "Economy", "budget": "Budget", "dorm": "Dorm", "kén": "Capsule",
    "capsule": "Capsule",
}
#: Room levels with their keywords, highest first.
LEVELS = (
    ("Luxury", ("villa", "bungalow", "biệt thự", "luxury", "vip", "royal", "president")),
    ("Suite", ("suite", "penthouse", "apartment", "căn hộ", "studio")),
    ("Executive", ("executive", "doanh nhân")),
    ("Deluxe", ("deluxe", "cao cấp")),
    ("Superior", ("superior",)),
)
#: Whole words, highest first.
WORD_LEVELS = ("Luxury", "Grand", "Executive", "Suite", "Deluxe", "Superior", "Standard", "Classic")
#: Room families after the apartments.
FAMILIES = (
    ("Suite", ("suite", "penthouse")),
    ("Family Room", ("family", "gia đình")),
    ("Deluxe Room", ("deluxe",)),
    ("Executive Room", ("executive",)),
    ("Superior Room", ("superior",)),
    ("Standard Room", ("standard", "tiêu chuẩn")),
    ("Economy Room", ("economy", "budget", "bình dân")),
    ("Luxury Room", ("luxury", "vip", "royal")),
    ("Standard Room", ("room", "phòng")),
)
#: Bed families with their keywords (C4; C7 and C9 differ in names and keywords of the fourth).
BEDS = (
    ("King", ("king",)), ("Queen", ("queen",)), ("Double", ("double", "đôi")), ("Single", ("single", "đơn", "twin")),
    ("Bunk", ("bunk", "tầng")), ("Sofa Bed", ("sofa",)),
)
#: Cities by keyword, first match wins (C11).
CITIES = (
    ("Hồ Chí Minh", ("hồ chí minh", "ho chi minh", "hcm", "sai gon", "quận 1", "quận 3", "thành phố hồ chí minh")),
    ("Vũng Tàu", ("vũng tàu", "vung tau", "bà rịa", "ba ria", "xuyên mộc", "long hải", "hồ tràm")),
    ("Bình Dương", ("bình dương", "binh duong", "thủ dầu một", "dĩ an", "thuận an")),
)
#: Where no administrative unit is named.
DISTRICT_WORDS = (
    ("TP. Vũng Tàu", ("vũng tàu", "vung tau")), ("Bình Dương", ("bình dương", "binh duong")),
    ("TP. Đà Lạt", ("đà lạt", "da lat")), ("TP. Hồ Chí Minh", ("hồ chí minh", "tphcm")),
)
#: Fixed value: a place's name, and the pattern of administrative units.
_NAME = r"[a-zà-ỹ]+(?:\s+[a-zà-ỹ]+)*"
DISTRICT = rf"(quận\s+\d+|quận\s+{_NAME}|district\s+\d+|tp\.\s+{_NAME}|thành\s+phố\s+{_NAME}|thị\s+xã\s+{_NAME}|huyện\s+{_NAME}|phường\s+\d+|phường\s+{_NAME})"
#: Scores of room classes; 2 otherwise.
ROOM_SCORES = {
    "Presidential": 10, "Penthouse": 9, "Villa": 8, "Resort": 7, "Bungalow": 6, "Suite": 6, "Luxury": 5, "Grand": 5, "Executive": 5,
    "Apartment": 4, "Studio": 4, "Apartment & Studio": 4, "Deluxe": 4, "Superior": 3, "Classic": 3, "Family": 3, "Connecting": 3,
    "Triple": 3, "Quadruple": 3, "Standard": 2, "Economy": 1, "Dorm": 0, "Capsule": 0, "Other": 2,
}
#: Patterns of bed flags (E1), facility flags (E2) and luxury words (E5).
BED_FLAGS = {"is_king": "king", "is_queen": "queen", "is_double": "double|đôi", "is_single": "single|đơn", "is_bunk": "bunk|giường tầng", "is_sofa": "sofa"}
FACILITY_FLAGS = {
    "has_wifi": "wifi|internet|mạng", "has_ac": "điều hòa|máy lạnh|air conditioning|ac", "has_breakfast": "ăn sáng|breakfast",
    "has_tv": "tv|tivi|television", "has_pool": "hồ bơi|bể bơi|swimming pool|pool", "has_balcony": "ban công|balcony|view",
    "has_parking": "đỗ xe|bãi đậu xe|parking", "has_kitchen": "bếp|kitchen|lò vi sóng|microwave",
    "has_fridge": "tủ lạnh|refrigerator|fridge|minibar",
}
LUXURY_WORDS = "deluxe|superior|suite|premium|luxury|executive"


def _low(c: Column, lowered: bool) -> Column:
    """The text in lower case. Rules ask it many times, so one that several rules read is best lowered once, in a select before theirs."""
    return c if lowered else F.lower(c)


def first_of(text: Column, table, default: Column) -> Column:
    out = default
    for name, words in reversed(table):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def tags(c: Column, table: dict[str, str], lowered: bool = False) -> Column:
    """All tags whose keyword is in the text, sorted and joined by ' & '."""
    text = _low(c, lowered)
    hits = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.contains(k), F.lit(t)) for k, t in table.items()]))))
    none = F.when(contains_any(text, ("phòng", "room")), F.lit("Standard")).otherwise(F.lit("Other"))
    known = F.when(F.size(hits) > 0, F.array_join(hits, " & ")).otherwise(none)
    return F.when(F.coalesce(text, F.lit("")).isin("nan", "none", "", "n/a"), F.lit("Unknown")).otherwise(known)


def district(address: Column, search_location: Column) -> Column:
    """The leftmost administrative unit, else a city word, else the searched place, else Other."""
    text = F.lower(address)
    place = F.initcap(search_location)
    place = F.when(F.coalesce(place, F.lit("")).isin("Nan", "None", "", "N/A"), F.lit("Other")).otherwise(place)
    return F.coalesce(F.initcap(first_match(text, DISTRICT)), first_of(text, DISTRICT_WORDS, place))


def room_level(c: Column, lowered: bool = False) -> Column:
    """C3."""
    return F.coalesce(first_of(_low(c, lowered), LEVELS, F.lit("Standard")), F.lit("Standard"))


def room_level_words(c: Column) -> Column:
    """Whole words, so 'Grandview' isn't Grand."""
    out = F.lit("Standard")
    for name in reversed(WORD_LEVELS):
        out = F.when(c.rlike(rf"(?iU)\b{name}\b"), F.lit(name)).otherwise(out)
    out = F.when(c.rlike(rf"(?iU)\b(?:{'|'.join(WORD_LEVELS)})\b"), out).otherwise(F.lit("Standard"))  # most texts have none
    return F.when(F.lower(F.coalesce(F.trim(c), F.lit(""))).isin("nan", "(blanks)", ""), F.lit("Unknown")).otherwise(out)


def room_family(c: Column, lowered: bool = False) -> Column:
    """Fifteen families; apartments split by studio and bedrooms."""
    text = _low(c, lowered)
    flat = F.when(text.contains("studio"), F.lit("Studio")).when(contains_any(text, ("1 bedroom", "1 phòng ngủ")), F.lit("Apartment 1BR")).when(contains_any(text, ("2 bedroom", "2 phòng ngủ")), F.lit("Apartment 2BR")).otherwise(F.lit("Apartment"))
    out = (
        F.when(contains_any(text, ("dorm", "hostel", "tập thể")), F.lit("Dormitory"))
        .when(contains_any(text, ("villa", "bungalow", "biệt thự")), F.lit("Villa/Bungalow"))
        .when(contains_any(text, ("apartment", "căn hộ")), flat)
        .otherwise(first_of(text, FAMILIES, F.lit("Unknown")))
    )
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(out)


def _one_bed(text: Column, table, several: str) -> Column:
    hits = F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in table]))
    return F.when(F.size(hits) == 1, hits[0]).when(F.size(hits) > 1, F.lit(several)).otherwise(F.lit("Unknown"))


def bed_family(c: Column, single: str = "Single", lowered: bool = False) -> Column:
    """C4; C7 names the fourth family 'Single/Twin'."""
    table = [(single if name == "Single" else name, words) for name, words in BEDS]
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(_one_bed(_low(c, lowered), table, "Mixed Beds"))


def bed_class(c: Column) -> Column:
    """From a tag text, by how often tags occur in it."""
    names = {"King": "King", "Queen": "Queen", "Double": "Double", "Single": "Single", "Twin": "Single", "Bunk": "Bunk", "Sofa": "Sofa Bed", "Futon": "Futon", "Large": "Large Double"}
    total = reduce(lambda a, b: a + b, [(F.length(c) - F.length(F.replace(c, F.lit(k), F.lit("")))) / len(k) for k in names])
    one = F.lit("Unknown")
    for k, name in reversed(names.items()):
        one = F.when(c.contains(k), F.lit(name)).otherwise(one)
    return F.when(c.isNull() | (c == "Standard") | (total == 0), F.lit("Unknown")).when(total == 1, one).otherwise(F.lit("Mixed"))


def bed_text(c: Column, lowered: bool = False) -> Column:
    """From free text; a dormitory wins. (Counts before a bed's name never add a family that the name itself doesn't.)"""
    text = _low(c, lowered)
    table = [(name, tuple(w for w in words if w != "twin")) for name, words in BEDS]
    return F.when(c.isNull(), F.lit("Unknown")).when(contains_any(text, ("tập thể", "dorm")), F.lit("Dormitory")).otherwise(_one_bed(text, table, "Mixed"))


def first_known(a: Column, b: Column) -> Column:
    """C10."""
    return F.coalesce(F.nullif(a, F.lit("Unknown")), F.nullif(b, F.lit("Unknown")), F.lit("Unknown"))


def city(c: Column, lowered: bool = False) -> Column:
    """C11: null where no city is named."""
    return first_of(_low(c, lowered), CITIES, F.lit(None).cast("string"))


def value_map(c: Column, table: dict, default) -> Column:
    """A dictionary lookup with a default."""
    return F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), c), F.lit(default))


def room_score(c: Column) -> Column:
    """C13."""
    return value_map(c, ROOM_SCORES, 2)


def row_origin(c: Column) -> Column:
    """C14."""
    return F.when(c.contains("AI"), F.lit("AI")).otherwise(F.lit("Real"))
