"""The job's pipelines: raw rooms to balanced rooms, rooms to features, rooms to exports.

Tables that several steps read are written once to the shared folder while a pipeline is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflow.functions import classify, parse
from roomflow.operators import conform, features, profile, quality, rows
from roomflow.sources.places import stored


KEYS = ("hotel_name", "room_class", "price", "area", "people")
FEATURES = ("room_type", "bed_type", "facilities")


def clean_rooms(raw: DataFrame, *columns: str) -> DataFrame:
    """Text and numbers read, classes set; rows without price, area or people and repeated rooms go.

    With ``columns``, only the keys, the row id and those columns (of the source, ``level`` or ``bed_class``) travel through the
    de-duplication; without, all.
    """
    parsed = conform.computed(raw.withColumns({"level": classify.room_level(F.col("room_type")), "bed_class": classify.bed_family(F.col("bed_type"))}), {
        "price": parse.price_digits(F.col("price_raw")).cast("double"),
        "area": parse.area_comma(F.col("area_raw")),
        "people": parse.people(F.col("people_raw")),
    })
    whole = conform.complete(parsed, ["price", "area", "people"])
    if columns:
        whole = whole.select(*dict.fromkeys((*KEYS, "row_id", *columns)))
    return rows.keep_first(whole, list(KEYS), ["row_id"])


def profile_rooms(raw: DataFrame) -> DataFrame:
    """The minimum slice: price and area profile per class after cleaning, de-duplication and outlier removal."""
    trimmed = quality.drop_outliers(clean_rooms(raw, "row_id"), "price", "room_class", factor=0.8)
    return profile.class_profile(trimmed, "room_class", "price", "area")


def balanced_rooms(raw: DataFrame, seed: int = 42) -> DataFrame:
    """Steps 1-5: conform and clean, drop unknown places and large areas, remove outliers, balance with modelled numbers, remove loose outliers.

    Rows without price, area or people are gone after cleaning, so there is nothing left to fill. The raw rows are read once; each outlier
    pass reads the table stored before it twice, once for the bounds.
    """
    cleaned = conform.with_reject_reason(clean_rooms(raw, "location", *FEATURES), "location", "area").where("reject_reason IS NULL").drop("reject_reason")
    sized = quality.drop_outliers(stored(cleaned, "cleaned"), "area")
    strict = quality.drop_outliers(stored(sized, "sized"), "price", "room_class")
    balanced = quality.balance(strict, "room_class", "row_id", ["price", "area", "people"], seed=seed, copula=True)
    return quality.drop_outliers(stored(balanced, "balanced"), "price", "room_class", factor=1.5)


def scaled_features(raw: DataFrame) -> DataFrame:
    """Features, scaled and encoded, with their split."""
    table = features.feature_table(clean_rooms(raw, *FEATURES), "room_type", "bed_type", "facilities", "price", "area", "people", "room_class")
    numbers = ["price", "people", "area", "price_per_m2", "m2_per_person", "num_facilities"]
    table = stored(table, "features")  # read for ranges, labels, counts and rows
    scaled = features.scale(table, features.fit_ranges(table, numbers), numbers)
    encoded = features.encode(scaled, features.fit_labels(table, "room_class"), "room_class")
    return quality.stratified_split(encoded, "room_class", "row_id")


def nested_hotels(rooms: DataFrame) -> DataFrame:
    """Hotels with their rooms; rooms are numbered within the hotel by the order of their id."""
    first = {"district": F.col("location"), "rating": parse.zero_int(F.col("people"))}
    room = {"room_id": F.col("row_id"), "type": F.col("room_type"), "class": F.col("room_class"), "area": F.col("area"), "price": F.coalesce(F.col("price").cast("long"), F.lit(0)), "amenities": F.coalesce("facilities", "badge")}
    return profile.nested(rooms, ["hotel_name", "location"], first, room, "row_id")
