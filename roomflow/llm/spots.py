"""SpotSigs fingerprints: common-word anchors, each with the chain of content words after it; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflow.llm.common import Stage

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans de des du en est et la le les ne par pas pour que qui sur un une "
    "con del el es las los no por se su y"
).split()
CHAIN = 2
_ANCHOR = f"(?:{'|'.join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))})"
#: A run of anchors with the chain after it; possessive loops, so that a text of anchors alone is read once.
_SPOT = rf"(?<= )(?=((?:{_ANCHOR} )++(?:[^ ]++ (?:{_ANCHOR} )*+){{{CHAIN - 1}}}[^ ]++ ))(?:{_ANCHOR} )++"
_RUN, _INNER = f"^(?:{_ANCHOR} )++", f" (?:{_ANCHOR} )++"


def words_line(text: Column) -> Column:
    """Lower-cased words with one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_spots(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted distinct 32-bit hashes of a text's spot signatures.

    A signature is an anchor and the next two content words, whatever anchors are between them. A text without any signature has the
    hash of its whole line of words as its one element, or, without words, that of the text itself. Each step is a column of its own, so
    that no expression is computed twice.
    """
    lined = df.withColumn("__line", words_line(F.col(text)))
    found = lined.withColumn("__found", F.regexp_extract_all("__line", F.lit(_SPOT), F.lit(1)))
    found = found.withColumn("__parts", F.transform("__found", lambda m: F.struct(F.array_distinct(F.split(F.trim(F.regexp_extract(m, _RUN, 0)), " ")).alias("anchors"), F.regexp_replace(F.regexp_replace(m, _RUN, ""), _INNER, " ").alias("chain"))))
    found = found.withColumn("__hashes", F.flatten(F.transform("__parts", lambda p: F.transform(p["anchors"], lambda a: F.pmod(F.xxhash64(a, p["chain"]), F.lit(1 << 32))))))
    whole = F.when(F.trim("__line") == "", F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64("__line", F.lit(2)))
    spots = F.when(F.size("__found") > 0, F.array_sort(F.array_distinct("__hashes"))).otherwise(F.array(F.pmod(whole, F.lit(1 << 32))))
    return found.withColumn(out, spots).drop("__line", "__found", "__parts", "__hashes")


def as_text(spots: Column) -> Column:
    """A fingerprint as text: eight hex digits for each signature, in ascending order."""
    return F.array_join(F.transform(spots, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


_LOWEST = -(1 << 63)


def with_parts(rows: DataFrame, rows_in_part: int | None = None, first: int = 256) -> DataFrame:
    """Adds ``part``, which follows the order of (id, tie): ranges of about ``rows_in_part`` rows, however many ranges that makes.

    Quantiles of the ids cut up to ``first`` ranges, and quantiles within each of those cut finer ones. An id that fills several
    ranges alone is cut by its tie. ``rows_in_part`` is 1000, or the power 0.4 of all rows, if that is more. The cuts (one number for each
    range) are broadcast: 20 MB for 5 * 10**10 rows.
    """
    n = rows.count()
    each = rows_in_part or max(1000, int(n**0.4))
    outer = max(1, min(first, n // each))
    bounds = rows.agg(F.percentile_approx("id", [k / outer for k in range(1, outer)], 100 * first)).first()[0] if outer > 1 else []
    cut = F.array(*[F.lit(c) for c in sorted(set(bounds))]).cast("array<long>")
    coarse = rows.withColumn("__coarse", F.size(F.filter(cut, lambda c: c <= F.col("id"))).cast("long"))
    most = coarse.groupBy("__coarse").count().agg(F.max("count")).first()[0] or 0
    inner = -(-most // (2 * each))
    if inner <= 1:
        return coarse.withColumnRenamed("__coarse", "part")
    cuts = coarse.groupBy("__coarse").agg(F.percentile_approx("id", [k / inner for k in range(1, inner)], 100 * inner).alias("__cuts"))
    placed = coarse.join(F.broadcast(cuts), "__coarse")  # of the size that is stated above
    upto, same = F.size(F.filter("__cuts", lambda c: c <= F.col("id"))), F.size(F.filter("__cuts", lambda c: c == F.col("id")))
    alone = same > 1
    at = F.when(alone, 2 * (upto - same) + 1).otherwise(2 * upto).cast("long")
    spread = F.when(alone, F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * same), same - 1)).otherwise(0).cast("long")
    return placed.withColumn("part", F.shiftleft("__coarse", 48) + F.shiftleft(at, 24) + spread).drop("__coarse", "__cuts")


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_in_part: int | None = None) -> DataFrame:
    """Adds the spots of a text and of the row after, and ``next_text``; in descending order of id and a hash of the text; after the last comes the first.

    Texts are shuffled once, by ranges of ids; each range also gets the first row of the range after it. One row for each range (its
    head, without text) is broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = with_parts(rows.withColumns({"id": F.coalesce("doc_id", F.lit(_LOWEST)), "tie": F.xxhash64("text")}), rows_in_part)
    heads = placed.groupBy("part").agg(F.max(F.struct("id", "tie")).alias("head"))
    order = Window.orderBy("part")  # one row for each range
    heads = heads.select("part", F.coalesce(F.lag("head").over(order), F.last("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    heads = heads.select(F.col("part").alias("to"), F.col("head.tie").alias("tie"), F.col("head.id").alias("id"))
    guests = placed.join(F.broadcast(heads), ["tie", "id"]).dropDuplicates(["to"]).select("doc_id", "text", "id", "tie", F.col("to").alias("part"), F.lit(True).alias("guest"))
    within = Window.partitionBy("part").orderBy("guest", F.desc("id"), F.desc("tie"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests).repartition("part").withColumn("next_text", F.lead("text").over(within))
    return with_spots(both, "text", "spots").withColumn("next_spots", F.lead("spots").over(within)).where("NOT guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced from the next document), and their likeness.

    Null text counts as empty. Equal texts have equal fingerprints. Repeated ids are ordered by a hash of their text; null ids
    come last, in that order too. A single row is its own next. An empty table gives an empty result. Other columns are ignored. Long texts are
    used whole.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    rows = with_spots(rows, "edited", "edited_spots")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("spots")).alias("fingerprint"), as_text(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, stage: Stage, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Near fingerprints: pairs (a, b, likeness) of representatives with likeness of at least ``least``, and members (id, representative).

    Equal fingerprints share one representative, the smallest id, so copies make no pairs. Sets are partitioned by length so that only
    lengths within a factor ``least`` meet; an element's rank by rarity prunes: a pair must share one of the rarest elements of both
    (prefix filter), and is then compared in full. The holders of a common element meet in blocks of at most ``block`` by ``block``, each
    in a task of its own. All pairs are returned, so a family of n different near texts has up to n * (n - 1) / 2 of them; callers who only
    need groups use the set join. Null ids are passed over; a null text counts as empty; an empty table gives empty results.
    """
    sets = with_spots(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL"), "text", "spots").select("id", "spots")
    sets = stage.write(sets, "spots")
    reps = stage.write(sets.groupBy("spots").agg(F.min("id").alias("rep")).withColumn("n", F.size("spots")).withColumn("key", F.monotonically_increasing_id()), "sets")
    members = sets.join(reps, "spots").select("id", F.col("rep").alias("representative"))
    counts = stage.write(reps.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("held")).where("held > 1"), "counts")
    ranked = reps.select("key", "n", F.explode("spots").alias("spot")).join(counts, "spot", "left")
    rarest = ranked.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "spot"))).alias("order"))  # a document's own elements
    prefix = rarest.select("key", "n", F.explode(F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)).alias("e")).where("e.held > 1")
    width = F.floor(F.log("n") / -math.log(least)).cast("int")  # lengths within a factor ``least`` are in this range or the next
    dealt = prefix.select("key", "n", F.col("e.spot").alias("spot"), width.alias("width"), F.ceil(F.col("e.held") / block).cast("int").alias("blocks"))
    dealt = stage.write(dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "prefix")
    lower = dealt.select(F.col("key").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array("width", F.col("width") + 1)).alias("width"), F.col("own").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    upper = dealt.select(F.col("key").alias("b"), F.col("n").alias("nb"), "spot", "width", F.col("own").alias("with"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    near = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = lower.join(upper, ["spot", "width", "at", "with"]).where(near).select("a", "b").distinct()
    full = pairs.join(reps.select(F.col("key").alias("a"), F.col("rep").alias("ra"), F.col("spots").alias("x")), "a").join(reps.select(F.col("key").alias("b"), F.col("rep").alias("rb"), F.col("spots").alias("y")), "b")
    return full.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= least), members
