"""Host and path rules over urls as a sort-merge range join with a sorted sweep; DataFrame functions only.

A host is turned around (www.example.com becomes ``com.example.www.``), so a rule's host and all its subdomains are
the keys in one interval [lo, hi). Intervals nest or are apart. The interval ends, each with the stack of rules that are
active from there on, are merged into the sorted urls; the last end before a url gives its stack, and the longest rule in
it whose path the url's path starts with decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflow.llm.common import Stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_ends(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, up to the next key, the rules in ``stack`` are active."""
    own = rules.select(host_key(F.col("host")).alias("lo"), F.struct(F.length(F.concat("host", "path")).alias("size"), (F.col("verdict") == "block").alias("block"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    own = own.groupBy("lo").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), "\\.")
    depth = F.size("labels")
    above = own.select("lo", labels.alias("labels")).select("lo", F.explode(F.sequence(F.lit(1), depth)).alias("k"), "labels").select("lo", (F.col("k") < depth).alias("outer"), F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("k")), "."), F.lit(".")).alias("up"))
    stacks = above.join(own.withColumnRenamed("lo", "up"), "up")
    inside = stacks.groupBy("lo").agg(F.flatten(F.collect_list("entries")).alias("stack"))
    outside = own.select("lo").join(stacks.where("outer").groupBy("lo").agg(F.flatten(F.collect_list("entries")).alias("stack")), "lo", "left")
    empty = F.array().cast(inside.schema["stack"].dataType)
    end = F.concat(F.expr("substring(lo, 1, length(lo) - 1)"), F.lit("/"))  # "/" is the character after "."
    return inside.select(F.col("lo").alias("key"), "stack").union(outside.select(end, F.coalesce("stack", empty)))


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], stage: Stage, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules are (host, path, verdict).

    The longest fitting rule wins, a block before an allow of the same text; without one, rule is null and the verdict is
    ``default``. Null urls and urls without :// have an empty host and path, which no rule fits. Repeated rows and rows that
    share a host stay apart: rows are dealt by (key, id, url), so a host with very many pages is spread over tasks. A null id
    is kept. An empty table gives an empty result. Other columns are ignored. Very long urls are judged whole.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    ends = stage.write(rule_ends(rules), "ends")
    kind = ends.schema["stack"].dataType
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    dealt = slim.withColumn("key", host_key(F.col("host"))).repartitionByRange("key", "page_id", "path").withColumn("part", F.spark_partition_id())
    dealt = stage.write(dealt, "dealt")
    firsts = dealt.groupBy("part").agg(F.min("key").alias("key"))
    # One row for each partition and each end of a rule: which stack holds where a partition begins, and in which partition an end falls.
    null = F.lit(None)
    line = firsts.select("key", "part", null.cast(kind).alias("stack")).union(ends.select("key", null.cast("int"), "stack"))
    before = Window.orderBy("key", F.col("part").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("key", F.col("part").isNotNull(), "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = line.select("key", F.last("stack", True).over(before).alias("active"), "stack", F.last("part", True).over(earlier).alias("into"), "part")
    seeds = placed.where("part IS NOT NULL").select("part", "key", F.lit(0).alias("turn"), F.col("active").alias("stack"))
    inner = placed.where("part IS NULL AND into IS NOT NULL").select(F.col("into").alias("part"), "key", F.lit(1).alias("turn"), "stack")
    urls = dealt.select("part", "key", F.lit(2).alias("turn"), null.cast(kind).alias("stack"), "page_id", "host", "path")
    merged = urls.unionByName(seeds.unionByName(inner), allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = merged.withColumn("stack", F.last("stack", True).over(sweep)).where("turn = 2")
    best = F.array_max(F.filter("stack", lambda r: F.col("path").startswith(r["path"])))
    judged = swept.withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
