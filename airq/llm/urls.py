"""URL filter: a sort-merge range join of url keys with prefix rules, in DataFrame code only.

A rule is a host and a path prefix; it fits the host and its subdomains. The
canonical key of a rule is its host with the labels reversed, each followed by a
dot, then its path: every url it fits has a key that begins with it, so a rule is
the interval of keys that begin with its own. A url has one key for each of its
host's trailing label groups, down to the longest rule host.

Rules' intervals nest or are disjoint. In key order the last rule that starts at
or before a url's key is therefore the innermost rule around it, or lies inside
that one. Each rule carries the stack of the rules around it, so the sweep keeps
one value, the stack of the last rule, and takes its topmost member that holds the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airq.llm.shared import free_name, need, partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    """Canonical key: reversed labels, each with a dot behind it, then the path."""
    return F.concat(F.array_join(labels, "."), F.lit("."), path)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` rows from literals."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def with_stacks(rules: DataFrame) -> DataFrame:
    """``key, depth, stack``: each rule with the rules around it, innermost last.

    Rules around a rule are those whose key is a beginning of its key, found by
    an equality join on all beginnings, so its size is the rules' total length.
    Of equal host and path, ``block`` wins. Null parts count as empty.
    """
    need(rules, "host", "path", "verdict")
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    flat = (
        rules.select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", _key(_labels(F.col("host")), F.col("path")))
    )
    outer = flat.select(
        F.col("key").alias("begin"),
        F.struct(
            F.length("key").alias("length"), F.col("key").alias("key"),
            F.concat("host", "path").alias("rule"), "verdict",
        ).alias("entry"),
    )
    begins = flat.select(
        "key", F.size(_labels(F.col("host"))).alias("depth"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.left("key", i))).alias("begin"),
    )
    return begins.join(outer, "begin").groupBy("key", "depth").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def url_filter(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict`` added.

    The longest fitting rule decides (by characters of host and path); without
    one, ``rule`` is null and ``verdict`` is ``default``. Null or malformed urls
    have an empty host and path. Columns of ``pages`` with the added names are
    replaced. Repeated rows stay repeated; an empty table or no rules is fine.

    Distinct (host, path) pairs are judged, so a hot url is one row after the
    map-side combine. Their keys and the rules are dealt into ranges of the key
    order by Spark's range partitioning (hot keys spread over ranges by their path),
    each range is swept on its own, and ranges that begin inside an interval
    get the last rule before them from a table of one row per range.
    """
    need(pages, url)
    ranges = ranges or partitions(pages.sparkSession)
    stacks = written(with_stacks(rules))
    host, path = host_and_path(F.col(f"`{url}`"))
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    pairs = judged.select("host", "path").distinct()
    deepest = stacks.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).scalar()
    labels = _labels(F.col("host"))
    keys = (
        pairs.select("host", "path", labels.alias("labels"), deepest.alias("deepest"))
        .select("*", F.explode(F.sequence(
            F.lit(1), F.greatest(F.lit(1), F.least("deepest", F.size("labels"))))).alias("level"))
        .filter("level <= deepest")
        .select("host", "path", _key(F.slice("labels", 1, F.col("level")), F.col("path")).alias("key"))
    )
    swept = written(
        keys.select("key", F.lit(1).alias("is_url"), "host", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
        .unionByName(stacks.select("key", F.lit(0).alias("is_url"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack"))
        .repartitionByRange(ranges, "key", "is_url", "host")
        .withColumn("range", F.spark_partition_id())
    )
    last_of = swept.filter("is_url = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    # One row per range: a fixed number, whatever the input.
    carried = (
        pages.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range"))
        .join(last_of, "range", "left")
        .select("range", F.last("stack", ignorenulls=True).over(
            Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    sweep = Window.partitionBy("range").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = (
        swept.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .filter("is_url = 1").join(F.broadcast(carried), "range", "left")
        .withColumn("stack", F.coalesce("stack", "carried"))
        .select("host", "path", F.try_element_at(
            F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"])), F.lit(-1)).alias("top"))
    )
    best = (
        active.filter("top IS NOT NULL")
        .select("host", "path", F.struct(F.length("top.rule").alias("n"), "top.rule", "top.verdict").alias("top"))
        .groupBy("host", "path").agg(F.max("top").alias("top"))
    )
    name = free_name(judged, "top")
    return judged.join(best.withColumnRenamed("top", name), ["host", "path"], "left").select(
        *[judged[f"`{c}`"] for c in judged.columns], F.col(f"{name}.rule").alias("rule"),
        F.coalesce(f"{name}.verdict", F.lit(default)).alias("verdict"))
