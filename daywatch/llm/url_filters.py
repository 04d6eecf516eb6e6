"""URL filters: a sort-merge range join of page URLs with prefix rules.

A host is written with its labels reversed ("com.example.www."), so that a rule for a
host and its subdomains is one interval of the sorted keys; within a host, a path rule is
an interval of the sorted paths. ``covering`` sweeps sorted keys once: each rule key
carries the stack of rules that enclose it, and a key's active rules are those of the
last rule key before it that still enclose it. Hosts are swept once each, however many
pages they have. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywatch.llm.text import ascii_lower, free_name, stored
from daywatch.session import shuffle_width

#: Stands between a host key and a path; cannot be in a host label, as "/" ends the host.
MARK = "/"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return ascii_lower(_part(url, 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; empty without "://"."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def covering(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each distinct ``key`` of points, the ``stack`` of prefixes it starts with, shortest first.

    The keys of both are range-partitioned and swept in order, one window per range; what is
    open at a range's start comes from the ranges before it (one row a range). Keys are
    distinct, so no range grows with a hot key. Without prefixes every stack is empty.
    """
    points, prefixes = points.select("key").distinct(), prefixes.select("key").distinct()
    spark = points.sparkSession
    heads = prefixes.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.substring(F.col("key"), F.lit(1), F.col("n")).alias("head")
    )
    open_at = (
        heads.join(prefixes.withColumnRenamed("key", "head"), "head")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("head")).alias("open"))
    )
    ranges = shuffle_width(spark)
    lanes = stored(
        points.select("key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("open"))
        .unionByName(open_at.select("key", F.lit(0).alias("kind"), "open"))
        .repartitionByRange(ranges, "key", "kind")
        .withColumn("lane", F.spark_partition_id()),
        "lanes",
    )
    last_open = lanes.where("kind = 0").groupBy("lane").agg(F.max_by("open", "key").alias("last_open"))
    every = spark.range(ranges).select(F.col("id").cast("int").alias("lane")).join(last_open, "lane", "left")
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("lane", F.last("last_open", True).over(before).alias("carried"))
    in_order = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = lanes.withColumn("active", F.last("open", True).over(in_order)).where("kind = 1")
    # carried has one row per range, whatever the input
    return swept.join(F.broadcast(carried), "lane").select(
        "key",
        F.filter(
            F.coalesce("active", "carried", F.array().cast("array<string>")), lambda p: F.startswith(F.col("key"), p)
        ).alias("stack"),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the
    page's path starts with the rule's path; the rule with most characters wins, then the one
    with the longer host. Rules given twice count once, "block" before others; rules with a
    null host or path fit nothing. A null URL, or one without "://", has an empty host and
    path. Pages no rule fits get ``default``. Repeated pages are each judged.
    """
    # The host sweep and the path sweep both read these.
    rules = (
        rules.where("host is not null and path is not null")
        .groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
        .withColumn("rule_key", host_key(F.col("rule_host")))
    )
    parts = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    hosts = covering(
        parts.select(host_key(F.col("host")).alias("key")), rules.select(F.col("rule_key").alias("key"))
    ).where(F.size("stack") > 0)
    targets = parts.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    targets = targets.join(hosts, "key").select(
        "host", "path", F.explode("stack").alias("rule_key"), F.concat("rule_key", F.lit(MARK), "path").alias("at")
    )
    paths = covering(
        targets.select(F.col("at").alias("key")),
        rules.select(F.concat("rule_key", F.lit(MARK), "rule_path").alias("key")),
    ).where(F.size("stack") > 0)
    # The last of a stack is the longest path rule of that host.
    found = targets.join(paths.select(F.col("key").alias("at"), F.try_element_at("stack", F.lit(-1)).alias("hit")), "at")
    ruled = rules.withColumn("hit", F.concat("rule_key", F.lit(MARK), "rule_path"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size")
    )
    chosen = (
        found.join(ruled, "hit")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("won"))
    )
    return parts.join(chosen, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


def allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages whose verdict is not "block", with all their columns."""
    host, path = free_name(pages, "host"), free_name(pages, "path")
    verdicts = judge_urls(pages.select(url_col).distinct(), rules, url_col, url_col, default)
    blocked = verdicts.where("verdict = 'block'").select(F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    keyed = pages.withColumn(host, url_host(F.col(url_col))).withColumn(path, url_path(F.col(url_col)))
    same = (keyed[host] == blocked["_h"]) & (keyed[path] == blocked["_p"])
    return keyed.join(blocked, same, "left_anti").drop(host, path)
