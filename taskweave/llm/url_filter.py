"""URL filter rules as a sort-merge range join (DataFrame operations only).

A host is turned into its canonical key, the labels reversed and each ended by a dot (``a.example.net`` becomes
``net.example.a.``).  A rule's host and all its subdomains are then the keys that start with the rule's key: one
interval in sorted order, and two such intervals are nested or apart.  A sweep over sorted keys keeps the stack of
active nested rules, one slot for each number of labels: the slot holds the last rule with so many labels, which is
active as long as its key starts the swept key.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
#: A bucket of hosts is swept in parts of about so many distinct hosts.
PART_HOSTS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def active_rules(hosts: DataFrame, rules: DataFrame, part_hosts: int = PART_HOSTS) -> DataFrame:
    """``host`` (distinct) x rules -> ``host, rules`` for the hosts that lie in some rule's interval.

    ``rules`` is the stack at the host: an array of (length, host length, verdict, rule, path), all rules whose host is
    the host or a parent domain.  Hosts and rules meet in buckets, the first two labels of the key; rules of a single
    label go to all buckets below it.  A bucket with many hosts is dealt into parts by hash, and its rules go to each
    part, so no sweep holds more than about ``part_hosts`` hosts.
    """
    rule_rows = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
                 .withColumn("key", host_key(F.col("host")))
                 .groupBy("key").agg(F.sort_array(F.collect_set(F.struct(
                     (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), "verdict",
                     F.concat("host", "path").alias("rule"), "path"))).alias("here"))
                 .withColumn("labels", F.size(F.split("key", r"\.", -1)) - 1))
    deepest = rule_rows.agg(F.max("labels")).first()[0] or 0
    first, bucket = F.substring_index("key", ".", 1), F.substring_index("key", ".", 2)
    keyed = hosts.select("host", host_key(F.col("host")).alias("key")).withColumn("bucket", bucket)
    buckets = (keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("parts", F.ceil(F.col("n") / F.lit(part_hosts)).cast("int")).drop("n"))
    slim = rule_rows.select("key", "labels", "here")
    spread = (slim.where("labels > 1").withColumn("bucket", bucket).join(buckets, "bucket")
              .unionByName(slim.where("labels = 1").withColumn("top", first)
                           .join(buckets.withColumn("top", F.substring_index("bucket", ".", 1)), "top").drop("top")))
    starts = (spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("bucket", "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "labels", "here"))
    points = (keyed.join(buckets, "bucket")
              .select("bucket", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", F.lit(1).alias("kind"), "host",
                      F.lit(None).cast("int").alias("labels"), F.lit(None).cast(slim.schema["here"].dataType).alias("here")))
    swept = Window.partitionBy("bucket", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slots = [F.last(F.when(F.col("labels") == d, F.struct("key", "here")), ignorenulls=True).over(swept) for d in range(1, deepest + 1)]
    events = starts.unionByName(points).select("host", "key", "kind", *[s.alias(f"slot{d}") for d, s in enumerate(slots)])
    stack = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.here")) for d in range(deepest)]
    none = F.array().cast(slim.schema["here"].dataType)
    return (events.where("kind = 1").select("host", F.concat(none, *[F.coalesce(s, none) for s in stack]).alias("rules"))
            .where(F.size("rules") > 0))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id",
               url_col: str = "url", part_hosts: int = PART_HOSTS) -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict``, one row for each input row.

    A rule fits if the host is the rule's or below it and the path starts with the rule's path; of those that fit the
    longest (host and path together) wins, then the one with the longer host, then ``block``.  Without a fitting rule
    ``rule`` is null and the verdict ``default``.  Only distinct hosts are swept, so a hot host is swept once; the
    stacks join back on the host, where Spark splits a hot host, as each host has one row of rules.

    Nulls: a null URL, or one without ``://``, has an empty host and path; a null id is kept; rules with a null host
    or path are left out.  Repeated rows are all judged.  Empty tables (pages or rules) work.  Other columns, such as
    the page itself, are not read.  All rules of one rule host travel as one row.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    stacks = stored(spark, active_rules(rows.select("host").distinct(), rules, part_hosts), "url-stacks")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("l"), r["host_length"].alias("h"),
                                                            r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return (rows.join(stacks, "host", "left").withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
