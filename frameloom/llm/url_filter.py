"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule's host is reversed label by label and joined with its path; every url that the rule fits then has a
key inside the interval [key, key + 0xFF). Rules and urls are sorted together, and a sweep over that order
keeps the stack of rules that are open: its height is a running sum of openings and closings, and its top is
the last rule opened at the current height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """<id_col>, host, path. A null url, or one without ://, has an empty host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """<id_col>, host, path, rule, verdict for every row of pages.

    rules: host, path, verdict; a rule fits its host and all subdomains if the path starts with the rule's.
    The rule with the most characters wins, then the one later in text order; of rules that repeat host and
    path the larger verdict counts; rules with a null host or path are ignored. Urls without a rule get
    default and a null rule. Repeated rows are each returned, null ids too; an empty table gives no rows.

    Rows are dealt out by a hash of id and url, so a hot host or one repeated url never meets in one task
    unless whole rows repeat; each part gets its own copy of the rules (rules x parts rows).
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = lambda c: F.split(c, r"\.")
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    depth_of = rules.agg(F.max(F.size(labels(F.col("host")))).alias("n")).first()["n"] or 1

    def key(host, path):
        return F.concat(F.array_join(host, "."), F.lit("\u0000"), path).cast("binary")

    urls = split_url(pages, id_col, url_col).withColumnRenamed(id_col, "id")
    urls = urls.withColumn("part", F.pmod(F.xxhash64("id", "host", "path"), F.lit(parts)).cast("int"))
    urls = urls.withColumn("labels", F.reverse(labels(F.col("host"))))
    urls = urls.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(depth_of)))))
    url_rows = urls.select(
        "part", key(F.slice("labels", F.lit(1), F.col("n")), F.col("path")).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast("struct<len:int,rule:string,verdict:string>").alias("opened"), "id", "host", "path", "n")

    rule_key = key(F.reverse(labels(F.col("host"))), F.col("path"))
    text = F.concat("host", "path")
    opened = F.struct(F.length(text).alias("len"), text.alias("rule"), F.col("verdict"))
    spread = rules.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rule_rows = spread.select(
        "part", F.explode(F.array(
            F.struct(rule_key.alias("key"), F.lit(0).alias("kind"), opened.alias("opened")),
            F.struct(F.concat(rule_key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast(
                "struct<len:int,rule:string,verdict:string>").alias("opened")))).alias("e"),
    ).select("part", "e.key", "e.kind", "e.opened")

    events = url_rows.unionByName(rule_rows, allowMissingColumns=True).repartition(parts, "part")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    events = events.withColumn("height", F.sum(change).over(sweep))
    level = Window.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("height") > 0, F.last("opened", ignorenulls=True).over(level))
    judged = events.withColumn("top", top).where("kind = 1").groupBy("part", "id", "host", "path").agg(
        F.max("top").alias("top"), F.count_if(F.col("n") == 1).alias("copies"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
