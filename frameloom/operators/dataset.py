"""Joining, checking, gating, sharding and resuming the tables of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import normalized, windows_of

#: Items meet documents by their first so many characters; shorter ones are compared with every document.
ANCHOR = 16
#: Rows that grow on the way are dealt into parts of so many bytes of the files that they come from.
PART_BYTES = 1 << 20
#: Catalyst's way to say that it doesn't know a size is one beyond this.
UNKNOWN_BYTES = 1 << 53


def name_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """<key>, in_left, in_right of every name that only one side has."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
    return both.where("NOT (in_left AND in_right)")


def join_streams(left: DataFrame, right: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Inner join; strict raises if a name has no partner."""
    if strict and (missing := name_check(left, right, key).limit(5).collect()):
        raise ValueError("without a partner: " + ", ".join(str(r[key]) for r in missing))
    return left.join(right, key)


def remaining(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows of source without a valid result."""
    return source.join(done.where("valid"), key, "left_anti")


def select_batch(candidates: list[DataFrame], claimed: DataFrame, key: str, n: int) -> DataFrame:
    """The first n keys that all candidates have and no other batch has claimed."""
    out = candidates[0].select(key).distinct()
    for c in candidates[1:]:
        out = out.join(c, key, "left_semi")
    return out.join(claimed, key, "left_anti").orderBy(key).limit(n)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by hash of its keys, into more parts the larger the files are, so that what a task holds doesn't grow with the input.

    All tables made from the same files get the same number of parts, and joins by these keys move nothing. Files
    below one part are dealt as the session would.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    parts = -(-sum(x for x in sizes if x < UNKNOWN_BYTES) // PART_BYTES)
    if parts <= 1:
        return df.repartition(*keys)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with nth, its rows' running number from zero in the order of keys, without one task that sees all rows.

    Ranges of the keys are numbered by themselves and shifted by the sizes of those before: one broadcast row for
    each range. Bounds of ranges are drawn anew whenever they are made, so one table holds their bounds and their
    sizes, and rows find their range by its bounds.
    """
    key = F.struct(*keys)
    dealt = df.select(*keys).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    sizes = dealt.groupBy(F.spark_partition_id().alias("__part")).agg(F.min(key).alias("__low"), F.count("*").alias("__size"))
    order = Window.orderBy("__low")
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select("__low", before.alias("__before"), F.lead("__low").over(order).alias("__high"))
    mine = (F.col("__low") <= F.col("__key")) & (F.col("__high").isNull() | (F.col("__key") < F.col("__high")))
    rows = df.withColumn("__key", key).join(F.broadcast(ranges), mine)
    inside = F.row_number().over(Window.partitionBy("__before").orderBy(*keys)) - 1
    return rows.withColumn("nth", inside + F.col("__before")).drop("__key", "__low", "__high", "__before")


def shard_files(df: DataFrame, key: str, per_shard: int, prefix: str) -> DataFrame:
    """<key>, file: shards of a fixed number of rows in key order, named prefix-001-of-00N."""
    shards = -(-df.count() // per_shard)
    shard = F.floor(F.col("nth") / per_shard) + 1
    return numbered(df.select(key), key).select(key, F.format_string(f"{prefix}-%03d-of-{shards:03d}", shard).alias("file"))


def quality_gate(items: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Each item's status: pass, reject, or fail where no verdict is known."""
    status = F.when(F.col("quality").isNull(), "fail").when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("reject")
    return items.join(verdicts, key, "left").withColumn("status", status)


def reconcile(staged: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """moved, duplicate, broken or conflict for every name of either side, by size."""
    a, b = staged.select(key, F.col("size").alias("staged")), existing.select(key, F.col("size").alias("existing"))
    what = (F.when(F.col("staged") == 0, "broken").when(F.col("existing").isNull(), "moved").when(F.col("staged").isNull(), "kept")
            .when(F.col("staged") == F.col("existing"), "duplicate").otherwise("conflict"))
    return a.join(b, key, "full_outer").select(key, what.alias("outcome"))


def containment(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document whose normalized text holds an item's, for any number of items.

    Documents and items are first joined by the items' anchors, without texts, and what meets is compared exactly.
    Every row counts, also where ids repeat or are null; empty items are in no document.
    """
    docs = documents.select("doc_id", normalized(F.col("text")).alias("body"))
    answers = items.select("item_id", normalized(F.col("text")).alias("answer")).where("answer <> ''")
    long = answers.where(F.length("answer") >= ANCHOR).withColumn("anchor", F.substring("answer", 1, ANCHOR))
    met = docs.select("doc_id", F.explode(windows_of(F.col("body"), ANCHOR)).alias("anchor")).join(long.select("anchor").distinct(), "anchor", "left_semi").distinct()
    pairs = docs.join(met.withColumnRenamed("doc_id", "met_id"), F.col("doc_id").eqNullSafe(F.col("met_id"))).join(long, "anchor")
    short = docs.join(F.broadcast(answers.where(F.length("answer") < ANCHOR)), F.col("body").contains(F.col("answer")))
    return pairs.where(F.col("body").contains(F.col("answer"))).select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id"))


def first_available(sources: list[DataFrame], key: str) -> DataFrame:
    """For each key the row of the first source that has it."""
    out = None
    for n, s in enumerate(sources):
        part = s.withColumn("source_no", F.lit(n))
        out = part if out is None else out.unionByName(part)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("source_no"))
    return out.withColumn("nth", nth).where("nth = 1").drop("nth")


def shifted_pairs(df: DataFrame, key: str) -> DataFrame:
    """The wrong-partner control: each row with the one half the table further on, in key order."""
    n = df.count()
    ranked = numbered(df.select(key), key)
    other = ranked.select(F.col(key).alias("other"), F.col("nth").alias("to"))
    return ranked.withColumn("to", F.pmod(F.col("nth") + n // 2, F.lit(max(n, 1)))).join(other, "to").select(key, "other")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names all columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def exclude_incomplete(items: DataFrame, parts: DataFrame, found: DataFrame, key: str, part: str) -> DataFrame:
    """Items all of whose parts were found; an item without parts stays. parts and found: <key>, <part>."""
    lost = parts.join(found.select(key, part), [key, part], "left_anti").select(key).distinct()
    return items.join(lost, key, "left_anti")


def join_all(driver: DataFrame, tables: list[DataFrame], key: str, report: str | None = None) -> DataFrame:
    """Inner join of all tables on the driver's names. report: folder to which names that a table lacks are written before an error is raised."""
    if report:
        lacking = [driver.select(key).join(t.select(key), key, "left_anti").withColumn("table_no", F.lit(n)) for n, t in enumerate(tables)]
        missing = lacking[0]
        for more in lacking[1:]:
            missing = missing.unionByName(more)
        missing.write.mode("overwrite").parquet(report)
        if n := driver.sparkSession.read.parquet(report).count():
            raise ValueError(f"{n} names without a partner, see {report}")
    out = driver
    for t in tables:
        out = out.join(t, key)
    return out
