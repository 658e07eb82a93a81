"""Readers and writers. Schemas are given, not inferred, wherever a format doesn't carry its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "text string, meta struct<id:string,title:string,url:string>"
STEP = "run_id timestamp, step string, ok boolean, seconds double, items long"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_articles(spark: SparkSession, folder: str, wanted: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    """Articles of gzipped JSON lines: id, title, url, text; those of wanted (id) only, texts cut to so many code points."""
    df = spark.read.schema(ARTICLE).json(folder).select("meta.id", "meta.title", "meta.url", "text")
    df = df.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else df
    return df.withColumn("text", F.substring("text", 1, chars)) if chars else df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones come with their text in broken and nulls elsewhere."""
    return spark.read.schema(schema + ", broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def stem(path=None):
    """File name without folder and last suffix."""
    return F.regexp_extract(path if path is not None else F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_arrays(spark: SparkSession, path: str, element: str, field: str | None = None) -> DataFrame:
    """One JSON file for each dialogue, a bare array or {field: array}: stem, pos and the element's fields."""
    files = spark.read.option("wholetext", True).text(path).select(stem().alias("stem"), "value")
    bare = F.from_json("value", f"array<struct<{element}>>")
    parsed = F.when(F.ltrim("value").startswith("["), bare)
    if field:
        parsed = F.coalesce(parsed, F.from_json("value", f"struct<{field}:array<struct<{element}>>>")[field])
    return files.select("stem", F.posexplode(parsed).alias("pos", "x")).select("stem", "pos", "x.*")


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("stem")).where("stem <> ''")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(STEP).csv(path)


def stems_in(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Names of the files of a suffix, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(stem(F.col("path")).alias("stem")).distinct()


def settled_files(spark: SparkSession, folder: str, minutes: int = 10) -> DataFrame:
    """Files that nobody has touched for some minutes."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(mins=F.lit(minutes))).select("path", "length")


def write_shards(df: DataFrame, path: str, shards: DataFrame, key: str) -> None:
    """Rows by the file that shard_files names, one folder each."""
    df.join(shards, key).repartition("file").sortWithinPartitions("file", key).write.partitionBy("file").parquet(path)


def write_routed(df: DataFrame, path: str, status: str = "status") -> None:
    df.write.partitionBy(status).parquet(path)


def write_steps(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("nullValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str, shard: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(shard) if shard else writer).json(path)
