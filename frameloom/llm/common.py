"""Shared helpers: table access, written intermediate tables, sizes and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.sources.shipping import ship

ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """What queries made in here shuffle goes when they end."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost one re-read.

    The files are removed when the driver's file system client closes. What was shuffled for them isn't needed any
    more once they are written, and goes with the query.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frameloom/{label}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)  # select: a query takes the setting when it is made
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


#: Catalyst's way to say that it doesn't know a size is one beyond this.
UNKNOWN_BYTES = 1 << 53


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, for a file scan the size of the files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def bucket_count(df: DataFrame, bytes_each: int) -> int:
    """How many buckets hold about bytes_each of input; never fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // bytes_each))


def release_memory() -> None:
    """Give what a Python worker has freed back to the machine: workers are kept for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work, schema: str | StructType) -> DataFrame:
    """mapInArrow whose workers can import this package."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, key: str, work, schema: str | StructType) -> DataFrame:
    """applyInArrow for each value of key, whose workers can import this package."""
    def run(table):
        try:
            return work(table)
        finally:
            if table.nbytes > 1 << 20:
                release_memory()

    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that an edge touches.

    edges: columns a, b of one orderable type, in any direction, repeats and self-loops allowed.
    Returns node, root. Large-star and small-star steps alternate until the edges stop changing;
    each round is written to the shared folder, so nothing is collected and no lineage piles up.
    """
    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = materialize(directed(edges), "components")
    before = checksum(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = directed(large.union(current.join(least, "a").select("a", F.col("m").alias("b"))))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        current = materialize(directed(small), "components")
        after = checksum(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
