"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of each partition are merged to find digests that a sizeable share of the rows may
carry. Their exact winners (at most a fixed number of rows) are broadcast, so copies of a hot text are
settled where they are read; every other digest goes through an ordinary shuffle, in groups whose size the
summary bounds.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import ASCII_SPACE, map_arrow, materialize, text_or_empty

#: Counters of each partition's summary. A digest of more than 2 / COUNTERS of all rows is always a candidate,
#: and no more than COUNTERS + 2 digests ever are.
COUNTERS = 1024


def normalized(text: Column) -> Column:
    return F.translate(text, ASCII_SPACE, "")


def trim_summary(counts: dict, counters: int) -> dict:
    """Misra-Gries reduction: subtract the (counters + 1)-th largest count, keep what stays above zero."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches):
        counts: dict = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            merged = Counter(counts)
            merged.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)))
            counts = trim_summary(merged, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after all ASCII white space is deleted; null counts as the empty text, so
    all null and blank texts form one group. Of a group, the row with the most code points stays, then the one
    with the smallest id (a null id is larger than any other); of rows that repeat id and text exactly one stays.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    text = text_or_empty(text_col)
    slim = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normalized(text), 256)).alias("digest"),
            F.char_length(text).alias("points"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "exact-digests",
    )
    rows = slim.count()
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("no_id"), "id", "row"))
    grouped = [F.count("*").alias("group_size"), first.alias("first")]

    summaries = map_arrow(slim.select("digest"), _summaries(counters), "digest binary, n bigint")
    least = max(2.0, 2.0 * rows / counters - rows / (counters + 1.0))
    candidates = summaries.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("digest")
    winners = materialize(slim.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*grouped), "exact-winners")

    hot = slim.join(F.broadcast(winners), "digest")
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.join(rest.groupBy("digest").agg(*grouped), "digest")
    return hot.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that mark_duplicates keeps, with all their columns.

    Of rows that repeat id and text exactly one stays; null and blank texts are one group; an empty table gives no
    rows. Texts are shuffled once: the join and the numbering of repeated rows share one key.
    """
    key, nth = "__keeper_key", "__keeper_nth"

    def key_of(digest, id_):
        return F.concat(digest, F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))

    keepers = mark_duplicates(docs, id_col, text_col).where("kept").select(key_of(F.unhex("text_sha256"), F.col(id_col)).alias(key))
    text = text_or_empty(text_col)
    tagged = docs.withColumn(key, key_of(F.unhex(F.sha2(normalized(text), 256)), F.col(id_col)))
    points = F.char_length(text).desc()
    kept = tagged.join(keepers, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(points)))
    return kept.where(F.col(nth) == 1).select(*docs.columns)
