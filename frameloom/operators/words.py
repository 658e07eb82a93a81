"""Turns, words and runs of two-speaker conversations. Times are whole milliseconds; word_idx is the list position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.dataset import dealt

BASE_MS, PER_CHAR_MS, PAUSE_MS = 60, 40, 300


def turns_of(conversations: DataFrame, strict: bool = False) -> DataFrame:
    """conv_id, turn, speaker (A: user, B: assistant), text; turns of other roles are dropped (see other_roles), strict raises on one."""
    speaker = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B")
    if strict:
        speaker = speaker.otherwise(F.raise_error(F.concat(F.lit("unexpected role: "), F.coalesce("role", F.lit("null")))).cast("string"))
    return conversations.withColumn("speaker", speaker).where("speaker IS NOT NULL").select("conv_id", "turn", "speaker", "text")


def other_roles(conversations: DataFrame) -> DataFrame:
    """role, turns: what turns_of drops."""
    return conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").groupBy("role").agg(F.count("*").alias("turns"))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def words_of(turns: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, word_idx, word, start_ms, end_ms: words in a row, a pause between turns.

    Turns are dealt by conversation before they are split, as texts are smaller than their words.
    """
    words = dealt(turns.select("conv_id", "turn", "speaker", "text"), "conv_id").select("conv_id", "turn", "speaker", F.posexplode(split_words(F.col("text"))).alias("pos", "word"))
    order = Window.partitionBy("conv_id").orderBy("turn", "pos")
    first = F.when(F.col("pos") == 0, 1).otherwise(0)
    spent = F.lit(BASE_MS) + PER_CHAR_MS * F.length("word")
    end = F.sum(spent).over(order) + PAUSE_MS * (F.sum(first).over(order) - 1)
    return words.select(
        "conv_id", "turn", "speaker", (F.row_number().over(order) - 1).alias("word_idx"), "word",
        (end - spent).cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"))


def with_runs(words: DataFrame) -> DataFrame:
    """Adds run: the number of the speaker's uninterrupted run, counting from one."""
    order = Window.partitionBy("conv_id").orderBy("word_idx")
    changed = F.when(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), 0).otherwise(1)
    return words.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order)).drop("changed")


def runs_of(words: DataFrame) -> DataFrame:
    """conv_id, run, speaker, n_words, text of every run."""
    return with_runs(words).groupBy("conv_id", "run", "speaker").agg(
        F.count("*").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("text"))


def contexts_of(words: DataFrame) -> DataFrame:
    """conv_id, n_runs, context: one "speaker: words" line for each run."""
    lines = F.array_sort(F.collect_list(F.struct("run", F.concat_ws(": ", "speaker", "text").alias("line"))))
    return runs_of(words).groupBy("conv_id").agg(
        F.count("*").alias("n_runs"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def recent_words(words: DataFrame, k: int = 5) -> DataFrame:
    """The last k words up to each word, joined by blanks."""
    last = Window.partitionBy("conv_id").orderBy("word_idx").rowsBetween(1 - k, 0)
    return words.select("conv_id", "word_idx", F.array_join(F.collect_list("word").over(last), " ").alias("recent_words"))


def manifest_of(words: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, onset_ms, duration_ms of every turn."""
    return words.groupBy("conv_id", "turn", "speaker").agg(
        F.min("start_ms").alias("onset_ms"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))


def require_speakers(words: DataFrame, strict: bool = False) -> DataFrame:
    """conv_id, has_a, has_b, valid; strict raises on a conversation without one of the two speakers."""
    flags = words.groupBy("conv_id").agg(F.bool_or(F.col("speaker") == "A").alias("has_a"), F.bool_or(F.col("speaker") == "B").alias("has_b"))
    valid = F.col("has_a") & F.col("has_b")
    if strict:
        valid = F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("missing speaker in "), F.col("conv_id").cast("string"))).cast("boolean"))
    return flags.withColumn("valid", valid)


def gaps_between_turns(words: DataFrame) -> DataFrame:
    """Offset of each turn from the end of the one before, if another speaker had it; negative is overlap."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = manifest_of(words)
    before = F.lag(F.col("onset_ms") + F.col("duration_ms")).over(order)
    return m.select("conv_id", "turn", F.when(F.lag("speaker").over(order) != F.col("speaker"), F.col("onset_ms") - before).alias("gap_ms"))


def stereo_onsets(manifest: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """Where each turn starts when turns are set one after the other with a pause: running sum of what came before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("duration_ms") + pause_ms).over(before), F.lit(0)).cast("bigint")
    channel = F.when(F.col("speaker") == "A", 0).otherwise(1)
    return manifest.select("conv_id", "turn", channel.alias("channel"), at.alias("at_ms"))


def opening_of(words: DataFrame) -> DataFrame:
    """conv_id, opener, first_ms, b_first_ms."""
    return words.groupBy("conv_id").agg(
        F.min_by("speaker", "word_idx").alias("opener"), F.min("start_ms").alias("first_ms"),
        F.min(F.when(F.col("speaker") == "B", F.col("start_ms"))).alias("b_first_ms"))
