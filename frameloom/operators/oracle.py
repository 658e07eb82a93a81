"""Prediction events: a tick grid over the words heard so far, how far the utterance is, and what comes next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.words import with_runs

#: A pause of so many milliseconds between ends of words ends the utterance.
BREAK_MS = 1000
HINT_RATIO = 0.5


def _heard(words: DataFrame) -> DataFrame:
    """Words with run, spoken, total and next_end: all that the ticks between a word's end and the next one's see."""
    order = Window.partitionBy("conv_id").orderBy("word_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv_id").orderBy(F.desc("word_idx")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that grows costs each row once
    everything = Window.partitionBy("conv_id")
    breaks = F.col("speaker").isNotNull() & ((F.lag("speaker").over(order) != F.col("speaker")) | (F.col("end_ms") - F.lag("end_ms").over(order) >= BREAK_MS))
    base = with_runs(words).withColumn("is_break", breaks).withColumns({
        "last_a": F.max(F.when(F.col("speaker") == "A", F.col("word_idx"))).over(so_far),
        "last_b": F.max(F.when(F.col("speaker") == "B", F.col("word_idx"))).over(so_far),
        "next_end": F.lead("end_ms").over(order),
        "n": F.count("*").over(everything)})
    base = base.withColumn("next_break", F.coalesce(F.min(F.when(F.col("is_break"), F.col("word_idx"))).over(ahead), F.col("n")))
    other = F.coalesce(F.when(F.col("speaker") == "A", F.col("last_b")).otherwise(F.col("last_a")), F.lit(-1))
    base = base.withColumn("spoken", F.col("word_idx") - other)
    return base.withColumn("total", F.col("spoken") + F.col("next_break") - F.col("word_idx") - 1)


def _ticks(heard: DataFrame, interval_ms: int, target: str | None, *more: str) -> DataFrame:
    first, last = F.ceil(F.col("end_ms") / interval_ms), F.ceil(F.col("next_end") / interval_ms) - 1
    ticks = heard.where("word_idx >= 1 AND next_end IS NOT NULL").withColumn("tick", F.explode(F.when(first <= last, F.sequence(first, last))))
    found = ticks.select(
        "conv_id", "tick", (F.col("tick") * interval_ms).alias("timestamp_ms"), "word_idx", "speaker", "run", "spoken", "total",
        (F.col("spoken") / F.col("total")).alias("ratio"), *more)
    return found.where(F.col("speaker") != target) if target else found


def oracle_ticks(words: DataFrame, interval_ms: int = 500, target: str | None = None) -> DataFrame:
    """conv_id, tick, timestamp_ms, word_idx, speaker, spoken, total, ratio, run.

    A tick at k * interval sees the words that have ended by then; it needs two of them and ends before the last
    word does. Every tick falls between two ends of words, so each word makes its own ticks and nothing is joined.
    target keeps the ticks at which this speaker is to come next. Expects words in order of their ends, see
    is_ordered; oracle_ticks_unordered takes any.
    """
    return _ticks(_heard(words), interval_ms, target)


def is_ordered(words: DataFrame) -> DataFrame:
    """conv_id, ordered: whether words end in list order."""
    order = Window.partitionBy("conv_id").orderBy("word_idx")
    late = F.coalesce(F.lag("end_ms").over(order) >= F.col("end_ms"), F.lit(False))
    return words.withColumn("late", late).groupBy("conv_id").agg((~F.bool_or("late")).alias("ordered"))


def tick_loop(pdf: pd.DataFrame, interval_ms: int, target: str | None) -> list[tuple]:
    """Ticks of one conversation whatever its order, with the text to come; stops where nothing is to come."""
    pdf = pdf.sort_values("word_idx")
    end, speaker, word = pdf["end_ms"].tolist(), pdf["speaker"].tolist(), pdf["word"].tolist()
    out, n = [], len(end)
    for k in range(1, (max(end, default=0) - 1) // interval_ms + 1):
        heard = [i for i in range(n) if end[i] <= k * interval_ms]
        if len(heard) < 2:
            continue
        c = heard[-1]
        if target and speaker[c] == target:
            continue
        other = max((i for i in heard if speaker[i] != speaker[c]), default=-1)
        spoken = sum(i > other for i in heard)
        stop = next((i for i in range(c + 1, n) if speaker[i] != speaker[i - 1] or end[i] - end[i - 1] >= BREAK_MS), n)
        later = [i for i in range(n) if end[i] > end[c]]
        begin = next((i for i in later if speaker[i] != speaker[c]), n)
        finish = next((i for i in later if i > begin and speaker[i] == speaker[c]), n)
        hint = " ".join(word[i] for i in later if begin <= i < finish and speaker[i] != speaker[c])
        if not hint:
            break
        out.append((k, k * interval_ms, c, speaker[c], spoken, spoken + stop - c - 1, spoken / (spoken + stop - c - 1), hint))
    return out


def oracle_ticks_unordered(words: DataFrame, interval_ms: int = 500, target: str | None = None) -> DataFrame:
    """The same for conversations whose words don't end in list order, one conversation at a time."""
    def run(key, pdf):
        names = ["tick", "timestamp_ms", "word_idx", "speaker", "spoken", "total", "ratio", "hint"]
        found = pd.DataFrame(tick_loop(pdf, interval_ms, target), columns=names)
        found.insert(0, "conv_id", key[0])
        return found

    return words.groupBy("conv_id").applyInPandas(
        run, "conv_id bigint, tick bigint, timestamp_ms bigint, word_idx int, speaker string, spoken bigint, total bigint, ratio double, hint string")


def oracle_hints(words: DataFrame, interval_ms: int = 500, target: str | None = None) -> DataFrame:
    """Ticks with hint, the whole next run of the other speaker; a conversation stops where there is none.

    A run gathers its words, which are its text and make its ticks, and takes the text of the run behind it; so ticks
    and texts stay where their conversation is, without a join.
    """
    kept = ["word_idx", "word", "speaker", "end_ms", "next_end", "spoken", "total"]
    runs = _heard(words).groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda w: w["word"]), " ")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("run"))
    hinted = runs.withColumn("text", text).withColumn("hint", after).where("hint <> '' AND conv_id IS NOT NULL")
    heard = hinted.select("conv_id", "run", "hint", F.explode("ws").alias("w")).select("conv_id", "run", "hint", *[F.col(f"w.{c}").alias(c) for c in kept])
    return _ticks(heard, interval_ms, target, "hint")


def oracle_events(words: DataFrame, interval_ms: int = 500, target: str | None = None) -> DataFrame:
    """Events of the rule that predicts the hint once more than half of the utterance is spoken, and nothing before.

    channel is that of the speaker who comes next; event_idx counts a conversation's events; skip_forbid marks the
    last of a run of one channel, over all events.
    """
    events = oracle_hints(words, interval_ms, target).where(F.col("ratio") > HINT_RATIO)
    order = Window.partitionBy("conv_id").orderBy("tick")
    channel = F.when(F.col("speaker") == "A", 1).otherwise(0)
    events = events.withColumns({"channel": channel, "event_idx": F.row_number().over(order) - 1})
    follows = F.lead("channel").over(order)
    return events.withColumn("skip_forbid", F.when(follows.isNull() | (follows != F.col("channel")), 1).otherwise(0))
