"""Incremental text as reset and append commands, and windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.sources.shipping import ship

COMMANDS = "session string, seq long, op string, text string"


def step(emitted: str, generation: int, message: tuple[int, str, str]) -> tuple[str, int, list[tuple[str, str]]]:
    """One message (generation, kind, text) on what a session has emitted so far.

    kind text: the whole text so far; its new suffix is appended, or all of it after a reset where it no longer
    begins with what was emitted. kind cancel or error: closes the generation with a mark. Older generations are
    ignored, a newer one starts with a reset.
    """
    number, kind, text = message
    out: list[tuple[str, str]] = []
    if number < generation:
        return emitted, generation, out
    if number > generation:
        if emitted:
            out.append(("reset", ""))
        emitted, generation = "", number
    if kind in ("cancel", "error"):
        return "", number + 1, [*out, ("close", "[CANCELLED]" if kind == "cancel" else "[ERROR]")]
    if not text.startswith(emitted):
        out.append(("reset", ""))
        emitted = ""
    if text[len(emitted) :]:
        out.append(("append", text[len(emitted) :]))
    return text, generation, out


def deltas(messages: DataFrame) -> DataFrame:
    """messages: session, arrived, generation, kind, text, as a stream. Returns session, seq, op, text."""
    ship(messages.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        emitted, generation, seq = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values("arrived", kind="stable")
        out = []
        for g, k, t in zip(rows["generation"], rows["kind"], rows["text"], strict=True):
            emitted, generation, commands = step(emitted, generation, (int(g), k, t or ""))
            for op, text in commands:
                out.append((key[0], seq, op, text))
                seq += 1
        state.update((emitted, generation, seq))
        yield pd.DataFrame(out, columns=["session", "seq", "op", "text"])

    return messages.groupBy("session").applyInPandasWithState(run, COMMANDS, "emitted string, generation long, seq long", "append", GroupStateTimeout.NoTimeout)


def timed(df: DataFrame) -> DataFrame:
    """Event time with a zone, as watermarks need it; times without one are the session's."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def pending(partials: DataFrame) -> DataFrame:
    """Recognised text that waits for a query: rows without text ask nothing."""
    return partials.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def tick_windows(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: events of each type in event-time windows; rows later than the watermark are left out."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: each user's events until a pause."""
    return timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def restart_counts(restarts: DataFrame, most: int = 5) -> DataFrame:
    """Whether a session may restart: at most so many restarts in two seconds."""
    return timed(restarts).withWatermark("ts", "10 seconds").groupBy("session", F.window("ts", "2 seconds", "500 milliseconds").alias("w")).agg(
        F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), (F.col("n") <= most).alias("allowed"))
