"""Training examples: streams of a main speaker, delayed and cut, and what is changed at random in their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import arrays, hashing
from frameloom.operators.frames import delayed


def main_speaker(pairs: DataFrame, speakers: list[str]) -> DataFrame:
    """conv_id, speaker, rows: for each speaker asked for, its own rows and the other's codebooks. pairs: conv_id, a, b (rows of each)."""
    sides = [F.struct(F.lit(s).alias("speaker"), (arrays.stack(F.col("a"), F.col("b")) if s == "A" else arrays.stack(F.col("b"), F.col("a"))).alias("rows")) for s in speakers]
    return pairs.select("conv_id", F.explode(F.array(*sides)).alias("x")).select("conv_id", "x.speaker", "x.rows")


def delayed_rows(rows: Column, delays: list[int], initials: list[int], pads: list[int]) -> Column:
    """Each row with its own delay, initial token and pad."""
    most = max(delays)
    return F.array(*[delayed(F.get(rows, F.lit(k)), delay, most, initials[k], pads[k]) for k, delay in enumerate(delays)])


def cut_rows(streams: DataFrame, longest: int, shortest: int) -> DataFrame:
    """conv_id, speaker, chunk, start, rows: all rows cut at the same places, as numpy's array_split would; short chunks are left out."""
    frames = F.size(F.get("rows", F.lit(0)))
    n = F.ceil(frames / longest).cast("int")
    sized = streams.where(frames > 0).withColumns({"q": F.floor(frames / n).cast("int"), "r": (frames % n).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), n - 1))})
    sized = sized.withColumns({"start": F.col("chunk") * F.col("q") + F.least("chunk", "r"), "size": F.col("q") + (F.col("chunk") < F.col("r")).cast("int")})
    rows = F.transform("rows", lambda x: F.slice(x, F.col("start") + 1, F.col("size")))
    return sized.where(F.col("size") >= shortest).select("conv_id", "speaker", "chunk", "start", rows.alias("rows"))


def hint_only_probability(step: Column, begin: int, end: int) -> Column:
    """One up to the first step, none from the last, a straight line between."""
    return F.when(step <= begin, 1.0).when(step >= end, 0.0).otherwise(1.0 - (step - begin) / float(max(end - begin, 1)))


def skip_and_jitter(events: DataFrame, seed: str, low: float, high: float, jitter: int) -> DataFrame:
    """Events that stay, moved by up to jitter frames; those moved past the end go too.

    Each conversation draws its own probability of skipping between low and high; events with skip_forbid = 1 are
    never skipped. Draws depend on seed, conversation and event alone.
    """
    key = (F.col("conv_id"), F.col("event_idx"))
    chance = low + (high - low) * hashing.uniform(f"{seed}-rate", F.col("conv_id"))
    skipped = (F.col("skip_forbid") == 0) & (hashing.uniform(f"{seed}-skip", *key) < chance)
    moved = F.col("pos") + F.pmod(hashing.number(f"{seed}-jitter", *key), F.lit(jitter + 1)).cast("int")
    return events.where(~skipped).withColumn("pos", moved).where("pos < num_frames")


def shifted_stream(stream: Column, seed: str, key: Column, chance: float, left: tuple[int, int], right: tuple[int, int], pad: int) -> Column:
    """The stream, with some chance shifted to a side by a number of frames from that side's range."""
    to_right = F.pmod(hashing.number(f"{seed}-side", key), F.lit(2)) == 1
    draw = hashing.number(f"{seed}-by", key)
    size = lambda r: F.greatest(F.lit(1), r[0] + F.pmod(draw, F.lit(r[1] - r[0] + 1))).cast("int")
    by = F.when(to_right, size(right)).otherwise(-size(left))
    return F.when(hashing.uniform(f"{seed}-shift", key) < chance, arrays.shift(stream, by, pad)).otherwise(stream)


def assistant_turn_numbers(turns: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, assistant_turns: how many assistant turns there were up to each turn."""
    upto = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "speaker", F.count_if(F.col("speaker") == "B").over(upto).alias("assistant_turns"))
