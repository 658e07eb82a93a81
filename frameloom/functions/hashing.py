"""Randomness as a function of seed and key, the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 7


def number(seed: str, *keys: Column) -> Column:
    """A whole number below 16 ** DIGITS."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def uniform(seed: str, *keys: Column) -> Column:
    return number(seed, *keys) / float(16**DIGITS)


def token_of(word: Column, vocabulary: int = 32000, reserved: int = 5) -> Column:
    """A stand-in token for a word, above the reserved ones."""
    return F.lit(reserved) + F.pmod(F.conv(F.substring(F.md5(word), 1, DIGITS), 16, 10).cast("bigint"), F.lit(vocabulary - reserved))


def prefix_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The first n rows in hash order, with rank: a larger n keeps what a smaller one took."""
    ranked = df.select(key, number(seed, F.col(key)).alias("draw"))
    top = ranked.orderBy("draw", key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("draw", key))).select(key, "rank")


def weighted_pick(df: DataFrame, key: str, choices: list[tuple[str, int]], seed: str) -> Column:
    """One of the choices by weight, from the key's hash."""
    total, low, pick = sum(w for _, w in choices), 0, F.lit(None).cast("string")
    draw = F.pmod(number(seed, F.col(key)), F.lit(total))
    for name, weight in choices:
        pick = F.when((draw >= low) & (draw < low + weight), name).otherwise(pick)
        low += weight
    return pick


def shard(key: Column, shards: int, seed: str) -> Column:
    return F.pmod(number(seed, key), F.lit(shards))
