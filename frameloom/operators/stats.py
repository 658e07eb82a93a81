"""Corpus reports: rates, quantiles, survival, comparisons of variants and their significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(hits: Column, of: Column) -> Column:
    return F.when(of > 0, hits / of)


def frequency(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts of a column's values, most common first, ties in the values' order."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(k) if k else counts


def nearest_rank(df: DataFrame, column: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """The value at index floor(n * q / 100) of the sorted column, the last one at most, for each q.

    Values are counted first, so one row for each distinct value is sorted, not one for each row.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(column)
    counts = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(*by))})
    asked = counts.withColumn("q", F.explode(F.array(*[F.lit(q) for q in percents])))
    at = F.least(F.floor(F.col("n") * F.col("q") / 100), F.col("n") - 1)
    return asked.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select(*by, "q", F.col(column).alias("value"))


def survival(df: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """How many rows reach each threshold, in one pass."""
    counts = df.agg(*[F.count_if(F.col(column) >= t).alias(f"t{t}") for t in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds])).alias("x")).select("x.*")


def banded(df: DataFrame, column: str, edges: list[int]) -> Column:
    band = F.lit(0)
    for n, edge in enumerate(edges, 1):
        band = F.when(F.col(column) >= edge, n).otherwise(band)
    return band


def top_of_group(df: DataFrame, group: str, order: list[Column | str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def paired_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference, its standard error, and whether it is at least two of those from zero."""
    d = F.col(a) - F.col(b)
    out = df.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumn("significant", F.abs("mean") >= 2 * F.col("se"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts and z = (b - c) / sqrt(b + c); null without any."""
    only_a, only_b = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    out = df.agg(only_a.alias("only_a"), only_b.alias("only_b"))
    z = F.when(F.col("only_a") + F.col("only_b") > 0, (F.col("only_a") - F.col("only_b")) / F.sqrt(F.col("only_a") + F.col("only_b")))
    return out.withColumn("z", z).withColumn("significant", F.abs("z") >= 2)


def two_level_means(df: DataFrame, item: str, groups: list[str], score: str, latency: str) -> DataFrame:
    """Per item mean score and median latency over its runs, then unweighted means, rolled up over the groups."""
    items = df.groupBy(item, *groups).agg(F.avg(score).alias("score"), F.median(latency).alias("latency"))
    return items.rollup(*groups).agg(F.count("*").alias("items"), F.avg("score").alias("score"), F.avg("latency").alias("latency"))


def ends_of_series(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Mean of the first and of the last k values of each series, k a fifth of it, one at least."""
    w = Window.partitionBy(series)
    ranked = df.withColumns({"rn": F.row_number().over(w.orderBy(order)), "n": F.count("*").over(w)})
    k = F.greatest(F.floor(F.col("n") / 5), F.lit(1))
    return ranked.withColumn("k", k).groupBy(series).agg(
        F.avg(F.when(F.col("rn") <= F.col("k"), F.col(value))).alias("first_mean"),
        F.avg(F.when(F.col("rn") > F.col("n") - F.col("k"), F.col(value))).alias("last_mean"))


def usage(df: DataFrame, keys: list[str], seconds: str, failed: Column) -> DataFrame:
    """Calls, failures, total and mean seconds for each key; no mean where nothing succeeded."""
    ok = F.count_if(~failed)
    return df.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.round(F.sum(seconds), 6).alias("seconds"),
        F.round(F.when(ok > 0, F.sum(seconds) / ok), 6).alias("seconds_per_item"))


def weighted_mean(df: DataFrame, value: Column, weight: Column) -> DataFrame:
    return df.agg((F.sum(value * weight) / F.sum(weight)).alias("weighted"))


def renormalized_probability(df: DataFrame, group: str, logit: str, target: Column, k: int, temperature: float) -> DataFrame:
    """Of each group the target's rank, and its share of the exponentials of the k largest logits."""
    order = Window.partitionBy(group).orderBy(F.desc(logit), "vec_id")
    ranked = df.withColumns({"rank": F.row_number().over(order), "e": F.exp((F.col(logit) - F.max(logit).over(Window.partitionBy(group))) / temperature)})
    return ranked.groupBy(group).agg(
        F.min(F.when(target, F.col("rank"))).alias("rank"),
        (F.coalesce(F.sum(F.when(target & (F.col("rank") <= k), F.col("e"))), F.lit(0.0)) / F.sum(F.when(F.col("rank") <= k, F.col("e")))).alias("p"))


def rank_shares(df: DataFrame, rank: str, p: str, ranks: tuple[int, ...] = (1, 10, 25)) -> DataFrame:
    """n, p_median, p_mean, rank_median and the shares of rows up to each rank."""
    shares = [F.avg((F.col(rank) <= k).cast("int")).alias(f"top_{k}") for k in ranks]
    return df.agg(F.count("*").alias("n"), F.median(p).alias("p_median"), F.avg(p).alias("p_mean"), F.median(rank).alias("rank_median"), *shares)


def at_least_once(df: DataFrame, by: str, p: str) -> DataFrame:
    """<by>, p_any: the probability of one hit or more, from those of independent trials."""
    return df.groupBy(by).agg((1.0 - F.product(1.0 - F.col(p))).alias("p_any"))


def false_triggers(df: DataFrame, targets: DataFrame, by: str, at: str, p: str) -> DataFrame:
    """<by>, expected: the sum of probabilities outside of the targets (<by>, <at>)."""
    return df.join(targets.select(by, at).distinct(), [by, at], "left_anti").groupBy(by).agg(F.sum(p).alias("expected"))


def micro_accuracy(df: DataFrame, condition: str, hit: Column, special: Column) -> DataFrame:
    """<condition>, n, accuracy, special_n, special_accuracy over all rows of a condition, and over its special ones."""
    return df.groupBy(condition).agg(
        F.count("*").alias("n"), F.avg(hit.cast("int")).alias("accuracy"), F.count_if(special).alias("special_n"), F.avg(F.when(special, hit.cast("int"))).alias("special_accuracy"))


def from_reference(piece: Column, reference: Column, lead: Column) -> Column:
    """Whether a piece is in the reference, and not in the lead that was said before it."""
    plain = F.regexp_replace(piece, "▁", "")
    return (plain != "") & reference.contains(plain) & ~lead.contains(plain)


def retention(closed: Column, opened: Column, compressed: Column) -> Column:
    """What share of the gain from closed to open the compressed form keeps; null without a gain."""
    return F.when(opened > closed, (compressed - closed) / (opened - closed))
