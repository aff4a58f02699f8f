"""Numeric expressions with the rounding and null rules that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Round to a whole number, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def rank_cutoff(df: DataFrame, value: str, pct: float = 0.975, by: list[str] | None = None) -> DataFrame:
    """The value at place min(half_even(n * pct), n - 1) of the ascending order, for each group.

    Groups are ranked by a window; without groups the place is found in a sorted range of the whole
    column, by counts of a value histogram, so that no task sees all rows.
    """
    rows = df.where(F.col(value).isNotNull())
    keys = by or []
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(value)
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row
    place = F.least(half_even(F.col("_n") * pct), F.col("_n") - 1)
    placed = joined.withColumn("_upto", F.sum("_c").over(w)).where((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place))
    return placed.select(*keys, F.col(value).alias("cutoff"), F.col("_n").alias("n"))


def binned_cutoff(values: list[float], avg_bin_contents: int, pct: float) -> float:
    """Smallest bin midpoint whose cumulative share reaches pct, for a small list on the driver."""
    n = len(values)
    bins = max(1, round(n / avg_bin_contents))
    low, high = min(values), max(values)
    width = (high - low) / bins or 1.0
    held = [0] * bins
    for v in values:
        held[min(int((v - low) / width), bins - 1)] += 1
    seen = 0
    for i, c in enumerate(held):
        seen += c
        if seen / n >= pct:
            return low + (i + 0.5) * width
    return high


def modal_bin(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Left edge of the fullest of half_even(2 sqrt n) equal bins between minimum and maximum; the first on ties."""
    keys = by or []
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count("*").alias("n"))
    stats = stats.withColumn("_bins", F.greatest(half_even(2 * F.sqrt(F.col("n"))), F.lit(1))).withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.col("_bins"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    joined = counts.join(stats, keys) if keys else counts.crossJoin(F.broadcast(stats))
    b = F.when(F.col("_w") == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_w"), F.lit(0.0))), F.col("_bins") - 1)).cast("long")
    per = joined.withColumn("_b", b).groupBy(*keys, "_b", "_lo", "_w", "n").agg(F.sum("_c").alias("_c"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("_b", "_lo", "_w", "n", "_c"), F.struct("_c", -F.col("_b"))).alias("m"))
    return best.select(*keys, (F.col("m._lo") + F.col("m._b") * F.col("m._w")).alias("left_edge"), F.col("m._c").alias("in_bin"), F.col("m.n").alias("n"))


def digits_to_round(value: float, total: int = 2) -> int:
    """How many decimals show total significant digits of value; 0 for large numbers."""
    if value == 0 or not math.isfinite(value):
        return 0
    return max(0, total - 1 - math.floor(math.log10(abs(value))))


def compare_versions(have: tuple[int, ...], need: tuple[int, ...]) -> int:
    """-1, 0 or 1; missing places count as 0."""
    size = max(len(have), len(need))
    a, b = (tuple(x) + (0,) * (size - len(x)) for x in (have, need))
    return (a > b) - (a < b)


def entropy(p: Column) -> Column:
    """Shannon entropy in nats of an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def scaled(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] to [to_low, to_high], clamped; the middle where low equals high."""
    if low == high:
        return F.lit((to_low + to_high) / 2)
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.lit(to_low) + t * (to_high - to_low)
