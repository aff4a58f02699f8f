"""Posterior shares of paralogs among hits, the call they give, and reciprocal search."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from ..schema import ROW

EXACT = 12  # names up to which all combinations are columns of an expression


def shares(hits: DataFrame, query: str, bits: str, marks: dict[str, Column], temperature: float = 1.0) -> DataFrame:
    """For each query: post_<name>, the share of 2^(bits/T) of the hits that a mark is true for.

    T doubles until the sum of weights is finite. A hit may count for several names; a query without a
    true mark has 0. A first aggregation finds the most bits, which say how many doublings can be needed; a
    second has the sums for each of them, of which the first finite counts.
    """
    b = F.coalesce(F.col(bits), F.lit(0.0)).cast("double")
    most = hits.agg(F.max(b)).first()[0] or 0.0
    if not math.isfinite(most):
        raise ValueError("bit scores must be finite")
    # 2^512 and less can be added up 2^511 times
    doublings = 1 + max(0, math.ceil(math.log2(max(most, 1e-300) / (512 * temperature))))
    weight = lambda k: F.pow(F.lit(2.0), b / (temperature * 2.0**k))
    names = sorted(marks)
    aggs = [F.sum(weight(k)).alias(f"_t{k}") for k in range(doublings)]
    aggs += [F.sum(F.when(marks[n], weight(k)).otherwise(0.0)).alias(f"_s{i}_{k}") for i, n in enumerate(names) for k in range(doublings)]
    sums = hits.groupBy(query).agg(*aggs)
    finite = lambda k: ~F.col(f"_t{k}").isin(float("inf"))
    pick = lambda f: F.coalesce(*[F.when(finite(k), f(k)) for k in range(doublings)])
    return sums.select(query, *[pick(lambda k, i=i: F.col(f"_s{i}_{k}") / F.col(f"_t{k}")).alias(f"post_{n}") for i, n in enumerate(names)])


def _walk(shares_: list[float], drop: float) -> tuple[float, tuple[int, ...]]:
    """The walk of call() over the combinations of the names with a share; a name without one changes no sum."""
    have = [i for i, p in enumerate(shares_) if p]
    sums = [(sum(shares_[i] for i in c), -n, c) for n, c in enumerate(c for k in range(1, len(have) + 1) for c in itertools.combinations(have, k))]
    if not sums:
        return 0.0, ()
    sums.sort(key=lambda x: (-x[0], x[1]))
    best = sums[0]
    for x in sums[1:]:
        if abs(best[0]) > 1e-8 and x[0] / best[0] > drop:
            best = x
    return best[0], best[2]


def _call_many(posts: DataFrame, names: list[str], least: float, drop: float) -> DataFrame:
    """call() for many names: the combinations of those that a row has a share of, row by row in Arrow batches."""

    @F.pandas_udf("p double, title string")
    def walk(x: pd.Series) -> pd.DataFrame:
        got = [_walk([v or 0.0 for v in row], drop) for row in x]
        return pd.DataFrame({"p": [p for p, _ in got], "title": ["/".join(names[i] for i in c) for _, c in got]})

    held = posts.withColumn("_best", walk(F.array(*[F.coalesce(F.col(f"post_{n}"), F.lit(0.0)) for n in names])))
    found = F.col("_best.p") > least
    return held.select(*posts.columns, F.when(found, F.col("_best.title")).alias("paralog"), found.alias("found"), F.col("_best.p").alias("prob"))


def call(posts: DataFrame, names: list[str], min_call_prob: float = 0.95, drop: float = 0.9) -> DataFrame:
    """Add paralog, found and prob: the walk over all combinations of names.

    Combinations of one, two, ... names in lexicographic order are numbered and sorted by (sum of shares,
    number), largest first; the best moves on to each one whose sum is more than drop times the best's,
    unless that is within 1e-8 of 0. It is accepted above min_call_prob.
    """
    names = sorted(names)
    if len(names) > EXACT:
        return _call_many(posts, names, min_call_prob, drop)
    combos = [c for k in range(1, len(names) + 1) for c in itertools.combinations(range(len(names)), k)]

    def total(c: tuple[int, ...]) -> Column:
        out = F.col(f"post_{names[c[0]]}")
        for i in c[1:]:
            out = out + F.col(f"post_{names[i]}")
        return out

    scored = F.reverse(F.array_sort(F.array(*[F.struct(F.coalesce(total(c), F.lit(0.0)).alias("p"), F.lit(i).alias("i")) for i, c in enumerate(combos)])))
    better = lambda a, x: (F.abs(a["p"]) > 1e-8) & (F.try_divide(x["p"], a["p"]) > drop)
    held = posts.withColumn("_scored", scored)
    held = held.withColumn("_best", F.aggregate(F.slice("_scored", 2, len(combos)), F.get("_scored", F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a)))
    title = F.get(F.array(*[F.lit("/".join(names[i] for i in c)) for c in combos]), F.col("_best.i"))
    found = F.col("_best.p") > min_call_prob
    return held.select(*posts.columns, F.when(found, title).alias("paralog"), found.alias("found"), F.col("_best.p").alias("prob"))


def recip_calls(hits: DataFrame, patterns: list[Pattern], temperature: float = 1.0, min_call_prob: float = 0.95, drop: float = 0.9, query: str = "query") -> DataFrame:
    """The call for each query, with its best hit: the first of those with most bits, over all hits."""
    marks = {p.name: p.matches(F.col("hit_def")) for p in patterns}
    if ROW not in hits.columns:
        hits = hits.withColumn(ROW, F.monotonically_increasing_id())
    real = hits.where(F.col("hit_def").isNotNull())
    top = real.groupBy(query).agg(F.max_by(F.struct("hit_def", "bits"), F.struct("bits", -F.col(ROW))).alias("_top"))
    called = call(shares(real, query, "bits", marks, temperature), list(marks), min_call_prob, drop).join(top, query)
    return called.select(
        query,
        F.col("found").alias("recip_found_paralog"),
        F.col("_top.hit_def").alias("recip_hit"),
        F.col("paralog").alias("recip_paralog"),
        F.col("prob").alias("recip_prob_match"),
        F.col("_top.bits").alias("recip_bit_score"),
    )


def apply_calls(df: DataFrame, calls: DataFrame, key: str = "uid", query: str = "query") -> DataFrame:
    """Join calls to kept rows; rows not found are kept no more, always-kept rows are, under their name."""
    out = df.join(calls.withColumnRenamed(query, "_q"), (df[key] == F.col("_q")) & F.col("keep"), "left").drop("_q")
    out = out.withColumn("recip_found_paralog", F.when(F.col("keep"), F.coalesce("recip_found_paralog", F.lit(False))))
    out = out.withColumn("keep", F.col("keep") & F.coalesce("recip_found_paralog", F.lit(False)))
    if "always_keep" in df.columns:
        always = F.coalesce("always_keep", F.lit(False))
        out = out.withColumn("keep", F.col("keep") | always).withColumn("recip_paralog", F.when(always & F.col("recip_paralog").isNull(), F.col("name")).otherwise(F.col("recip_paralog")))
    return out


def paralog_counts(df: DataFrame, column: str = "recip_paralog") -> DataFrame:
    return df.where("keep").groupBy(column).agg(F.count("*").alias("n"))
