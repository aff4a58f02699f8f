"""Column statistics of alignments, and the rows they speak against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_even, rank_cutoff
from ..functions.text import clean_sequence
from .validate import rescued


def columns_of(df: DataFrame, key: list[str], column: str = "alignment") -> DataFrame:
    """Long form: key, pos (from 0) and aa."""
    return df.select(*key, F.posexplode(F.split(column, "")).alias("pos", "aa"))


def sparse_columns(long: DataFrame, cutoff: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """For each position: n, the share of gaps, and whether it is at least cutoff; positions of gaps alone go."""
    per = long.groupBy(*(by or []), "pos").agg(F.count("*").alias("n"), F.sum((F.col("aa") == "-").cast("long")).alias("gaps"))
    return per.where("gaps < n").withColumn("fx_gap", F.col("gaps") / F.col("n")).withColumn("sparse", F.col("fx_gap") >= cutoff)


def trim_bounds(width: Column, front: float, back: float) -> tuple[Column, Column]:
    """Half-even products of the width; at least one position wide."""
    a, b = half_even(width * front), half_even(width * back)
    equal = a == b
    return F.when(equal & (a > 0), a - 1).otherwise(a), F.when(equal & (a <= 0), b + 1).otherwise(b)


def score(df: DataFrame, key: str = "uid", column: str = "alignment", cutoff: float = 0.8, trim: tuple[float, float] = (0.1, 0.9), by: list[str] | None = None) -> DataFrame:
    """key, fx_in_sparse, fx_missing_dense and sparse_run_length of each kept row.

    Sparse: residues in sparse columns over all columns; missing: gaps in dense columns over dense ones
    (NaN without dense columns); run: the most residues in a run of neighbouring sparse columns.
    """
    by = by or []
    a, b = trim_bounds(F.length(column), *trim)
    rows = df.where("keep") if "keep" in df.columns else df
    cut = rows.select(*by, key, clean_sequence(F.substr(F.col(column), (a + 1).cast("int"), (b - a).cast("int"))).alias("_ali"))
    long = columns_of(cut, [*by, key], "_ali")
    per = sparse_columns(long, cutoff, by)
    # runs of neighbouring columns with one state, among the columns that are left
    w = Window.partitionBy(*by).orderBy("pos")
    per = per.withColumn("_rank", F.row_number().over(w)).withColumn("_run", F.col("_rank") - F.row_number().over(Window.partitionBy(*by, "sparse").orderBy("pos")))
    joined = long.join(per.select(*by, "pos", "sparse", "_run"), [*by, "pos"])
    residue = (F.col("aa") != "-").cast("long")
    runs = joined.groupBy(*by, key, "sparse", "_run").agg(F.count("*").alias("cols"), F.sum(residue).alias("res"))
    s = F.col("sparse")
    out = runs.groupBy(*by, key).agg(
        (F.sum(F.when(s, F.col("res")).otherwise(0)) / F.sum("cols")).alias("fx_in_sparse"),
        F.sum(F.when(~s, F.col("cols") - F.col("res")).otherwise(0)).alias("_miss"),
        F.sum(F.when(~s, F.col("cols")).otherwise(0)).alias("_dense"),
        F.max(F.when(s, F.col("res")).otherwise(0)).alias("sparse_run_length"),
    )
    return out.select(*by, key, "fx_in_sparse", F.coalesce(F.try_divide("_miss", "_dense"), F.lit(float("nan"))).alias("fx_missing_dense"), "sparse_run_length")


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding: for each partition the runs' number, value, first place and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_was", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    placed = placed.withColumn("run", F.sum(F.when(F.col("_was").isNull() | ~F.struct(F.col(value).alias("v")).eqNullSafe(F.col("_was")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(*by, "run").agg(F.first(value).alias("value"), F.min("_at").alias("start"), F.count("*").alias("length"))


def polish_rule(scores: DataFrame, partial: str = "partial", fx_sparse: float = 0.9, run: float = 0.9, fx_missing: float = 0.9) -> DataFrame:
    """Add drop: rows at or over both sparse cutoffs, or partial rows at or over the missing cutoff.

    The cutoffs are order statistics of the scores, which are kept for the four uses that are made of them;
    a run cutoff of 0 means none.
    """
    scores = scores.persist()  # until the session drops it: the result reads it when it is computed
    c = rank_cutoff(scores, "fx_in_sparse", fx_sparse).select(F.col("cutoff").alias("_c1"))
    c = c.crossJoin(rank_cutoff(scores, "sparse_run_length", run).select(F.col("cutoff").cast("double").alias("_c2")))
    c = c.crossJoin(rank_cutoff(scores, "fx_missing_dense", fx_missing).select(F.col("cutoff").alias("_c3")))
    joined = scores.crossJoin(F.broadcast(c))  # one row
    run_cut = F.when(F.col("_c2") == 0, float("inf")).otherwise(F.col("_c2"))
    drop = ((F.col("fx_in_sparse") >= F.col("_c1")) & (F.col("sparse_run_length") >= run_cut)) | ((F.col("fx_missing_dense") >= F.col("_c3")) & F.coalesce(F.col(partial), F.lit(False)))
    return joined.withColumn("drop", drop).drop("_c1", "_c2", "_c3")


def polish(df: DataFrame, cutoff: float = 0.8, trim: tuple[float, float] = (0.0, 1.0), fx_sparse: float = 0.9, run: float = 0.9, fx_missing: float = 0.9) -> DataFrame:
    """keep turns false for rows that polish_rule drops; always-kept rows stay."""
    scores = score(df, cutoff=cutoff, trim=trim)
    partial = F.coalesce(F.col("partial"), F.lit(False)) if "partial" in df.columns else F.lit(False)
    marked = polish_rule(scores.join(df.select("uid", partial.alias("partial")), "uid"), fx_sparse=fx_sparse, run=run, fx_missing=fx_missing)
    out = df.join(marked.select("uid", "drop"), "uid", "left")
    return rescued(out.withColumn("keep", F.col("keep") & ~F.coalesce("drop", F.lit(False))).drop("drop"))


def bad_columns(long: DataFrame) -> DataFrame:
    """Positions at which every sequence has '-' or 'X'."""
    return long.groupBy("pos").agg(F.min(F.col("aa").isin("-", "X").cast("int")).alias("bad")).where("bad = 1").select("pos")


def progressive(df: DataFrame, by: list[str] | None = None, key: str = "uid", sequence: str = "sequence") -> DataFrame:
    """key and alignment: each group aligned progressively, nearest sequence first, against the profile.

    An approximation for groups of at most a few thousand sequences, each aligned in one task.
    """
    by = by or []
    held = df.where("keep") if "keep" in df.columns else df
    held = held.select(*by, key, sequence) if by else held.select(F.lit(0).alias("_all"), key, sequence)
    group = by or ["_all"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.sequences import align_group

        out = pdf.drop(columns=[sequence])
        out["alignment"] = align_group(pdf[sequence].tolist())
        return out

    schema = held.drop(sequence).withColumn("alignment", F.lit("")).schema
    out = held.groupBy(*group).applyInPandas(one, schema)
    return out if by else out.drop("_all")
