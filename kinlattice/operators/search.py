"""Similarity search: shared k-mers by equi-join, then local alignment scores; top hits of a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import bit_score, e_value, local_score
from ..schema import ROW


def grams(items: Column, k: int) -> Column:
    """Distinct runs of k elements of an array, joined by blanks."""
    n = F.size(items) - k + 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(items, i, k), " "))
    return F.when(n > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def shared_grams(queries: DataFrame, rows: DataFrame, qkey: str, rkey: str, words: str, k: int, top: int) -> DataFrame:
    """qkey, rkey and shared: the rows with most distinct runs in common, by number and then key."""
    # the array is a column of its own before the runs are made, so that it is made once
    a = queries.select(qkey, F.explode(grams(F.col(words), k)).alias("g"))
    b = rows.select(rkey, F.explode(grams(F.col(words), k)).alias("g"))
    counts = a.join(b, "g").groupBy(qkey, rkey).agg(F.count("*").alias("shared"))
    w = Window.partitionBy(qkey).orderBy(F.desc("shared"), rkey)
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def kmer_index(db: DataFrame, k: int = 4, key: str = "accession", sequence: str = "sequence") -> DataFrame:
    """kmer, key, length and sequence: write it bucketed by kmer to search it without moving it again."""
    rows = db.select(key, sequence, F.length(sequence).alias("length"))
    at = F.sequence(F.lit(1), F.greatest(F.length(sequence) - (k - 1), F.lit(1)))
    return rows.select(key, "length", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(F.col(sequence), i, F.lit(k))))).alias("kmer"))


def search(queries: DataFrame, db: DataFrame, hitlist: int = 100, cutoff: float = 0.001, k: int = 4, least_shared: int = 2) -> DataFrame:
    """Hits of queries (query, sequence) in db (accession, hit_def, sequence): bits, e_value and places.

    All pairs that share at least least_shared k-mers are scored by local alignment, and those with an e-value
    up to cutoff stay, hitlist a query. Scores are of this engine's own rule, not those of
    a search program.
    """
    qi = kmer_index(queries.select(F.col("query").alias("accession"), "sequence"), k).select(F.col("accession").alias("query"), "kmer")
    di = kmer_index(db, k)
    counts = qi.join(di, "kmer").groupBy("query", "accession").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    letters = db.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("n")).first()["n"]
    rows = counts.join(queries.select("query", F.col("sequence").alias("qs")), "query").join(db.select("accession", "hit_def", F.col("sequence").alias("hs")), "accession")

    @F.pandas_udf("raw int, query_end int, subject_end int")
    def scored(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_score(a, b) for a, b in zip(q, s, strict=True)], columns=["raw", "query_end", "subject_end"])

    @F.pandas_udf("bits double, e_value double")
    def rated(raw: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(bit_score(r), e_value(r, m, letters)) for r, m in zip(raw, n, strict=True)], columns=["bits", "e_value"])

    out = rows.withColumn("_s", scored("qs", "hs")).withColumn("_v", rated("_s.raw", F.length("qs")))
    out = out.select("query", "accession", "hit_def", F.col("_v.bits").alias("bits"), F.col("_v.e_value").alias("e_value"), F.col("_s.query_end").alias("query_end"), F.col("_s.subject_end").alias("subject_end"))
    top = Window.partitionBy("query").orderBy(F.desc("bits"), "accession")
    return out.where(F.col("e_value") <= cutoff).withColumn(ROW, F.row_number().over(top)).where(F.col(ROW) <= hitlist)


def in_query_order(hits: DataFrame, query: str = "query") -> DataFrame:
    """Hits by the number at the end of their query's name, then by rank."""
    return hits.orderBy(F.regexp_extract(query, r"(\d+)$", 1).cast("long"), ROW)
