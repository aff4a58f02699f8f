"""Tables in the logs and outputs of likelihood programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ancestors import STATES


def model_fit(spark: SparkSession, path: str) -> DataFrame:
    """file, L, AIC, AICc, BIC and N of each log."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    find = lambda pattern: F.max(F.expr(f"try_cast(nullif(regexp_extract(value, '{pattern}', 1), '') AS double)"))
    return lines.groupBy("file").agg(
        find(f"Final LogLikelihood: *{number}").alias("L"),
        find(f"(?:^|[^A-Za-z])AIC score: *{number}").alias("AIC"),
        find(f"AICc score: *{number}").alias("AICc"),
        find(f"BIC score: *{number}").alias("BIC"),
        find(f"Free parameters[^:]*: *{number}").alias("N"),
    )


def convergence(spark: SparkSession, path: str) -> DataFrame:
    """trees, avg_wrf, avg_wrf_pct, perms_below_cutoff, converged (the last verdict, in every row) and converged_at."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^[0-9]+ +[0-9.]+ +[0-9.]+ +[0-9]+ +(YES|NO)$"))
    out = rows.select(cells[0].cast("long").alias("trees"), cells[1].cast("double").alias("avg_wrf"), cells[2].cast("double").alias("avg_wrf_pct"), cells[3].cast("long").alias("perms_below_cutoff"), (cells[4] == "YES").alias("converged_at"))
    every = Window.orderBy("trees").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("converged", F.last("converged_at").over(every))


def posterior_table(spark: SparkSession, path: str) -> DataFrame:
    """anc, site from 0 and p, from a tab-separated table Node, Site, State, p_A ... p_V."""
    names = ", ".join(["Node string", "Site int", "State string", *[f"p_{s} double" for s in STATES]])
    df = spark.read.csv(path, sep="\t", header=True, schema=names)
    return df.select(F.col("Node").alias("anc"), (F.col("Site") - 1).alias("site"), F.array(*[F.col(f"p_{s}") for s in STATES]).alias("p"))


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """event and n of lines 'key:value'."""
    return spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(F.substring_index("value", ":", 1)).alias("event"), F.expr("try_cast(trim(substring_index(value, ':', -1)) AS long)").alias("n"))
