"""Branch support and convergence while replicate trees arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.newick import parse, splits

SPLITS = "split_key string, n long"


def tree_stream(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """value: one newick a line, of files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).where(F.col("value").contains(";"))


def split_rows(trees: DataFrame, newick: str = "value") -> DataFrame:
    """split_key of each inner split of each tree, unrooted, and 'TREE' once a tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys: list[str] = []
            for text in b[newick]:
                keys.append("TREE")
                keys += {k for k, n in splits(parse(text), rooted=False) if n.children and k != "ROOT"}
            yield pd.DataFrame({"split_key": keys})

    return trees.select(newick).mapInPandas(run, "split_key string")


def running_support(trees: DataFrame, newick: str = "value") -> DataFrame:
    """split_key and n so far: a streaming aggregation, its state one row a split."""
    return split_rows(trees, newick).groupBy("split_key").agg(F.count("*").alias("n"))


class Halves:
    """Counts of splits in two halves of the replicates, kept between micro-batches in a table.

    Each micro-batch writes its counts under its epoch, so that a batch that is run again replaces its own,
    and a restarted query goes on from what the table has. Equal trees of a batch go to the halves in
    turn, whatever their places. The weighted distance of the halves, one aggregation of the table, tells
    whether more replicates would still change the support.
    """

    def __init__(self, folder: str, cutoff: float = 0.03, least: int = 50):
        self.folder, self.cutoff, self.least = folder.rstrip("/"), cutoff, least
        self.trees, self.history, self.done = 0, [], False

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.done:
            return
        text = batch.columns[0]
        rows = batch.groupBy(text).agg(F.count("*").alias("m")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m"))))
        rows = rows.select(text, F.pmod(F.xxhash64(text, F.lit(epoch)) + F.col("i"), F.lit(2)).cast("int").alias("half"))
        one = [split_rows(rows.where(F.col("half") == h), text).groupBy("split_key").agg(F.count("*").alias("n")).withColumn("half", F.lit(h)) for h in (0, 1)]
        one[0].unionByName(one[1]).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        held = batch.sparkSession.read.schema("split_key string, n long, half int, epoch int").parquet(self.folder)
        per = held.groupBy("split_key").agg(F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
        tree = F.col("split_key") == "TREE"
        seen = per.agg(
            F.sum(F.when(tree, F.col("n"))).alias("trees"),
            F.sum(F.when(~tree, F.abs(2 * F.col("a") - F.col("n")))).alias("d"),
            F.sum(F.when(~tree, F.col("n"))).alias("n"),
        ).first()
        self.trees = seen["trees"] or 0
        wrf = seen["d"] / seen["n"] if seen["n"] else 0.0
        self.done = self.trees >= self.least and wrf <= self.cutoff
        self.history.append((epoch, self.trees, wrf, self.done))


def follow(trees: DataFrame, state: Halves, checkpoint: str):
    """Start a query that feeds state and ends with the available files."""
    return trees.writeStream.foreachBatch(state).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
