"""PHYLIP alignments with alternating name and sequence lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import ROW, TableError


def to_phylip(df: DataFrame, column: str = "alignment", key: str = "uid", only_kept: bool = True, empty: str = "X-?") -> DataFrame:
    """ord and value: a header 'count width', then a name and a sequence line for each row that isn't empty."""
    rows = df.where("keep") if only_kept and "keep" in df.columns else df
    rows = rows.where(F.translate(F.col(column), empty, "") != "")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.length(column)).alias("a"), F.max(F.length(column)).alias("b")).first()
    if not seen["n"]:
        raise TableError("no sequence is left to write")
    if seen["a"] != seen["b"]:
        raise TableError("sequences have different lengths")
    row = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    body = rows.select(row.alias("ord"), F.concat(F.col(key), F.lit("\n"), F.col(column)).alias("value"))
    head = df.sparkSession.createDataFrame([(-1, f"{seen['n']} {seen['a']}\n")], "ord long, value string")
    return head.unionByName(body.withColumn("ord", F.col("ord").cast("long")))


def write_phylip(df: DataFrame, path: str, overwrite: bool = False, **how) -> None:
    to_phylip(df, **how).orderBy("ord").select("value").coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """file, row_id, uid and alignment: each file is one record, its lines paired by position."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    lines = whole.select("file", F.filter(F.slice("lines", 2, F.size("lines")), lambda x: F.trim(x) != "").alias("l"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("l") / 2) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.trim(F.get("l", 2 * i)).alias("uid"), F.trim(F.get("l", 2 * i + 1)).alias("alignment")))
    out = lines.where(F.size("l") >= 2).select("file", F.posexplode(pairs).alias(ROW, "p"))
    return out.select("file", ROW, "p.uid", "p.alignment")


def paired(df: DataFrame, order: str, value: str = "value") -> DataFrame:
    """uid and alignment of consecutive line pairs of one file that is already rows."""
    w = Window.orderBy(order)
    held = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_next", F.lead(value).over(w))
    return held.where("_n % 2 = 0").select((F.col("_n") / 2).cast("long").alias(ROW), F.col(value).alias("uid"), F.col("_next").alias("alignment"))
