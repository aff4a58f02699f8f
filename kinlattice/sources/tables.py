"""Sequence tables from and to delimited files and spreadsheets."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import check_table
from ..schema import ROW, TableError

SHEETS = (".xlsx", ".xls")


def delimiter(first_line: str) -> str:
    """The delimiter of a header line: the sniffer's, or the most frequent of comma, tab, semicolon and bar."""
    try:
        return csv.Sniffer().sniff(first_line, ",\t;|").delimiter
    except csv.Error:
        return max(",\t;|", key=first_line.count)


def read_table(spark: SparkSession, path: str, remove_extra_index: bool = True, validate: bool = True) -> DataFrame:
    """A table by extension (csv, tsv, xlsx, xls), else by its first line; row_id keeps the order.

    A first column without name that counts the rows from 0 is an index that was written along, and goes.
    """
    low = path.lower()
    if low.endswith(SHEETS):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise TableError("spreadsheets need openpyxl") from e
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path))
    else:
        first = spark.read.text(path).limit(1).collect()
        if not first:
            raise TableError(f"{path} is empty")
        sep = "," if low.endswith(".csv") else "\t" if low.endswith(".tsv") else delimiter(first[0][0])
        df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=True)
    df = df.withColumn(ROW, F.monotonically_increasing_id())
    head = df.columns[0]
    if remove_extra_index and (head in ("_c0", "") or head.startswith("Unnamed:")):
        n = df.count()
        # a counting column has all of 0 .. n - 1: its least, largest and number of different values say so
        got = df.agg(F.min(F.col(f"`{head}`").cast("long")).alias("a"), F.max(F.col(f"`{head}`").cast("long")).alias("b"), F.countDistinct(f"`{head}`").alias("c")).first()
        if (got["a"], got["b"], got["c"]) == (0, n - 1, n):
            df = df.drop(head)
    return check_table(df) if validate else df


def write_table(df: DataFrame, path: str, overwrite: bool = False, single: bool = True, validate: bool = True) -> None:
    """Delimited text by extension, text in quotes; an existing path is an error unless overwrite."""
    out = check_table(df) if validate else df
    order = F.col(ROW) if ROW in out.columns else F.monotonically_increasing_id()
    ranked = out.withColumn("_order", order.cast("long")).drop(ROW)
    out = out.drop(ROW)
    low = path.lower()
    if low.endswith(SHEETS):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise TableError("spreadsheets need openpyxl") from e
        ranked.orderBy("_order").drop("_order").toPandas().to_excel(path, index=False)  # a spreadsheet holds about a million rows at most
        return
    text = [c for c, kind in out.dtypes if kind == "string"]
    sep = "\t" if low.endswith(".tsv") else ","
    quoted = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')))
    cells = [F.coalesce(quoted(c) if c in text else F.col(f"`{c}`").cast("string"), F.lit("")) for c in out.columns]
    mode = "overwrite" if overwrite else "error"
    if not single:
        out.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"').csv(path)
        return
    lines = ranked.select("_order", F.concat_ws(sep, *cells).alias("value"))
    header = df.sparkSession.createDataFrame([(-(1 << 62), sep.join('"' + c.replace('"', '""') + '"' for c in out.columns))], "_order long, value string")
    header.unionByName(lines).repartition(1).sortWithinPartitions("_order").select("value").write.mode(mode).text(path)
