"""Checks and coercions of sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_uid
from ..schema import REQUIRED, ROW, TableError

TRUE, FALSE = "(?i)[1yt]", "(?i)[0nf]"


def to_bool(df: DataFrame, column: str) -> Column:
    """Boolean of a column; null where its text says both or neither of yes and no.

    Text is searched for 1, y or t and for 0, n or f; whole numbers are true unless 0; other numbers are
    true unless they are within 1e-8 of 0, and NaN is true.
    """
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.IntegralType):
        return c != 0
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > 1e-8)
    yes, no = c.rlike(TRUE), c.rlike(FALSE)
    return F.when(yes & ~no, True).when(no & ~yes, False)


def with_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row_id that keeps the arrival order; the order is a meaning here, so it is made once and kept."""
    if ROW in df.columns:
        return df
    return df.withColumn(ROW, F.monotonically_increasing_id()) if not order else df.withColumn(ROW, F.struct(*order))


def blank(df: DataFrame) -> Column:
    """True where every cell is null, NaN or blank."""
    cells = []
    for f in df.schema.fields:
        if f.name == ROW:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(F.trim(c), F.lit(""))
        elif isinstance(f.dataType, T.FractionalType):
            c = F.when(~F.isnan(c), c.cast("string"))
        else:
            c = c.cast("string")
        cells.append(c)
    return F.coalesce(*cells).isNull() if cells else F.lit(True)


def gap_only_positions(df: DataFrame, column: str = "alignment", keep: str = "keep") -> DataFrame:
    """One row: mask, a string with 1 where some kept row has a residue, 0 where all have gaps."""
    pos = df.where(F.col(keep) & F.col(column).isNotNull()).select(F.posexplode(F.split(column, "")).alias("pos", "aa"))
    per = pos.groupBy("pos").agg(F.max((F.col("aa") != "-").cast("int")).alias("some"))
    return per.agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", "some"))), lambda p: p["some"].cast("string"))).alias("mask"))


def drop_positions(seq: Column, mask: Column) -> Column:
    """The characters of seq where mask has 1."""
    return F.concat_ws("", F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.substr(mask, i, F.lit(1)) == "1"), lambda i: F.substr(seq, i, F.lit(1))))


def check_table(df: DataFrame, eager: bool = True) -> DataFrame:
    """A valid sequence table, or a TableError (at once, by one aggregation, if eager).

    Blank and repeated rows go; white space leaves sequences; keep defaults to true; a missing, wrong or
    repeated uid is made anew from the row; ott is 'ott' and digits or null; alignments of kept rows have
    one length and lose columns of gaps. Applying it twice changes nothing more.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise TableError(f"columns are missing: {missing}")
    out = with_rows(df)
    data = [c for c in out.columns if c != ROW]
    first = out.groupBy(*[F.col(f"`{c}`") for c in data]).agg(F.min(ROW).alias(ROW))
    out = first.where(~blank(first))
    bad: list[tuple[Column, str]] = []
    for c in REQUIRED:
        text = F.col(c).cast("string")
        bad.append((text.isNull() | (F.trim(text) == "") | (text == "0"), f"{c} is empty"))
        out = out.withColumn(c, text)
    out = out.withColumn("sequence", F.regexp_replace("sequence", r"\s+", ""))
    for c in ("keep", "always_keep"):
        if c in data:
            bad.append((F.col(f"_{c}").isNull() & F.col(f"`{c}`").isNotNull(), f"{c} is neither true nor false"))
            out = out.withColumn(f"_{c}", to_bool(out, c))
    if "ott" in data:
        held = F.when(F.lower(F.trim("ott")).isin("", "none"), None).otherwise(F.trim("ott"))
        bad.append((held.isNotNull() & ~held.rlike(r"^ott\d+$"), "ott is not 'ott' and a number"))
    keep = F.coalesce(F.col("_keep"), F.lit(True)) if "keep" in data else F.lit(True)
    if eager:
        checks = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"b{i}") for i, (c, _) in enumerate(bad)]
        if "alignment" in data:
            checks.append(F.countDistinct(F.when(keep & F.col("alignment").isNotNull(), F.length("alignment"))).alias("widths"))
        seen = out.agg(*checks).first()
        wrong = [said for i, (_, said) in enumerate(bad) if seen[f"b{i}"]]
        if "alignment" in data and (seen["widths"] or 0) > 1:
            wrong.append("kept alignments have different lengths")
        if wrong:
            raise TableError("; ".join(wrong))
    out = out.withColumn("keep", keep)
    if "always_keep" in data:
        out = out.withColumn("always_keep", F.coalesce("_always_keep", F.lit(False)))
    if "ott" in data:
        out = out.withColumn("ott", held)
    out = out.drop("_keep", "_always_keep")
    fresh = text_uid(*[F.col(f"`{c}`").cast("string") for c in data], F.col(ROW))
    if "uid" in data:
        often = out.groupBy("uid").agg(F.count("*").alias("_n"))
        out = out.join(often.where("_n = 1").select(F.col("uid").alias("_one")), F.col("uid") == F.col("_one"), "left")
        out = out.withColumn("uid", F.when(F.col("_one").isNotNull() & F.col("uid").rlike("^[A-Za-z]{10}$"), F.col("uid")).otherwise(fresh)).drop("_one")
    else:
        out = out.withColumn("uid", fresh)
    if "alignment" in data:
        mask = gap_only_positions(out)
        out = out.crossJoin(F.broadcast(mask)).withColumn("alignment", F.when(F.length("alignment") == F.length("mask"), drop_positions(F.col("alignment"), F.col("mask"))).otherwise(F.col("alignment"))).drop("mask")
    head = [c for c in ["nickname", "keep", *REQUIRED] if c in out.columns]
    rest = [c for c in data if c not in head]
    tail = [c for c in ("uid",) if c not in data]
    return out.select(ROW, *head, *[F.col(f"`{c}`") for c in rest], *tail)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns and fill nulls."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def rescued(df: DataFrame) -> DataFrame:
    """Rows that are always kept are kept."""
    return df.withColumn("keep", F.col("keep") | F.coalesce("always_keep", F.lit(False))) if "always_keep" in df.columns else df


def without_synthetic(df: DataFrame) -> DataFrame:
    return df.withColumn("keep", F.col("keep") & ~F.col("species").startswith("synthetic"))


def kept_only(df: DataFrame, kept: DataFrame, key: str = "uid") -> DataFrame:
    """keep becomes whether the key is in kept; always-kept rows stay."""
    marks = kept.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    out = df.join(marks, df[key] == marks["_k"], "left").withColumn("keep", F.coalesce("_in", F.lit(False))).drop("_k", "_in")
    return rescued(out)


def sliced(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end] with zero-based places; negative ones count from the end."""
    n = F.length(seq)
    a = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    b = F.least(F.when(end < 0, n + end).otherwise(end), n)
    return F.when(b > a, F.substr(seq, a + 1, b - a)).otherwise(F.lit(""))
