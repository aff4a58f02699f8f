"""FASTA: records as rows, tables as records, protein databases' headers as seed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_sequence
from ..schema import ROW, TableError


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """row_id, header and sequence; files may be gzipped.

    Split by the reader at '>' at a line's start, so records don't meet in the driver; a '>' within a header stays.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    header = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return raw.select(F.monotonically_increasing_id().alias(ROW), header.alias("header"), body.alias("sequence"))


def records(spark: SparkSession, lines: list[str]) -> DataFrame:
    """The same from lines in memory."""
    text = "\n".join(x.rstrip("\n") for x in lines)
    rows = []
    for i, part in enumerate(p for p in ("\n" + text).split("\n>") if p.strip()):
        head, _, body = part.partition("\n")
        rows.append((i, head.strip(), "".join(body.split())))
    return spark.createDataFrame(rows, f"{ROW} long, header string, sequence string")


def to_fasta(df: DataFrame, sequence: str | None = None, label_columns: list[str] = ("species", "name"), only_kept: bool = True, empty: str = "X-?", clean: bool = False) -> DataFrame:
    """row_id and value, the record of each row: '>uid|labels', newline, sequence.

    The sequence column is alignment where there is one. Rows whose sequence has only the empty signs go.
    """
    seq = sequence or ("alignment" if "alignment" in df.columns else "sequence")
    missing = [c for c in (seq, "uid", *label_columns) if c not in df.columns]
    if missing:
        raise TableError(f"columns are missing: {missing}")
    rows = df.where("keep") if only_kept and "keep" in df.columns else df
    s = clean_sequence(F.col(seq)) if clean else F.col(seq)
    rows = rows.where(F.translate(F.col(seq), empty, "") != "")
    labels = F.concat_ws("|", "uid", *[F.col(c).cast("string") for c in label_columns if c != "uid"])
    row = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    return rows.select(row.alias(ROW), F.concat(F.lit(">"), labels, F.lit("\n"), s).alias("value"))


def write_fasta(df: DataFrame, path: str, overwrite: bool = False, **how) -> None:
    out = to_fasta(df, **how)
    if out.isEmpty():
        raise TableError("no sequence is left to write")
    out.orderBy(ROW).select("value").coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def read_into(df: DataFrame, fasta: DataFrame, column: str = "alignment", unkeep_missing: bool = True) -> DataFrame:
    """Join sequences to rows by the uid before the first bar of the header.

    Unknown and repeated uids are errors. Kept rows that the file lacks are kept no more.
    """
    f = fasta.select(F.split("header", r"\|")[0].alias("_uid"), F.col("sequence").alias("_seq"))
    if not f.groupBy("_uid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise TableError("a uid occurs twice in the file")
    if not f.join(df.select(F.col("uid").alias("_uid")), "_uid", "left_anti").isEmpty():
        raise TableError("the file has a uid that the table lacks")
    out = df.drop(column).join(f, F.col("uid") == F.col("_uid"), "left").withColumnRenamed("_seq", column)
    if unkeep_missing:
        out = out.withColumn("keep", F.col("keep") & F.col(column).isNotNull())
    return out.drop("_uid")


def table_from_fasta(fasta: DataFrame, species: str = "unknown") -> DataFrame:
    return fasta.select(ROW, F.lit(species).alias("species"), F.col("header").alias("name"), "sequence", F.lit(True).alias("keep"))


def _key(header: Column, name: str) -> Column:
    """Value of KEY=value in a header, up to the next KEY=."""
    return F.nullif(F.trim(F.regexp_extract(header, rf"\b{name}=(.*?)(?:\s+[A-Z]{{2}}=|$)", 1)), F.lit(""))


def protein_seed(fasta: DataFrame) -> DataFrame:
    """species, name, aliases and sequence of headers 'db|accession|entry protein name OS= OX= GN= PE= SV='.

    The name is the gene's, or the entry's without one. Aliases are accession, entry and protein name; one
    that came before, in any case of letters, isn't said again, nor is one that is a name met so far.
    """
    h = F.col("header")
    first = F.split(F.split(h, r"\s+")[0], r"\|")
    protein = F.trim(F.regexp_extract(h, r"^\S+\s+(.*?)(?:\s+[A-Z]{2}=|$)", 1))
    entry = F.get(first, F.lit(2))
    rows = fasta.select(ROW, "sequence", _key(h, "OS").alias("species"), F.coalesce(_key(h, "GN"), entry).alias("name"), F.array(F.get(first, F.lit(1)), entry, protein).alias("al"))
    long = rows.select(ROW, F.posexplode("al").alias("ord", "alias")).where("alias IS NOT NULL AND alias <> ''")
    lead = long.groupBy(F.lower("alias").alias("low")).agg(F.min(F.struct(ROW, "ord", "alias")).alias("m"))
    named = rows.groupBy(F.lower("name").alias("low")).agg(F.min(ROW).alias("named_at"))
    stay = lead.join(named, "low", "left").where(F.col("named_at").isNull() | (F.col("named_at") > F.col(f"m.{ROW}")))
    per = stay.groupBy(F.col(f"m.{ROW}").alias(ROW)).agg(F.sort_array(F.collect_list(F.struct("m.ord", "m.alias"))).alias("a"))
    out = rows.join(per, ROW, "left")
    return out.select(ROW, "species", "name", F.array_join(F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>")), ";").alias("aliases"), "sequence")
