"""Stand-ins for remote services: offline tables with the services' columns.

A deployment fills these tables from its own mirror; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_strain
from ..schema import ROW, TableError


def accession(ids: Column) -> Column:
    """'pdb|1STN|A' as '1STN_A', other bars by their second last field, without a version."""
    f = F.split(ids, r"\|")
    pdb = F.concat_ws("_", F.get(f, F.lit(1)), F.get(f, F.lit(2)))
    return F.when(f[0] == "pdb", pdb).when(F.size(f) > 2, F.get(f, F.size(f) - 2)).otherwise(ids)


def fetch_sequences(wanted: DataFrame, store: DataFrame, key: str = "accession") -> DataFrame:
    """key and sequence in the order asked for, null where the store (accession, sequence) lacks it."""
    held = wanted.select(ROW, F.col(key).alias("asked"), accession(F.col(key)).alias("_a")) if ROW in wanted.columns else wanted.select(F.monotonically_increasing_id().alias(ROW), F.col(key).alias("asked"), accession(F.col(key)).alias("_a"))
    s = store.select(accession(F.col("accession")).alias("_a"), "sequence").dropDuplicates(["_a"])
    return held.join(s, "_a", "left").select(ROW, F.col("asked").alias(key), "sequence")


def taxon_ids(species: DataFrame, names: DataFrame, column: str = "species") -> DataFrame:
    """species and taxid of distinct species without their strain; one that isn't known is an error."""
    wanted = species.select(F.lower(without_strain(F.col(column))).alias("k"), column).distinct()
    out = wanted.join(names.select(F.lower("name").alias("k"), "taxid"), "k", "left")
    if not out.where("taxid IS NULL").isEmpty():
        raise TableError("a species has no taxon id")
    return out.select(column, "taxid")


# fixed values: preference of assembly classes and of places to get them from
CLASSES = ["reference genome", "representative genome", "na"]
PLACES = ["refseq", "genbank"]


def choose_assembly(assemblies: DataFrame, by: str = "taxid") -> DataFrame:
    """The best assembly of each taxon: by class, place, date (oldest first) and address."""
    rank = lambda c, xs: F.array_position(F.array(*[F.lit(x) for x in xs]), F.lower(c))
    last = lambda r: F.when(r > 0, r).otherwise(99)
    when = F.try_to_timestamp(F.regexp_replace("date", "/", "-"))
    return assemblies.groupBy(by).agg(F.min_by(F.struct("assembly", "url"), F.struct(last(rank(F.col("refseq_class"), CLASSES)), last(rank(F.col("place"), PLACES)), when, "url")).alias("b")).select(by, "b.assembly", "b.url")


def checksums(spark, path: str) -> DataFrame:
    """path and md5 of files, to hold against a published list."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def read_md5_list(spark, path: str) -> DataFrame:
    """file and md5 of lines 'md5  ./file'."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace(F.get(p, F.lit(1)), r"^\./", "").alias("file"), p[0].alias("md5"))


def batches(df: DataFrame, size: int, length: Column, order: str = ROW) -> DataFrame:
    """batch numbers so that a batch's summed length is about size: consecutive rows by running sum."""
    from pyspark.sql.window import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("batch", F.floor(F.coalesce(F.sum(length).over(w), F.lit(0)) / size).cast("long"))
