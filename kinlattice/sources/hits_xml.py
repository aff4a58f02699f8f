"""Search results in XML: one row for each query and hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ROW, TableError

# fixed values: the elements that are read
HSP = "struct<`Hsp_bit-score`:double,Hsp_evalue:double,`Hsp_hit-from`:int,`Hsp_hit-to`:int,`Hsp_query-from`:int,`Hsp_query-to`:int,Hsp_hseq:string>"
HIT = f"struct<Hit_id:string,Hit_def:string,Hit_accession:string,Hit_len:int,Hit_hsps:struct<Hsp:array<{HSP}>>>"
ITERATION = f"`Iteration_query-def` string, Iteration_message string, Iteration_hits struct<Hit:array<{HIT}>>"
LIMIT = "CPU usage limit was exceeded"


def clean_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each file without blank lines and lines that say CREATE_VIEW."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    return whole.select("file", F.array_join(F.filter("l", lambda x: (F.trim(x) != "") & ~x.contains("CREATE_VIEW")), "\n").alias("text"))


def iterations(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """file and one row a query, by the XML reader; with clean the texts are mended first, file by file."""
    if not clean:
        return spark.read.format("xml").option("rowTag", "Iteration").schema(ITERATION).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    text = clean_lines(spark, path)
    whole = F.regexp_extract_all("text", F.lit(r"(?s)(<Iteration>.*?</Iteration>)"), F.lit(1))
    cut = text.select("file", F.explode(whole).alias("x"))
    return cut.select("file", F.from_xml("x", ITERATION).alias("i")).select("i.*", "file")


def over_limit(rows: DataFrame) -> DataFrame:
    """Files in which a query ran over the server's time."""
    return rows.where(F.coalesce(F.col("Iteration_message").contains(LIMIT), F.lit(False))).select("file").distinct()


def to_hits(rows: DataFrame) -> DataFrame:
    """Hit table with the first alignment of each hit; a query without hits is a row of nulls."""
    held = rows.withColumn(ROW, F.monotonically_increasing_id())
    h = held.select(ROW, F.col("`Iteration_query-def`").alias("query"), F.posexplode_outer("Iteration_hits.Hit").alias("ord", "h"))
    s = F.get(F.col("h.Hit_hsps.Hsp"), F.lit(0))
    return h.select(
        ROW,
        "ord",
        F.col("h.Hit_accession").alias("accession"),
        F.col("h.Hit_def").alias("hit_def"),
        F.col("h.Hit_id").alias("hit_id"),
        F.when(F.col("h").isNotNull(), F.concat_ws(" ", "h.Hit_id", "h.Hit_def")).alias("title"),
        F.col("h.Hit_len").alias("length"),
        s["Hsp_evalue"].alias("e_value"),
        s["Hsp_bit-score"].alias("bits"),
        F.replace(s["Hsp_hseq"], F.lit("-"), F.lit("")).alias("sequence"),
        s["Hsp_hit-from"].alias("subject_start"),
        s["Hsp_hit-to"].alias("subject_end"),
        s["Hsp_query-from"].alias("query_start"),
        s["Hsp_query-to"].alias("query_end"),
        "query",
    )


def read_hits(spark: SparkSession, path: str, check_limit: bool = False, clean: bool = False) -> tuple[DataFrame | None, list[str]]:
    """Hits of a file or a folder of XML files; with check_limit (None, files) where a limit was met."""
    rows = iterations(spark, path, clean)
    if rows.isEmpty():
        raise TableError(f"{path} holds no search result")
    if check_limit:
        bad = sorted(r["file"] for r in over_limit(rows).collect())  # one row a file
        if bad:
            return None, bad
    return to_hits(rows), []
