"""Line dedup: remove boilerplate lines that many distinct sites share.

Lines are what lies between newlines, without spaces at either end; blank lines are never counted or
removed. Each line's hash gets a HyperLogLog sketch of its sites; partial sketches merge in the
aggregation, so that a line that stands in a third of all documents is one small row for each task.
Where the estimate lies within BAND of the threshold, the distinct sites of those lines are counted
exactly. A line found on min_sites sites or more is taken out of every document. With spare_copies a
document that has no other line than such ones stays whole: it is a copy as a whole, which is for
document dedup to judge; a single line of its own is enough to lose the others. The query has that off.

Lines are shuffled as their hashes with a place, never as text, and only those whose slot of a map of
fixed size holds a line over the threshold. A line that stands in a third of all documents is one key
of that join: lines of more than SALTED places are dealt over salts on both sides.

DataFrame functions only. Defined cases: null sites don't count; null text stays null; a text keeps
its other lines, blank ones too, in order; repeated rows keep their number and get equal results; very
long texts are lists of lines like any; sketches have no ties, and counts at the threshold are over it;
an empty table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Slots, hash128, nested, salted, staged, table

MIN_SITES = 10
BAND = 0.25
LG_K = 12
SALTED = 2_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """Non-blank lines as two hashes, with their place."""
    out = docs.select(*keep, F.posexplode(lines_of(text)).alias("pos", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    h1, h2 = hash128(F.col("line"))
    return out.withColumns({"h1": h1, "h2": h2}).drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """h1, h2 and places (in rows that have a site) of the lines that stand on at least min_sites distinct sites."""
    rows = _exploded(docs.where(F.col(site).isNotNull()), F.col(text), F.col(site).alias("site"))
    sketches = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("s"), F.count("*").alias("places"))
    found = staged(sketches.select("h1", "h2", "places", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= min_sites * (1 - BAND)), "spread")
    sure = found.where(F.col("n") > min_sites * (1 + BAND)).select("h1", "h2", "places")
    near = found.where(F.col("n") <= min_sites * (1 + BAND)).select("h1", "h2", "places")
    pairs = rows.where(Slots(near, "h1").has(F.col("h1"))).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("places").alias("places"))
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("h1", "h2", "places"))


def mark(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", spare_copies: bool = False) -> DataFrame:
    """row (a struct of docs' columns) and done(n_lines, n_removed, left_whole, kept): kept is the text that remains."""
    r1, r2 = hash128(F.col(key), F.col(text))
    held = nested(docs, r1=r1, r2=r2)
    body = F.col("row").getField(text)
    wanted = staged(boilerplate(docs, min_sites, text, site), "boilerplate")
    salts = salted(wanted, "h1", "places", SALTED)(F.col("h1"))
    own = _exploded(held, body, F.col("r1"), F.col("r2")).where(Slots(wanted, "h1").has(F.col("h1")))
    own = own.withColumn("salt", F.pmod(F.xxhash64("r1", "pos"), salts).cast("int"))
    copies = wanted.select("h1", "h2", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    places = own.join(copies, ["h1", "h2", "salt"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("pos").alias("at"))
    places = staged(places, "places")
    maybe = Slots(places, "r1").has(F.col("r1"))  # rows that lose nothing stay where they are
    joined = held.where(maybe).join(places, ["r1", "r2"], "left").unionByName(held.where(~maybe).withColumn("at", F.lit(None).cast("array<int>")))
    joined = joined.withColumn("lines", F.when(F.col("at").isNotNull(), lines_of(body)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    joined = joined.withColumn("stay", F.when(F.col("at").isNotNull(), F.transform(stay, lambda i: F.get("lines", i))))
    none_own = F.col("at").isNotNull() & ~F.exists(F.coalesce("stay", F.array()), lambda x: F.trim(x) != "")
    whole = F.coalesce(none_own, F.lit(False)) if spare_copies else F.lit(False)
    n_lines = F.coalesce(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    joined = joined.withColumn("whole", whole)
    same = F.col("whole") | F.col("at").isNull()
    return joined.select(
        "row",
        F.struct(
            n_lines.cast("long").alias("n_lines"),
            F.when(same, 0).otherwise(F.size("at")).cast("long").alias("n_removed"),
            F.col("whole").alias("left_whole"),
            F.when(same, body).otherwise(F.array_join("stay", "\n")).alias("kept"),
        ).alias("done"),
    )


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", spare_copies: bool = False) -> DataFrame:
    """docs with their text less boilerplate; the same columns and rows."""
    marked = mark(docs, min_sites, key, text, site, spare_copies)
    return marked.select(*[(F.col("done.kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = F.coalesce("done.kept", F.lit(""))
    return mark(docs).select(
        "row.doc_id",
        "done.n_lines",
        "done.n_removed",
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        F.length(kept).cast("long").alias("kept_chars"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT trim(line, ' ') AS k FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), d AS (
  SELECT doc_id, source, text, count(*) AS n_lines, sum((b.k IS NOT NULL)::INT) AS hit,
    coalesce(string_agg(CASE WHEN b.k IS NULL THEN line END, chr(10) ORDER BY pos), '') AS rest
  FROM l LEFT JOIN b ON trim(line, ' ') = b.k GROUP BY ALL
)
SELECT o.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(hit, 0)::BIGINT AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256, length(coalesce(rest, ''))::BIGINT AS kept_chars
FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id AND o.text = d.text AND o.source IS NOT DISTINCT FROM d.source
"""
