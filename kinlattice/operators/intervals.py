"""Islands of overlapping closed intervals, and the merge of overlapping hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import parse_header
from ..schema import QUALITY_FLAGS, ROW


def islands(df: DataFrame, by: list[str], start: str, end: str, into: str = "island") -> DataFrame:
    """Number the connected groups of closed intervals in each partition, from 1 by start.

    A running maximum of the ends so far: a start beyond it opens a new island. That is the transitive
    closure of overlap, without a self-join.
    """
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(into, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def fold_labels(starts: list, ends: list) -> list[int]:
    """Labels of overlapping rows in the order of pairs i < j; -1 for rows without overlap.

    The label of j (itself if unset) is the target; an unset i takes it, and otherwise all rows with the
    label of i do.
    """
    n = len(starts)
    label = [-1] * n
    members: dict[int, set[int]] = {}
    for i in range(n):
        for j in range(i + 1, n):
            if starts[i] > ends[j] or starts[j] > ends[i]:
                continue
            if label[j] < 0:
                label[j] = j
                members.setdefault(j, set()).add(j)
            target = label[j]
            if label[i] < 0:
                label[i] = target
                members[target].add(i)
            elif label[i] != target:
                moved = members.pop(label[i])
                for k in moved:
                    label[k] = target
                members[target] |= moved
    return label


def merge_hits(hits: DataFrame, representative: str = "fold", key: str = "accession") -> DataFrame:
    """One row for each cluster of hits of an accession that overlap; others stay as they are.

    It spans the cluster, has its least e-value, and 'query|start-end' of all its hits in row order. Its
    other columns come from the row whose label the fold leaves ('fold'), or from the longest hit
    ('longest', all in built-in functions). Islands are found first, so the fold sees one island at a time.
    """
    if ROW not in hits.columns:
        hits = hits.withColumn(ROW, F.monotonically_increasing_id())
    held = islands(hits, [key], "subject_start", "subject_end", "_island")
    if representative == "fold":
        schema = held.select(key, "_island", ROW).schema

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ROW)
            label = fold_labels(pdf["subject_start"].tolist(), pdf["subject_end"].tolist())
            chosen = sorted({x for x in label if x >= 0})[:1] or [0]
            return pdf.iloc[chosen][[key, "_island", ROW]]

        several = held.groupBy(key, "_island").agg(F.count("*").alias("_m")).where("_m > 1")
        rep = held.join(several, [key, "_island"]).select(key, "_island", ROW, "subject_start", "subject_end").groupBy(key, "_island").applyInPandas(one, schema)
        single = held.join(several, [key, "_island"], "left_anti").select(key, "_island", ROW)
        rep = rep.unionByName(single)
    else:
        rep = held.groupBy(key, "_island").agg(F.max_by(ROW, F.struct(F.col("subject_end") - F.col("subject_start"), -F.col(ROW))).alias(ROW))
    said = F.concat(F.col("query"), F.lit("|"), F.col("subject_start").cast("string"), F.lit("-"), F.col("subject_end").cast("string"))
    merged = held.groupBy(key, "_island").agg(
        F.min("subject_start").alias("_s"),
        F.max("subject_end").alias("_e"),
        F.min("e_value").alias("_v"),
        F.count("*").alias("_n"),
        F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct(ROW, said.alias("q")))), lambda x: x["q"])).alias("_q"),
    )
    out = hits.join(rep, [key, ROW]).join(merged, [key, "_island"])
    many = F.col("_n") > 1
    fields = {"subject_start": "_s", "subject_end": "_e", "e_value": "_v", "query": "_q"}
    return out.select(*[F.when(many, F.col(fields[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(f"`{c}`") for c in hits.columns])


def merge_and_annotate(frames: list[DataFrame], sources: list[str] | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """Union of hit tables with parsed titles and flags, merged, with full sequences where they are known.

    sequences: accession, sequence. Hits whose title can't be read, or whose sequence isn't there, go.
    """
    from ..functions.text import flags

    marked = []
    for i, f in enumerate(frames):
        f = f.where(F.col("accession").isNotNull()).withColumn("blast_source", F.lit(sources[i] if sources else f"source_{i}"))
        marked.append(f)
    out = marked[0]
    for f in marked[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.withColumn("_p", parse_header(F.col("title"), F.col("accession"))).where(F.col("_p").isNotNull())
    out = out.select(*[c for c in out.columns if c != "_p"], F.col("_p.species").alias("species"), F.col("_p.name").alias("name"), F.col("_p.line").alias("line"), *flags(F.col("_p.line")))
    out = merge_hits(out).withColumnRenamed("sequence", "subject_sequence")
    if sequences is not None:
        out = out.join(sequences.select("accession", "sequence"), "accession", "left").where(F.col("sequence").isNotNull())
    return out


def seed_and_hits(seed: DataFrame, hits: DataFrame) -> DataFrame:
    """Union by name; hits are neither key species nor always kept."""
    out = seed.unionByName(hits, allowMissingColumns=True)
    for c in ("always_keep", "key_species", *QUALITY_FLAGS):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out
