"""The three entry points: seed to alignment, alignment to ancestors, bootstrap reconciliation.

Every stage writes its table as Parquet in the output folder and reads it again, which cuts lineage and
is where a restart goes on: a stage whose table is there is not run again. Search, alignment, tree and
reconciliation programs are replaced by this engine's own approximations; see the README for their limits.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Pattern, build_patterns, with_nicknames
from ..functions.sequences import lcs_length
from ..operators import alignment, ancestors, budgets, dedup, intervals, models, posterior, search, taxonomy, trees, validate
from ..schema import ROW, TableError
from ..sources.newick import Node, node_table, parse, write


class Stages:
    """Tables of a pipeline, one folder each; restart keeps those that are complete."""

    def __init__(self, spark: SparkSession, out: str, restart: bool = False, overwrite: bool = False):
        if restart and overwrite:
            raise ValueError("restart and overwrite exclude one another")
        self.spark, self.out, self.restart = spark, out.rstrip("/"), restart
        self.mode = "overwrite" if overwrite else "error"
        self.ran: list[str] = []

    def _done(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str, make) -> DataFrame:
        path = f"{self.out}/{name}"
        if not (self.restart and self._done(path)):
            make().write.mode("overwrite" if self.restart else self.mode).parquet(path)
            self.ran.append(name)
        return self.spark.read.parquet(path)


def read_seed(seed: DataFrame, species_aware: bool | None = None) -> tuple[DataFrame, list[Pattern], bool]:
    """Seed table with always_keep, key_species and aliases_regex; patterns of its names; species awareness.

    Without a choice the species count unless all of them are microbial (a column is_microbial says so).
    """
    df = seed.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in seed.columns])
    missing = [c for c in ("species", "name", "aliases", "sequence") if c not in df.columns]
    if missing:
        raise TableError(f"columns are missing: {missing}")
    rows = df.select("name", "aliases").distinct().orderBy("name", "aliases").collect()  # a seed has a few dozen rows
    aliases: dict[str, list[str]] = {}
    for r in rows:
        aliases.setdefault(r["name"].strip(), []).extend(a.strip() for a in (r["aliases"] or "").split(";") if a.strip())
    patterns = build_patterns(aliases)
    regex = F.create_map(*[F.lit(x) for p in patterns for x in (p.name, p.regex)])
    key = F.coalesce(validate.to_bool(df, "key_species"), F.lit(True)) if "key_species" in df.columns else F.lit(True)
    out = df.withColumn("name", F.trim("name")).withColumn("aliases_regex", F.element_at(regex, F.col("name"))).withColumn("key_species", key).withColumn("always_keep", F.lit(True)).withColumn("keep", F.lit(True))
    if species_aware is None:
        species_aware = not (bool(out.agg(F.min("is_microbial")).first()[0]) if "is_microbial" in out.columns else False)
    return validate.check_table(out), patterns, species_aware


def table_from_seed(seed: DataFrame, database: DataFrame, names: DataFrame | None = None, species_aware: bool | None = None, hitlist: int = 500, cutoff: float = 0.001) -> tuple[DataFrame, list[Pattern]]:
    """Seed rows and their hits in a database (accession, title, sequence) as one sequence table."""
    rows, patterns, aware = read_seed(seed, species_aware)
    found = search.search(rows.select(F.col("uid").alias("query"), "sequence"), database.select("accession", F.col("title").alias("hit_def"), "sequence"), hitlist, cutoff)
    hits = found.join(database.select("accession", "title", "sequence"), "accession").select("accession", "title", "query", "bits", "e_value", F.lit(1).alias("subject_start"), F.length("sequence").alias("subject_end"), "sequence")
    merged = intervals.merge_and_annotate([hits], ["database"], database)
    new = merged.select("accession", "species", "name", "sequence", "e_value", *[c for c in ("structure", "low_quality", "predicted", "precursor", "isoform", "hypothetical", "partial")]).withColumn("keep", F.lit(True))
    out = validate.check_table(validate.without_synthetic(intervals.seed_and_hits(rows.drop(ROW), new)))
    out = taxonomy.add_species_ids(out, names, species_aware=aware and names is not None)
    return with_nicknames(out, patterns), patterns


def reciprocal(df: DataFrame, proteomes: DataFrame, patterns: list[Pattern], hitlist: int = 10, cutoff: float = 0.01, min_call_prob: float = 0.95, temperature: float = 1.0, drop: float = 0.9) -> DataFrame:
    """Search kept rows in the key species' proteomes (accession, hit_def, sequence) and apply the calls."""
    hits = search.search(df.where("keep").select(F.col("uid").alias("query"), "sequence"), proteomes, hitlist, cutoff)
    return posterior.apply_calls(df, posterior.recip_calls(hits, patterns, temperature, min_call_prob, drop))


def shrink(df: DataFrame, species_tree: Node | None, paralog: str = "recip_paralog", per_column: int = 1, most: int = 500, species_aware: bool = True, redundancy: float = 0.96) -> DataFrame:
    """Redundancy inside species, then inside merge blocks, then the best aligners of each block's budget."""
    longest = df.where("keep AND key_species").agg(F.max(F.length("sequence"))).first()[0] or df.agg(F.max(F.length("sequence"))).first()[0] or 0
    target = round(min(longest * per_column, most) * 1.1)
    out = dedup.shrink_in_species(df, 0.98)
    if not species_aware or species_tree is None:
        cutoff = dedup.find_redundancy_cutoff(out, round(1.15 * target))
        out = dedup.remove_redundancy(out, cutoff)
        blocks = out.where("keep").select("uid", F.lit(0).alias("block"), F.lit(target).alias("budget"))
    else:
        kept = out.where("keep").select("uid", "ott", F.coalesce(F.col(paralog), F.lit("unassigned")).alias("p")).groupBy("p", "ott").agg(F.sort_array(F.collect_list("uid")).alias("u")).collect()  # one row a paralog and species
        per: dict[str, dict[str, list[str]]] = {}
        for r in kept:
            per.setdefault(r["p"], {})[r["ott"]] = r["u"]
        many: dict[str, Node] = {}
        for p, uids in per.items():
            t = parse(write(species_tree))
            for leaf in t.leaves():
                leaf.props["uids"] = uids.get(leaf.name, [])
            many[p] = t
        rows = budgets.merge_blocks(many, target)
        blocks = df.sparkSession.createDataFrame(rows or [("", 0, 0, "")], "paralog string, block long, budget long, uid string").select("uid", "block", "budget")
        out = dedup.shrink_blocks(out, blocks, redundancy)
    rows = out.where("keep").join(blocks, "uid")
    aligned = alignment.progressive(rows.select("block", "uid", "sequence"), ["block"])
    scores = alignment.score(aligned, "uid", "alignment", trim=(0.0, 1.0), by=["block"])
    scored = rows.join(scores, ["block", "uid"]).withColumn("fx_missing_dense", F.nanvl("fx_missing_dense", F.lit(0.0))).withColumn("_score", budgets.aligner_score("block"))
    best = budgets.top_of_blocks(scored, "block", F.col("_score"), F.col("budget"), F.coalesce("key_species", F.lit(False)), ROW)
    done = validate.kept_only(out, best).where("keep")
    if done.isEmpty():
        raise TableError("no sequence is left")
    return done


def align(df: DataFrame) -> DataFrame:
    ali = alignment.progressive(df).select("uid", F.col("alignment").alias("_ali"))
    return df.drop("alignment").join(ali, "uid", "left").withColumnRenamed("_ali", "alignment")


def seed_to_alignment(spark: SparkSession, seed: DataFrame, database: DataFrame, proteomes: DataFrame, out: str, names: DataFrame | None = None, species_tree: Node | None = None, restart: bool = False, overwrite: bool = False, most: int = 500) -> DataFrame:
    s = Stages(spark, out, restart, overwrite)
    _, patterns, _ = read_seed(seed)
    initial = s.table("03_initial", lambda: table_from_seed(seed, database, names)[0])
    called = s.table("04_recip", lambda: reciprocal(initial, proteomes, patterns))
    small = s.table("05_shrunk", lambda: shrink(called, species_tree, most=most, species_aware=species_tree is not None))
    aligned = s.table("06_aligned", lambda: align(small))
    return s.table("07_clean", lambda: align(alignment.polish(aligned).where("keep")))


def alignment_to_ancestors(spark: SparkSession, df: DataFrame, out: str, species_tree: str | None = None, replicates: int = 100, cutoff: float = 0.25, restart: bool = False, overwrite: bool = False, bootstrap: bool = True) -> dict[str, DataFrame]:
    """Tables tree, sites, summary, and reconciled and support where asked for.

    An alignment of a few thousand rows is small: the one tree is made on the driver, its sites and
    replicates by the cluster. Reconciliation needs a species tree and ott in every kept row.
    """
    s = Stages(spark, out, restart, overwrite)
    rows = df.where("keep")
    one = rows.withColumn("replicate", F.lit(0))
    gene = s.table("01_gene_tree", lambda: models.distance_trees(one))
    newick = gene.first()["newick"]
    results = {"tree": gene}
    may = species_tree is not None and "ott" in df.columns and rows.where("ott IS NULL").isEmpty()
    if may:
        leaf = {r["uid"]: r["ott"] for r in rows.select("uid", "ott").collect()}
        rooted = spark.createDataFrame([(0, write(trees.midpoint_root(parse(newick))))], "tree_id long, newick string")
        results["reconciled"] = s.table("03_reconciled", lambda: models.reconcile_trees(rooted, species_tree, leaf))
    results["sites"] = s.table("02_ancestors", lambda: infer_sites(rows, newick, cutoff))
    results["summary"] = s.table("02_summary", lambda: ancestors.summary(results["sites"], cutoff))
    if bootstrap:
        results["support"] = s.table("05_bootstraps", lambda: bootstrap_support(rows, newick, replicates))
    return results


def infer_sites(rows: DataFrame, newick: str, cutoff: float = 0.25, chunk: int = 200) -> DataFrame:
    """Site table of a tree's inner nodes: posteriors and gaps of chunks of sites, each chunk a task's work."""
    import pandas as pd

    tree = trees.midpoint_root(parse(newick))
    for i, n in enumerate(n for n in tree.preorder() if n.children):
        n.name = f"anc{i + 1}"
    text = write(tree)
    long = rows.select("uid", F.posexplode(F.split("alignment", "")).alias("site", "aa"))
    sites = long.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("uid", "aa"))).alias("m"))

    def run(batches):
        t = parse(text)
        for b in batches:
            for i in range(0, len(b), chunk):
                part = b.iloc[i : i + chunk]
                maps = [dict(m) for m in part["m"]]
                names, p = models.marginal_posteriors(t, {n.name: "".join(m.get(n.name, "-") for m in maps) for n in t.leaves()})
                for name, q in zip(names, p, strict=True):
                    yield pd.DataFrame({"anc": name, "site": part["site"].to_numpy(), "p": list(q)})

    post = sites.mapInPandas(run, "anc string, site long, p array<double>")
    gaps = ancestors.ancestral_gaps(ancestors.gap_columns(rows), text)
    return ancestors.site_table(post, gaps, cutoff)


def bootstrap_support(rows: DataFrame, newick: str, replicates: int, seed: int = 1) -> DataFrame:
    reps = models.distance_trees(models.resampled(rows, replicates, seed=seed))
    base = rows.sparkSession.createDataFrame([(0, newick)], "tree_id long, newick string")
    return trees.support_of(node_table(base, rooted=False), node_table(reps, rooted=False))


def bootstrap_reconcile(spark: SparkSession, df: DataFrame, species_tree: str, out: str, replicates: int = 100, step: int = 50, cutoff: float = 0.03, restart: bool = False, overwrite: bool = False) -> dict[str, DataFrame]:
    """Replicates are resampled, joined to trees and reconciled, step by step, until their support converges."""
    s = Stages(spark, out, restart, overwrite)
    rows = df.where("keep")
    leaf = {r["uid"]: r["ott"] for r in rows.select("uid", "ott").collect()}
    parts: list[DataFrame] = []
    verdict = None
    for first in range(0, replicates, step):
        n = min(step, replicates - first)

        def make(first: int = first, n: int = n) -> DataFrame:
            drawn = models.resampled(rows, first + n).where(F.col("replicate") >= first)
            found = models.distance_trees(drawn)
            return models.reconcile_trees(rooted(found), species_tree, leaf)

        parts.append(s.table(f"replicates_{first:06d}", make))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        verdict = trees.wrf_convergence(node_table(every, rooted=False), [first + n], cutoff)
        if first + n >= 2 * step and verdict.first()["converged"]:
            break
    return {"replicates": every, "convergence": verdict}


def rooted(found: DataFrame) -> DataFrame:
    @F.udf("string")
    def root(text: str) -> str:
        return write(trees.midpoint_root(parse(text)))

    return found.withColumn("newick", root("newick"))


def similarity(a: str, b: str) -> float:
    return lcs_length(a, b) / min(len(a), len(b))


def exists(path: str) -> bool:
    return Path(path).exists()
