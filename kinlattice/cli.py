"""Command line: python -m kinlattice.cli COMMAND ... (spark-submit works as well)."""

from __future__ import annotations

import argparse
import shutil

from .session import session
from .sources import fasta, tables
from .sources.newick import parse

# fixed values: programs that a deployment may use in place of this engine's approximations
PROGRAMS = ["blastp", "makeblastdb", "muscle", "raxml-ng", "generax", "mpirun"]


def installed() -> dict[str, str | None]:
    return {p: shutil.which(p) for p in PROGRAMS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinlattice")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("check-installed")
    a = c.add_parser("seed-to-alignment")
    for x in ("seed", "database", "proteomes", "out"):
        a.add_argument(x)
    b = c.add_parser("alignment-to-ancestors")
    for x in ("table", "out"):
        b.add_argument(x)
    d = c.add_parser("bootstrap-reconcile")
    for x in ("table", "species_tree", "out"):
        d.add_argument(x)
    for x in (b, d):
        x.add_argument("--replicates", type=int, default=100)
    b.add_argument("--species-tree")
    b.add_argument("--no-bootstrap", action="store_true")
    for x in (a, b, d):
        x.add_argument("--restart", action="store_true")
        x.add_argument("--overwrite", action="store_true")
    e = c.add_parser("table-from-fasta")
    e.add_argument("fasta")
    e.add_argument("out")
    e.add_argument("--species", default="unknown")
    f = c.add_parser("fasta-into-table")
    for x in ("table", "fasta", "out"):
        f.add_argument(x)
    f.add_argument("--column", default="alignment")
    g = c.add_parser("proteins-to-seed")
    g.add_argument("fasta")
    g.add_argument("out")
    h = c.add_parser("create-report")
    h.add_argument("results")
    h.add_argument("out")
    for x in (e, f, g, h):
        x.add_argument("--overwrite", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "check-installed":
        for name, where in installed().items():
            print(name, where or "not found")
        return 0
    from .plans import pipeline, report

    spark = session("kinlattice-cli")
    if a.command == "table-from-fasta":
        tables.write_table(fasta.table_from_fasta(fasta.read_fasta(spark, a.fasta), a.species), a.out, a.overwrite)
    elif a.command == "proteins-to-seed":
        tables.write_table(fasta.protein_seed(fasta.read_fasta(spark, a.fasta)), a.out, a.overwrite, validate=False)
    elif a.command == "fasta-into-table":
        tables.write_table(fasta.read_into(tables.read_table(spark, a.table), fasta.read_fasta(spark, a.fasta), a.column), a.out, a.overwrite)
    elif a.command == "seed-to-alignment":
        db = database(spark, a.database)
        pipeline.seed_to_alignment(spark, tables.read_table(spark, a.seed, validate=False), db, database(spark, a.proteomes).withColumnRenamed("title", "hit_def"), a.out, restart=a.restart, overwrite=a.overwrite)
    elif a.command == "alignment-to-ancestors":
        tree = spark.read.text(a.species_tree).first()[0] if a.species_tree else None
        pipeline.alignment_to_ancestors(spark, tables.read_table(spark, a.table), a.out, tree, a.replicates, restart=a.restart, overwrite=a.overwrite, bootstrap=not a.no_bootstrap)
    elif a.command == "bootstrap-reconcile":
        pipeline.bootstrap_reconcile(spark, tables.read_table(spark, a.table), spark.read.text(a.species_tree).first()[0], a.out, a.replicates, restart=a.restart, overwrite=a.overwrite)
    elif a.command == "create-report":
        tree = parse(spark.read.parquet(f"{a.results}/01_gene_tree").first()["newick"])
        sites = spark.read.parquet(f"{a.results}/02_ancestors")
        names = [r["anc"] for r in sites.select("anc").distinct().orderBy("anc").collect()]  # one row an inner node
        report.write_report(a.out, "Results", [report.tree_card("Gene tree", tree), *[report.ancestor_card(n, sites) for n in names]], a.overwrite)
    return 0


def database(spark, path: str):
    """accession, title and sequence of a FASTA file or folder."""
    from pyspark.sql import functions as F

    f = fasta.read_fasta(spark, path)
    return f.select(F.split("header", r"\s+")[0].alias("accession"), F.concat(F.lit(">"), F.when(F.col("header").contains("|"), F.col("header")).otherwise(F.concat(F.lit("db|"), F.regexp_replace("header", r"\s+", "| ")))).alias("title"), "sequence")


if __name__ == "__main__":
    raise SystemExit(main())
