"""Ancestral states: best and second states of posteriors, gaps by parsimony, site types, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import entropy
from ..sources.newick import Node, parse, write

# fixed values: order of probabilities in posterior tables, and residues that count as similar
STATES = list("ARNDCQEGHILKMFPSTWYV")
SIMILAR = ["ACFILMVWY", "NQST", "DE", "HKR", "G", "P"]


def best_two(p: Column, names: list[str]) -> Column:
    """struct(ml_state, ml_pp, alt_state, alt_pp): first maximum, and first maximum with that one set to 0."""
    states = F.array(*[F.lit(s) for s in names])
    top = F.array_max(p)
    at = F.array_position(p, top).cast("int")
    rest = F.transform(p, lambda x, i: F.when(i + 1 == at, 0.0).otherwise(x))
    second = F.array_max(rest)
    return F.struct(F.get(states, at - 1).alias("ml_state"), top.alias("ml_pp"), F.get(states, F.array_position(rest, second).cast("int") - 1).alias("alt_state"), second.alias("alt_pp"))


def similar(a: Column, b: Column, groups: list[str] = SIMILAR) -> Column:
    out = F.lit(False)
    for g in groups:
        out = out | (F.lit(g).contains(a) & F.lit(g).contains(b))
    return out


def site_table(posteriors: DataFrame, gaps: DataFrame | None, cutoff: float = 0.25, names: list[str] = STATES) -> DataFrame:
    """anc, site, gap, ml_state, ml_pp, alt_state, alt_pp, site_type, entropy.

    posteriors: anc, site (from 0) and p, an array in the order of names. gaps: anc, site, gap (true,
    false or null). A site that gaps has and posteriors lack is a column without residues: no states.
    """
    two = posteriors.select("anc", "site", F.col("p"), best_two(F.col("p"), names).alias("t"), entropy(F.col("p")).alias("entropy"))
    joined = two.join(gaps, ["anc", "site"], "full") if gaps is not None else two.withColumn("gap", F.lit(False))
    gap = F.coalesce("gap", F.lit(False))
    ml, alt, app = F.col("t.ml_state"), F.col("t.alt_state"), F.col("t.alt_pp")
    kind = (
        F.when(F.col("gap").isNull(), "possible gap")
        .when(gap, "gap")
        .when(app >= cutoff, F.when(similar(ml, alt), "ambig_similar").otherwise("ambig_dissimilar"))
        .otherwise("good")
    )
    return joined.select(
        "anc",
        "site",
        "gap",
        F.when(gap, "-").otherwise(ml).alias("ml_state"),
        F.when(gap, 1.0).otherwise(F.col("t.ml_pp")).alias("ml_pp"),
        F.when(gap, "-").otherwise(alt).alias("alt_state"),
        F.when(gap, 0.0).otherwise(app).alias("alt_pp"),
        kind.alias("site_type"),
        "entropy",
    )


def sequences(sites: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """anc, ml and alt_all: the best states in order, and the same with second ones where they reach cutoff."""
    alt = F.when(F.col("alt_pp") >= cutoff, F.col("alt_state")).otherwise(F.col("ml_state"))
    g = sites.groupBy("anc").agg(F.sort_array(F.collect_list(F.struct("site", F.coalesce("ml_state", F.lit("-")).alias("m"), F.coalesce(alt, F.lit("-")).alias("a")))).alias("s"))
    return g.select("anc", F.concat_ws("", F.transform("s", lambda x: x["m"])).alias("ml"), F.concat_ws("", F.transform("s", lambda x: x["a"])).alias("alt_all"))


def summary(sites: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """anc, avg_pp, ln_pp, the same for alt_all, num_ambig and num_ambig_gaps."""
    alt = F.when(F.col("alt_pp") >= cutoff, F.col("alt_pp")).otherwise(F.col("ml_pp"))
    return sites.groupBy("anc").agg(
        F.avg("ml_pp").alias("avg_pp"),
        F.sum(F.log("ml_pp")).alias("ln_pp"),
        F.avg(alt).alias("alt_avg_pp"),
        F.sum(F.log(alt)).alias("alt_ln_pp"),
        F.sum(F.col("site_type").startswith("ambig").cast("long")).alias("num_ambig"),
        F.sum((F.col("site_type") == "possible gap").cast("long")).alias("num_ambig_gaps"),
    )


def summary_trees(newick: str, stats: dict[str, float]) -> tuple[str, str]:
    """Newicks with ancestors' labels and with their mean probabilities; the root has 0 where it has none."""
    tree = parse(newick)
    return write(tree, lambda n: n.name), write(tree, lambda n: f"{stats.get(n.name, 0.0):.6g}")


def read_posteriors(df: DataFrame) -> DataFrame:
    """anc, site from 0 and p, from a table Node, Site, State, p_A ... p_V."""
    return df.select(F.col("Node").alias("anc"), (F.col("Site").cast("int") - 1).alias("site"), F.array(*[F.col(f"p_{s}").cast("double") for s in STATES]).alias("p"))


def parsimony(tree: Node, observed: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each inner node and site 1 (gap), 0 (residue) or -1 (either), all sites at once.

    State sets are two bits: residue 1, gap 2. mode() of sets is those states that most of them hold.
    """

    def mode(sets: list[np.ndarray]) -> np.ndarray:
        r = sum((s & 1) for s in sets)
        g = sum((s >> 1) for s in sets)
        return np.where(r > g, 1, np.where(g > r, 2, 3)).astype(np.int8)

    order = tree.postorder()
    width = len(next(iter(observed.values())))
    both = np.full(width, 3, np.int8)
    own = {id(n): (np.where(observed[n.name], 2, 1).astype(np.int8) if not n.children else both) for n in order}
    down: dict[int, np.ndarray] = {}
    for n in order:
        if not n.children:
            down[id(n)] = own[id(n)]
            continue
        x = own[id(n)] & mode([down[id(c)] for c in n.children])
        down[id(n)] = np.where(x > 0, x, own[id(n)])
    up = {id(tree): both}
    out: dict[str, np.ndarray] = {}
    for n in order[::-1]:
        if n.parent is not None:
            up[id(n)] = mode([up[id(n.parent)], *(down[id(c)] for c in n.parent.children if c is not n)])
        if n.children:
            x = mode([up[id(n)], *(down[id(c)] for c in n.children)]) & own[id(n)]
            x = np.where(x > 0, x, own[id(n)])
            out[n.name] = np.where(x == 2, 1, np.where(x == 1, 0, -1)).astype(np.int8)
    return out


def ancestral_gaps(columns: DataFrame, newick: str) -> DataFrame:
    """anc, site, gap. columns: one row a site with gaps, a map of leaf name to whether it has a gap.

    Sites are independent: each batch of sites is one vectorised pass over the tree.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = parse(newick)
        leaves = [n.name for n in tree.leaves()]
        for b in batches:
            if not len(b):
                continue
            maps = [dict(m) for m in b["gaps"]]
            found = parsimony(tree, {x: np.array([bool(m.get(x)) for m in maps]) for x in leaves})
            for anc, states in found.items():
                yield pd.DataFrame({"anc": anc, "site": b["site"].to_numpy(), "gap": pd.array([None if s < 0 else bool(s) for s in states], "boolean")})

    return columns.select("site", "gaps").mapInPandas(run, "anc string, site long, gap boolean")


def gap_columns(alignment: DataFrame, key: str = "uid", column: str = "alignment") -> DataFrame:
    """One row a site with the map of names to gaps."""
    long = alignment.select(F.col(key).alias("k"), F.posexplode(F.split(column, "")).alias("site", "aa"))
    return long.groupBy(F.col("site").cast("long").alias("site")).agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("aa") == "-"))).alias("gaps"))
