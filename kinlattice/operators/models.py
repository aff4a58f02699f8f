"""Evolutionary models: the grid, their weights, resampling, distance trees, reconciliation, posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.newick import Node, parse, write
from .ancestors import STATES

# fixed values: parts of the default grid
MATRICES = "Blosum62 cpREV Dayhoff DCMut DEN FLU HIVb HIVw JTT JTT-DCMut LG mtART mtMAM mtREV mtZOA PMB rtREV stmtREV VT WAG".split()
RATES = ["", "G8"]
FREQS = ["", "FC", "FO"]
INVARIANT = ["", "IC", "IO"]


def model_grid(dims: list[DataFrame], into: str = "model") -> DataFrame:
    """Cross product of one-column tables; parts that aren't empty joined by '+'. Sizes are a few dozen."""
    parts = [d.toDF(f"_p{i}") for i, d in enumerate(dims)]
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    return grid.select(F.concat_ws("+", *[F.nullif(f"_p{i}", F.lit("")) for i in range(len(parts))]).alias(into))


def default_grid(spark) -> DataFrame:
    return model_grid([spark.createDataFrame([(x,) for x in xs], "p string") for xs in (MATRICES, RATES, FREQS, INVARIANT)])


def information(df: DataFrame, lnl: str = "L", n_params: str = "N", sites: int | None = None) -> DataFrame:
    """Add AIC, AICc and BIC."""
    n, k = F.lit(sites) if sites else F.col("sites"), F.col(n_params)
    aic = 2 * k - 2 * F.col(lnl)
    return df.withColumn("AIC", aic).withColumn("AICc", aic + F.try_divide(2 * k * (k + 1), n - k - 1)).withColumn("BIC", k * F.log(n) - 2 * F.col(lnl))


def model_weights(df: DataFrame, score: str = "AICc", by: list[str] | None = None) -> DataFrame:
    """Add p, exp((least - score) / 2) over its sum; rows without score go."""
    w = Window.partitionBy(*(by or []))
    rows = df.where(F.col(score).isNotNull())
    if by:
        least = rows.groupBy(*by).agg(F.min(score).alias("_least"))
        held = rows.join(least, by).withColumn("_e", F.exp((F.col("_least") - F.col(score)) / 2))
        total = held.groupBy(*by).agg(F.sum("_e").alias("_sum"))
        return held.join(total, by).withColumn("p", F.col("_e") / F.col("_sum")).drop("_e", "_sum", "_least")
    held = rows.withColumn("_e", F.exp((F.min(score).over(w) - F.col(score)) / 2))
    return held.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def best_models(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("p"), "model").limit(n)


def resampled(df: DataFrame, replicates: int, key: str = "uid", column: str = "alignment", seed: int = 1, draw=None) -> DataFrame:
    """replicate, key and alignment: for each replicate, columns drawn with replacement by a seeded hash.

    draw(i, replicate, n) may give another rule: the place from 0 of the i-th column (from 1) of n.

    All rows of a replicate draw the same columns, so no table of draws is needed.
    """
    reps = df.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    held = df.crossJoin(F.broadcast(reps))
    n = F.length(column)
    place = draw or (lambda i, r, n: F.pmod(F.xxhash64(i, r, F.lit(seed)), n))
    letters = F.split(F.col(column), "")
    drawn = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(letters, place(i, F.col("replicate"), n).cast("int")))
    return held.select("replicate", key, F.when(n > 0, F.concat_ws("", drawn)).otherwise(F.col(column)).alias(column))


def distances(seqs: list[str]) -> np.ndarray:
    """Poisson-corrected share of differing residues, over positions without gaps in either."""
    m = np.array([list(s) for s in seqs])
    res = (m != "-") & (m != "X")
    n = len(seqs)
    out = np.zeros((n, n))
    for i in range(n):
        both = res[i] & res
        diff = ((m != m[i]) & both).sum(1) / np.maximum(both.sum(1), 1)
        out[i] = -np.log(np.maximum(1 - diff, 0.02))
    return (out + out.T) / 2


def neighbor_joining(names: list[str], d: np.ndarray) -> Node:
    """Tree by neighbour joining; its root joins the last three."""
    nodes = [Node(n) for n in names]
    d = d.astype(float).copy()
    while len(nodes) > 3:
        n = len(nodes)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        i, j = min(i, j), max(i, j)
        a = max(0.0, 0.5 * d[i, j] + (r[i] - r[j]) / (2 * (n - 2)))
        nodes[i].dist, nodes[j].dist = a, max(0.0, d[i, j] - a)
        new = (d[i] + d[j] - d[i, j]) / 2
        joined = Node("", [nodes[i], nodes[j]])
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [joined]
    if len(nodes) == 3:
        for k, (i, j) in enumerate([(1, 2), (0, 2), (0, 1)]):
            nodes[k].dist = max(0.0, (d[k, i] + d[k, j] - d[i, j]) / 2)
    elif len(nodes) == 2:
        nodes[0].dist = nodes[1].dist = d[0, 1] / 2
    return nodes[0] if len(nodes) == 1 else Node("", nodes)


def distance_trees(alignments: DataFrame, group: str = "replicate", key: str = "uid", column: str = "alignment") -> DataFrame:
    """tree_id and newick for each group's alignment: replicates are independent tasks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        tree = neighbor_joining(pdf[key].tolist(), distances(pdf[column].tolist()))
        return pd.DataFrame({"tree_id": [int(pdf[group].iloc[0])], "newick": [write(tree)]})

    return alignments.select(group, key, column).groupBy(group).applyInPandas(one, "tree_id long, newick string")


def reconcile(gene: Node, species: Node, leaf_species: dict[str, str]) -> Node:
    """LCA reconciliation: inner nodes of the gene tree get props event (S or D) and losses."""
    depth = {id(n): n.depth() for n in species.preorder()}
    at = {n.name: n for n in species.leaves()}

    def lca(a: Node, b: Node) -> Node:
        while a is not b:
            if depth[id(a)] < depth[id(b)]:
                a, b = b, a
            a = a.parent
        return a

    place: dict[int, Node] = {}
    for n in gene.postorder():
        if not n.children:
            place[id(n)] = at[leaf_species[n.name]]
            continue
        here = reduce(lca, [place[id(c)] for c in n.children])
        place[id(n)] = here
        dup = any(place[id(c)] is here for c in n.children)
        n.props["event"] = "D" if dup else "S"
        n.props["losses"] = sum(max(0, depth[id(place[id(c)])] - depth[id(here)] - (0 if dup else 1)) for c in n.children)
    return gene


def reconcile_trees(trees: DataFrame, species_newick: str, leaf_species: dict[str, str]) -> DataFrame:
    """tree_id, newick with events on inner nodes, duplications and losses for each gene tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["tree_id"], b["newick"], strict=True):
                t = reconcile(parse(text), parse(species_newick), leaf_species)
                inner = [n for n in t.preorder() if n.children]
                rows.append((k, write(t, lambda n: n.props["event"]), sum(n.props["event"] == "D" for n in inner), sum(n.props["losses"] for n in inner)))
            yield pd.DataFrame(rows, columns=["tree_id", "newick", "duplications", "losses"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, newick string, duplications long, losses long")


def link_table(df: DataFrame, key: str = "uid", ott: str = "ott") -> DataFrame:
    """Lines 'ott:uid;uid' of a gene-to-species map."""
    g = df.groupBy(ott).agg(F.array_join(F.sort_array(F.collect_list(key)), ";").alias("u"))
    return g.select(F.concat_ws(":", ott, "u").alias("value"))


def marginal_posteriors(tree: Node, sites: dict[str, str], rate: float = 1.0) -> tuple[list[str], np.ndarray]:
    """Inner nodes and their posteriors (node, site, state) under equal exchange rates, by two passes of pruning."""
    n = len(STATES)
    width = len(next(iter(sites.values())))

    def p(t: float) -> np.ndarray:
        e = np.exp(-rate * max(t, 1e-6) * n / (n - 1))
        return np.full((n, n), (1 - e) / n) + np.eye(n) * e

    low: dict[int, np.ndarray] = {}
    for node in tree.postorder():
        if not node.children:
            x = np.ones((width, n))
            for i, c in enumerate(sites[node.name]):
                if c in STATES:
                    x[i] = 0
                    x[i, STATES.index(c)] = 1
            low[id(node)] = x
        else:
            x = np.ones((width, n))
            for c in node.children:
                x *= low[id(c)] @ p(c.dist or 0.0).T
            low[id(node)] = x / x.max(1, keepdims=True)
    high = {id(tree): np.full((width, n), 1 / n)}
    names, out = [], []
    for node in tree.preorder():
        if node.parent is not None and node.children:
            x = high[id(node.parent)].copy()
            for s in node.parent.children:
                if s is not node:
                    x *= low[id(s)] @ p(s.dist or 0.0).T
            x = x @ p(node.dist or 0.0)
            high[id(node)] = x / x.max(1, keepdims=True)
        if node.children:
            y = low[id(node)] * high[id(node)]
            names.append(node.name)
            out.append(y / y.sum(1, keepdims=True))
    return names, np.array(out)
