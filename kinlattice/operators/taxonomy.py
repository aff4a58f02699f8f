"""Species lookups, lineages and species trees, from offline dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import without_strain
from ..session import cut
from ..sources.newick import Node

LIFE = "ott805080"
# fixed values: lineage entries that tell nothing
TOP_RANKS = ["life", "cellular organisms"]
MICROBIAL = ["Bacteria", "Archaea"]


def species_ids(df: DataFrame, names: DataFrame, column: str = "species") -> DataFrame:
    """Distinct species with their match: matched, ott, canonical.

    names: query, ott, canonical, is_exact, is_synonym, one row a match. One match counts even if it is
    approximate; of several, the exact one counts if all the others are synonyms.
    """
    wanted = df.select(F.col(column).alias("species"), F.lower(without_strain(F.col(column))).alias("query")).distinct()
    m = names.select(F.lower("query").alias("query"), "ott", "canonical", F.coalesce("is_exact", F.lit(False)).alias("exact"), F.coalesce("is_synonym", F.lit(False)).alias("synonym")).distinct()
    firm = F.col("exact") & ~F.col("synonym")
    g = m.groupBy("query").agg(
        F.count("*").alias("n"),
        F.sum(firm.cast("int")).alias("firm"),
        F.sum((~firm & ~F.col("synonym")).cast("int")).alias("loose"),
        F.min(F.when(firm, F.struct("ott", "canonical"))).alias("best"),
        F.min(F.struct("ott", "canonical")).alias("only"),
    )
    ok = (F.col("n") == 1) | ((F.col("firm") == 1) & (F.col("loose") == 0))
    chosen = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("best"))
    out = wanted.join(g, "query", "left").withColumn("matched", F.coalesce(ok, F.lit(False)))
    return out.select("species", "matched", F.when(F.col("matched"), chosen["ott"]).alias("ott"), F.when(F.col("matched"), chosen["canonical"]).alias("canonical"))


def add_species_ids(df: DataFrame, names: DataFrame | None, resolvable: DataFrame | None = None, keep_anyway: bool = False, species_aware: bool = True) -> DataFrame:
    """Add orig_species, ott and resolvable; unmatched or unresolvable species are kept no more."""
    if not species_aware:
        return df.withColumn("orig_species", F.col("species")).withColumn("ott", F.lit(None).cast("string")).withColumn("resolvable", F.lit(True))
    found = species_ids(df, names).select(F.col("species").alias("_s"), F.col("ott").alias("_ott"), F.col("canonical").alias("_canon"))
    out = df.drop("ott", "resolvable").join(found, F.col("species") == F.col("_s"), "left")
    if resolvable is not None:
        out = out.join(resolvable.select(F.col("ott").alias("_ott"), F.col("resolvable").alias("_r")).distinct(), "_ott", "left")
    else:
        out = out.withColumn("_r", F.lit(True))
    out = out.withColumn("orig_species", F.col("species")).withColumn("ott", F.col("_ott")).withColumn("resolvable", F.col("_ott").isNotNull() & F.coalesce("_r", F.lit(False)))
    out = out.withColumn("species", F.coalesce("_canon", "species")).drop("_s", "_ott", "_canon", "_r")
    if not keep_anyway:
        out = out.withColumn("keep", F.col("keep") & F.col("resolvable"))
        if "always_keep" in out.columns:
            out = out.withColumn("always_keep", F.coalesce("always_keep", F.lit(False)) & F.col("resolvable"))
    return out


def common_prefix(df: DataFrame, by: list[str], lineage: str) -> DataFrame:
    """For each group the longest common prefix of its arrays: prefix and n.

    Places are counted, not lineages gathered: a place belongs to the prefix if all rows have it with one
    value and so have all places before it.
    """
    rows = df.groupBy(*by).agg(F.count("*").alias("n"))
    long = df.select(*by, F.posexplode(lineage).alias("pos", "v"))
    per = long.groupBy(*by, "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"))
    agreed = per.join(rows, by).where("lo = hi AND m = n").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "lo"))).alias("ps"))
    filled = rows.join(agreed, by, "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<struct<pos:int,lo:string>>")))
    run = F.filter("ps", lambda p, i: p["pos"] == i)
    return filled.select(*by, F.transform(run, lambda p: p["lo"]).alias("prefix"), "n")


def mrca(prefix: Column, move_up_by: int = 0, avoid_all_life: bool = True, microbial_to_domain: bool = True) -> Column:
    """struct(taxon, lineage, is_microbial) of a common lineage, from the root down."""
    useful = F.filter(prefix, lambda x: ~x.isin(*TOP_RANKS)) if avoid_all_life else prefix
    up = F.slice(useful, 1, F.greatest(F.size(useful) - move_up_by, F.lit(1))) if move_up_by else useful
    domain = F.filter(useful, lambda x: x.isin(*MICROBIAL))
    microbial = F.size(domain) > 0
    lineage = F.when(microbial, F.slice(useful, 1, F.greatest(F.array_position(useful, F.get(domain, F.lit(0))).cast("int"), F.lit(1)))).otherwise(up) if microbial_to_domain else up
    taxon = F.coalesce(F.try_element_at(lineage, F.lit(-1)), F.lit("life"))
    return F.struct(taxon.alias("taxon"), lineage.alias("lineage"), F.coalesce(microbial, F.lit(False)).alias("is_microbial"))


def tree_paths(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, ancestor and distance for every node and each of its ancestors, itself included.

    Paths double in each round until none is longer, so that a tree of depth d takes log2(d) joins. A cycle is an error.
    """
    base = edges.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    closure = base.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    hop = base.where("up IS NOT NULL").select("node", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    closure = cut(closure.unionByName(hop))
    reach, nodes = 1, None
    while True:
        if reach >= 64:
            nodes = nodes or base.count()
            if reach > 2 * nodes:
                raise ValueError("the edges have a cycle")
        a, b = closure.alias("a"), closure.where("distance > 0").alias("b")
        more = a.join(b, F.col("a.ancestor") == F.col("b.node")).where(F.col("a.distance") == reach).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        more = cut(more)  # read by each later round
        if more.isEmpty():
            return closure
        closure = closure.unionByName(more)
        reach *= 2
    return closure


def induced_tree(parents: dict[str, str | None], leaves: list[str]) -> Node:
    """Tree over the wanted leaves: their paths to the root, less nodes with one child; polytomies in pairs.

    parents: child -> parent, for the leaves' ancestors only (a small table on the driver).
    """
    nodes: dict[str, Node] = {}
    roots: list[Node] = []
    for leaf in sorted(set(leaves)):
        below = None
        at: str | None = leaf
        while at is not None:
            known = at in nodes
            here = nodes.setdefault(at, Node(at))
            if below is not None and below not in here.children:
                here.children.append(below)
                below.parent = here
            if known:
                break
            below, at = here, parents.get(at)
            if at is None:
                roots.append(here)
    top = roots[0] if len(roots) == 1 else Node("life", roots)
    return resolved(pruned(top))


def pruned(node: Node) -> Node:
    """Nodes with one child give way to it."""
    kids = [pruned(c) for c in node.children]
    return kids[0] if len(kids) == 1 else Node(node.name, kids, 1.0, 1.0)


def resolved(node: Node) -> Node:
    kids = [resolved(c) for c in node.children]
    while len(kids) > 2:
        kids = [Node("", kids[:2], 1.0, 1.0), *kids[2:]]
    return Node(node.name, kids, 1.0, 1.0)


def taxa_order(tree: Node, reference: str | None = None) -> list[str]:
    """Leaf names by distance from a reference leaf: it, then the leaves of each ancestor not yet listed."""
    leaves = tree.leaves()
    if reference is None:
        return [x.name for x in leaves]
    start = next((x for x in leaves if x.name == reference), None)
    if start is None:
        raise ValueError(f"{reference} is not in the tree")
    out, at = [start.name], start
    while at.parent is not None:
        at = at.parent
        out += [x.name for x in at.leaves() if x.name not in out]
    return out


def sort_by_taxa(df: DataFrame, order: list[str], paralog: str | None = None, key: str = "ott", row: str = "row_id") -> DataFrame:
    """Rows by paralog (recip_paralog, nickname or name), then by the leaves' order, then as they came."""
    column = paralog or next(c for c in ("recip_paralog", "nickname", "name") if c in df.columns)
    places = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)] or [("", 0)], "_o string, _at int")
    return df.join(F.broadcast(places), df[key] == places["_o"], "left").orderBy(F.col(column).asc_nulls_last(), F.col("_at").asc_nulls_last(), row).drop("_o", "_at")


def placed_by_taxa(df: DataFrame, order: list[str], by: list[str], key: str = "ott", row: str = "row_id") -> DataFrame:
    """df with place, its row's number (from 1) in the order by columns, by the leaves' order, and by row.

    Places are counted by range: ranks within a range of equal columns and leaf, plus what lies in the ranges before.
    """
    leaves = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)] or [("", 0)], "_o string, _at int")
    rows = df.join(F.broadcast(leaves), df[key] == leaves["_o"], "left").withColumn("_block", F.struct(*by, F.coalesce("_at", F.lit(len(order))).alias("_at"))).drop("_o", "_at")
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_m"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(before, "_block").withColumn("place", F.row_number().over(Window.partitionBy("_block").orderBy(row)) + F.col("_before"))
    return placed.drop("_block", "_m", "_before")
