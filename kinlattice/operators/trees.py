"""Relational tree operators: features merged by split, branch support, duplications, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TableError
from ..sources.newick import Node, parse, splits, write

# fixed values: the order in which trees contribute and are written
FEATURES = ["event", "anc_pp", "anc_label", "bs_support"]


def merge_by_split(base: DataFrame, others: dict[str, DataFrame], features: dict[str, str], strict: bool = True) -> DataFrame:
    """Node table base with a column for each other tree's feature, joined on the split key.

    Where nodes share a key, the one with more children counts. strict: a split on one side only is an
    error ('different topologies'), found by one anti-join on either side.
    """
    pick = lambda t, cols: t.groupBy("split_key").agg(*[F.max_by(c, "n_children").alias(a) for c, a in cols])
    out = base
    for name, table in others.items():
        side = pick(table, [(features[name], name)])
        if strict:
            a = base.select("split_key").distinct().join(side.select("split_key"), "split_key", "left_anti").limit(1)
            b = side.select("split_key").join(base.select("split_key").distinct(), "split_key", "left_anti").limit(1)
            if not a.unionByName(b).isEmpty():
                raise TableError(f"{name}: the trees have different topologies")
        out = out.join(side, "split_key", "left")
    return out


def split_support(keys: DataFrame, group: str, split: str, total: int | None = None) -> DataFrame:
    """split and support: in what percent of groups (replicates) it occurs. Counted by distinct pairs."""
    pairs = keys.select(group, split).distinct()
    n = pairs.select(group).distinct().count() if total is None else total
    return pairs.groupBy(split).agg(F.count("*").alias("n")).withColumn("support", F.col("n") * 100.0 / F.lit(n))


def support_of(tree: DataFrame, replicates: DataFrame) -> DataFrame:
    """Node table tree with support in percent of the replicate trees that have each split."""
    inner = replicates.where("NOT is_leaf AND split_key <> 'ROOT'")
    total = replicates.select("tree_id").distinct().count()
    counts = split_support(inner.withColumnRenamed("split_key", "split"), "tree_id", "split", total).select(F.col("split").alias("split_key"), F.col("support").alias("bs_support"))
    out = tree.join(counts, "split_key", "left")
    return out.withColumn("bs_support", F.when(~F.col("is_leaf") & (F.col("split_key") != "ROOT"), F.coalesce("bs_support", F.lit(0.0))))


def wrf_convergence(replicates: DataFrame, steps: list[int], cutoff: float = 0.03, permutations: int = 100, seed: int = 1) -> DataFrame:
    """trees, avg_wrf, avg_wrf_pct, perms_below_cutoff, converged for the first n replicates of each step.

    Each permutation splits the replicates in halves by a seeded hash; the distance is the sum over splits
    of the difference of their counts in the halves, relative to the sum of both.
    """
    spark = replicates.sparkSession
    inner = replicates.where("NOT is_leaf AND split_key <> 'ROOT'").select("tree_id", "split_key").distinct()
    plan = spark.createDataFrame([(s, p) for s in steps for p in range(permutations)], "trees long, perm long")
    half = F.pmod(F.xxhash64("tree_id", "perm", F.lit(seed)), F.lit(2))
    rows = inner.join(F.broadcast(plan), F.col("tree_id") < F.col("trees"))  # as many rows as steps times permutations
    per = rows.groupBy("trees", "perm", "split_key").agg(F.sum(half).alias("a"), F.count("*").alias("n"))
    dist = per.groupBy("trees", "perm").agg(F.sum(F.abs(2 * F.col("a") - F.col("n"))).alias("d"), F.sum("n").alias("n"))
    out = dist.groupBy("trees").agg(F.avg("d").alias("avg_wrf"), (F.avg(F.col("d") / F.col("n")) * 100).alias("avg_wrf_pct"), F.sum((F.col("d") / F.col("n") <= cutoff).cast("long")).alias("perms_below_cutoff"))
    return out.withColumn("converged", F.col("perms_below_cutoff") >= 0.99 * permutations)


def duplications(nodes: DataFrame, leaves: DataFrame, event: str = "event", paralog: str = "paralog") -> DataFrame:
    """One row: expected (distinct paralogs less one) and observed (nodes with event D) duplications."""
    names = leaves.select(F.explode(F.split(paralog, r"\|")).alias("p")).where("p <> ''").distinct().agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("expected"))
    seen = nodes.agg(F.sum((F.col(event) == "D").cast("long")).alias("observed"))
    return names.crossJoin(seen.select(F.coalesce("observed", F.lit(0)).alias("observed"))).withColumn("excess", F.greatest(F.col("observed") - F.col("expected"), F.lit(0)))


def composition(df: DataFrame, group: str, member: str, least: float = 0.1) -> DataFrame:
    """group, n and call: members with a share above least, by falling (count, name), joined by '|'."""
    counts = df.groupBy(group, member).agg(F.count("*").alias("c"))
    g = counts.groupBy(group).agg(F.sum("c").alias("n"), F.reverse(F.array_sort(F.collect_list(F.struct("c", member)))).alias("m"))
    big = F.filter("m", lambda x: x["c"] / F.col("n") > least)
    return g.select(group, "n", F.concat_ws("|", F.transform(big, lambda x: x[member])).alias("call"))


def midpoint_root(tree: Node) -> Node:
    """Root between the two leaves that are farthest apart."""
    nodes = tree.preorder()
    near: dict[int, list[tuple[Node, float]]] = {id(n): [] for n in nodes}
    for n in nodes:
        if n.parent is not None:
            d = n.dist or 0.0
            near[id(n)].append((n.parent, d))
            near[id(n.parent)].append((n, d))

    def farthest(start: Node) -> tuple[Node, float, dict[int, Node | None]]:
        seen, came, todo = {id(start): 0.0}, {id(start): None}, [start]
        best = start
        while todo:
            n = todo.pop()
            if not n.children and n is not start and (best is start or seen[id(n)] > seen[id(best)]):
                best = n
            for m, d in near[id(n)]:
                if id(m) not in seen:
                    seen[id(m)], came[id(m)] = seen[id(n)] + d, n
                    todo.append(m)
        return best, seen[id(best)], came

    leaves = tree.leaves()
    if len(leaves) < 2:
        return tree
    a, _, _ = farthest(leaves[0])
    b, length, came = farthest(a)
    half, at, gone = length / 2, b, 0.0
    while came[id(at)] is not None:
        step = next(d for m, d in near[id(at)] if m is came[id(at)])
        if gone + step >= half:
            break
        gone, at = gone + step, came[id(at)]
    other = came[id(at)]
    if other is None:
        return tree
    step = next(d for m, d in near[id(at)] if m is other)

    def hang(n: Node, parent: Node, dist: float) -> Node:
        top = Node(n.name, [], dist, n.support, dict(n.props))
        todo = [(n, parent, top)]
        while todo:
            old, back, new = todo.pop()
            for m, d in near[id(old)]:
                if m is not back:
                    todo.append((m, old, new.add(Node(m.name, [], d, m.support, dict(m.props)))))
        return top

    return prune_single(Node("", [hang(at, other, half - gone), hang(other, at, step - (half - gone))]))


def prune_single(root: Node) -> Node:
    """Inner nodes with one child give way to it, lengths added."""
    for n in root.postorder():
        kids = []
        for c in n.children:
            while len(c.children) == 1:
                only = c.children[0]
                only.dist = (only.dist or 0.0) + (c.dist or 0.0)
                c = only
            c.parent = n
            kids.append(c)
        n.children = kids
    return root


def load_trees(newicks: dict[str, str]) -> Node:
    """One tree with the properties of several over one set of leaves: clean, bs_support, anc_label, anc_pp, event.

    They are rooted like the first given of event, anc_pp, anc_label, bs_support, clean; nodes meet by their
    unrooted splits. A root's ancestor label goes to an inner node that lacks one.
    """
    trees = {k: parse(v) for k, v in newicks.items()}
    first = next(k for k in ("event", "anc_pp", "anc_label", "bs_support", "clean") if k in trees)
    base = trees[first] if len(trees[first].children) == 2 else midpoint_root(trees[first])
    leaves = sorted(n.name for n in base.leaves())
    for k, t in trees.items():
        if sorted(n.name for n in t.leaves()) != leaves:
            raise TableError(f"{k}: the trees have different leaves")
    rooted_keys = {s for s, _ in splits(base)}
    for k, t in trees.items():
        same = {s for s, _ in splits(t)} == rooted_keys  # rooted alike: the root's two sides are two nodes
        value = (lambda n: n.support) if k in ("anc_pp", "bs_support") else (lambda n: n.name or (None if n.support is None else f"{n.support:g}"))
        found: dict[str, tuple[int, object]] = {}
        spare = None
        for s, n in splits(t, rooted=same):
            if not n.children:
                continue
            if s == "ROOT":
                spare = value(n)
            elif value(n) is not None and (s not in found or len(n.children) > found[s][0]):
                found[s] = (len(n.children), value(n))
        lacking = []
        for s, n in splits(base, rooted=same):
            if n.children and s in found:
                n.props[k] = found[s][1]
            elif n.children:
                lacking.append(n)
        if spare is not None and lacking and k in ("anc_label", "anc_pp"):
            (base if base in lacking else lacking[0]).props[k] = spare
    return base


def write_trees(tree: Node, names: dict[str, str] | None = None) -> str:
    """A newick for each property that the tree has: support, event, label, probability."""
    for n in tree.leaves():
        n.props.setdefault("leaf", n.name)
        n.name = (names or {}).get(n.name, n.name)
    out = []
    for k in ("bs_support", "event", "anc_label", "anc_pp"):
        if any(k in n.props for n in tree.preorder()):
            out.append(write(tree, lambda n, k=k: "" if n.props.get(k) is None else n.props[k] if isinstance(n.props[k], str) else f"{n.props[k]:g}"))
    for n in tree.leaves():
        n.name = n.props.pop("leaf", n.name)
    return "\n".join(out or [write(tree)]) + "\n"


def is_split(key: Column) -> Column:
    return key != "ROOT"
