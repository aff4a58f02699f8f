import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlattice.operators import ancestors, models, trees
from kinlattice.schema import TableError
from kinlattice.sources.newick import node_table, parse, splits, write
from kinlattice.streaming import convergence


@pytest.mark.parametrize("text", ["(A,B);", "((A:1,B:2)90:0.5,(C,D)anc1:3);", "A;", "('a b':1,'it''s':2);"])
def test_newick_round_trip(text):
    assert write(parse(text)) == text


@pytest.mark.parametrize("text", ["(A,B)", "((A,B);", "A,B;", "(A:x,B);"])
def test_bad_newick(text):
    with pytest.raises(TableError):
        parse(text)


def test_splits_and_deep_trees():
    keys = dict((k, n.name) for k, n in splits(parse("((A,B)x,(C,D)y)r;")))
    assert keys["A,B"] == "x" and keys["ROOT"] == "r"
    assert {k for k, n in splits(parse("((A,B),(C,D));"), rooted=False) if n.children} == {"ROOT", "C,D"}
    deep = "(" * 3000 + "A" + "".join(f",L{i})" for i in range(3000)) + ";"
    assert write(parse(deep)) == deep


def test_support_and_merge(spark):
    reps = spark.createDataFrame([(i, t) for i, t in enumerate(["((A,B),(C,D));", "((A,B),(C,D));", "((A,C),(B,D));", "(A,(B,(C,D)));"])], "tree_id long, newick string")
    base = node_table(spark.createDataFrame([(0, "((A,B)x,(C,D)y)r;")], "tree_id long, newick string"), rooted=False)
    got = {r.split_key: r.bs_support for r in trees.support_of(base, node_table(reps, rooted=False)).collect() if r.split_key.count(",") and not r.is_leaf}
    assert got == {"C,D": 75.0}
    other = node_table(spark.createDataFrame([(0, "((A,B)0.9,(C,D)0.8);")], "tree_id long, newick string"))
    rooted = node_table(spark.createDataFrame([(0, "((A,B)x,(C,D)y)r;")], "tree_id long, newick string"))
    merged = {r.split_key: r.pp for r in trees.merge_by_split(rooted, {"pp": other}, {"pp": "support"}).collect()}
    assert merged["A,B"] == 0.9 and merged["C,D"] == 0.8
    wrong = node_table(spark.createDataFrame([(0, "((A,C),(B,D));")], "tree_id long, newick string"))
    with pytest.raises(TableError):
        trees.merge_by_split(rooted, {"pp": wrong}, {"pp": "support"})
    same = spark.createDataFrame([(i, "((A,B),(C,D));") for i in range(100)], "tree_id long, newick string")
    r = trees.wrf_convergence(node_table(same, rooted=False), [50, 100], cutoff=0.5).orderBy("trees").collect()
    assert [x.trees for x in r] == [50, 100] and all(x.converged for x in r)


def test_load_and_write_trees():
    t = trees.load_trees({"clean": "((A:1,B:1):1,(C:1,D:1):1);", "bs_support": "(A,B,(C,D)88);", "anc_label": "((A,B)anc1,(C,D)anc2)anc3;"})
    assert {n.props.get("bs_support") for n in t.preorder() if n.children} >= {88.0}
    assert {n.props.get("anc_label") for n in t.preorder() if n.children} >= {"anc2"}
    assert "88" in trees.write_trees(t).splitlines()[0]
    with pytest.raises(TableError):
        trees.load_trees({"clean": "(A,B);", "event": "(A,C);"})
    m = trees.midpoint_root(parse("(A:1,B:1,C:9);"))
    assert sorted(x.name for x in m.leaves()) == ["A", "B", "C"] and len(m.children) == 2
    assert min(c.dist for c in m.children) >= 0 and any(not c.children and c.name == "C" and c.dist == 5 for c in m.children)


def slow_parsimony(text, obs):
    """One site at a time with sets."""
    t = parse(text)

    def mode(sets):
        votes = {x: sum(x in s for s in sets) for x in "rg"}
        return {x for x, v in votes.items() if v == max(votes.values())}

    out = {}
    for site in range(len(next(iter(obs.values())))):
        own = {id(n): ({"g"} if obs[n.name][site] else {"r"}) if not n.children else {"r", "g"} for n in t.preorder()}
        down, up = {}, {}
        for n in t.postorder():
            down[id(n)] = own[id(n)] if not n.children else (own[id(n)] & mode([down[id(c)] for c in n.children])) or own[id(n)]
        for n in t.preorder():
            up[id(n)] = {"r", "g"} if n.parent is None else mode([up[id(n.parent)], *(down[id(c)] for c in n.parent.children if c is not n)])
            if n.children:
                x = (mode([up[id(n)], *(down[id(c)] for c in n.children)]) & own[id(n)]) or own[id(n)]
                out[n.name, site] = None if len(x) == 2 else x == {"g"}
    return out


def test_parsimony(spark):
    text = "(((a,b)n1,(c,d)n2)n3,(e,f)n4)n5;"
    rng = np.random.default_rng(3)
    obs = {x: rng.integers(0, 2, 64).astype(bool) for x in "abcdef"}
    want = slow_parsimony(text, obs)
    got = ancestors.parsimony(parse(text), obs)
    assert {(n, i): None if s < 0 else bool(s) for n, v in got.items() for i, s in enumerate(v)} == want
    rows = [(i, {x: bool(obs[x][i]) for x in obs}) for i in range(64)]
    df = spark.createDataFrame(rows, "site long, gaps map<string,boolean>").repartition(3)
    assert {(r.anc, r.site): r.gap for r in ancestors.ancestral_gaps(df, text).collect()} == want


def test_site_table(spark):
    def p(**some):
        return [float(some.get(s, 0)) for s in ancestors.STATES]

    post = spark.createDataFrame([("anc1", 0, p(A=0.9, C=0.1)), ("anc1", 1, p(A=0.6, V=0.4)), ("anc1", 2, p(A=0.6, D=0.4)), ("anc1", 3, p(G=1.0)), ("anc1", 4, p(W=1.0))], "anc string, site long, p array<double>")
    gaps = spark.createDataFrame([("anc1", 0, False), ("anc1", 1, False), ("anc1", 2, False), ("anc1", 3, True), ("anc1", 4, None)], "anc string, site long, gap boolean")
    s = ancestors.site_table(post, gaps)
    got = {r.site: r for r in s.collect()}
    assert [got[i].site_type for i in range(5)] == ["good", "ambig_similar", "ambig_dissimilar", "gap", "possible gap"]
    assert (got[3].ml_state, got[3].ml_pp, got[3].alt_state, got[3].alt_pp) == ("-", 1.0, "-", 0.0) and got[4].alt_state == "A"
    assert got[0].entropy == pytest.approx(-(0.9 * math.log(0.9) + 0.1 * math.log(0.1)))
    q = ancestors.sequences(s).first()
    assert (q.ml, q.alt_all) == ("AAA-W", "AVD-W")
    r = ancestors.summary(s).first()
    assert r.avg_pp == pytest.approx((0.9 + 0.6 + 0.6 + 2) / 5) and (r.num_ambig, r.num_ambig_gaps) == (2, 1) and r.alt_avg_pp == pytest.approx((0.9 + 0.4 + 0.4 + 2) / 5)
    a, b = ancestors.summary_trees("((A:1,B:1)anc1:1,C:1);", {"anc1": 0.82})
    assert "anc1" in a and "0.82" in b


def test_models(spark):
    df = spark.createDataFrame([("LG", 1092.532923), ("JTT", 1103.700117), ("bad", None)], "model string, AICc double")
    got = {r.model: r.p for r in models.best_models(models.model_weights(df)).collect()}
    assert got["LG"] == pytest.approx(0.996255, abs=1e-6) and got["JTT"] == pytest.approx(0.003745, abs=1e-6) and len(got) == 2
    grid = models.default_grid(spark)
    assert grid.count() == 360 == grid.distinct().count() and grid.where("model = 'LG+G8+FO+IC'").count() == 1
    info = models.information(spark.createDataFrame([(-100.0, 5)], "L double, N int"), sites=50).first()
    assert info.AIC == 210 and info.AICc == pytest.approx(210 + 60 / 44) and info.BIC == pytest.approx(5 * math.log(50) + 200)


def test_bootstrap_and_distance_trees(spark):
    seqs = {"a": "ACDEFGHIKLMNPQRSTVWY" * 3, "b": "ACDEFGHIKLMNPQRSTVWW" * 3, "c": "YYDEFGHIKLCCPQRSTVWA" * 3, "d": "YYDEFGHIKLCCPQRSAAWA" * 3}
    df = spark.createDataFrame(list(seqs.items()), "uid string, alignment string")
    reps = models.resampled(df, 12)
    wide = {}
    for r in reps.collect():
        assert len(r.alignment) == 60
        wide.setdefault(r.replicate, {})[r.uid] = r.alignment
    columns = set(zip(*seqs.values(), strict=True))
    assert all(set(zip(*(w[u] for u in seqs), strict=True)) <= columns for w in wide.values()) and len({w["a"] for w in wide.values()}) > 6
    found = models.distance_trees(reps)
    base = node_table(models.distance_trees(df.withColumn("replicate", F.lit(0))), rooted=False)
    got = trees.support_of(base, node_table(found, rooted=False)).where("split_key = 'c,d'").first()
    assert got.bs_support > 80


def test_reconcile(spark):
    gene = models.reconcile(parse("(((a1,b1),c1),((a2,b2),c2));"), parse("((A,B),C);"), {x + i: x.upper() for x in "abc" for i in "12"})
    events = [n.props["event"] for n in gene.preorder() if n.children]
    assert events == ["D", "S", "S", "S", "S"] and sum(n.props["losses"] for n in gene.preorder() if n.children) == 0
    lost = models.reconcile(parse("((a1,c1),(a2,b2));"), parse("((A,B),C);"), {"a1": "A", "c1": "C", "a2": "A", "b2": "B"})
    assert lost.props["event"] == "D" and sum(n.props["losses"] for n in lost.preorder() if n.children) == 2
    df = spark.createDataFrame([(1, "((a1,b1),(a2,b2));")], "tree_id long, newick string")
    r = models.reconcile_trees(df, "(A,B);", {"a1": "A", "a2": "A", "b1": "B", "b2": "B"}).first()
    assert (r.duplications, r.losses, r.newick) == (1, 0, "((a1,b1)S,(a2,b2)S)D;")
    links = models.link_table(spark.createDataFrame([("u2", "ott1"), ("u1", "ott1"), ("u3", "ott2")], "uid string, ott string"))
    assert sorted(r.value for r in links.collect()) == ["ott1:u1;u2", "ott2:u3"]


def test_marginal_posteriors():
    t = parse("((A:0.1,B:0.1)x:0.1,(C:0.1,D:5)y:0.1)r;")
    names, p = models.marginal_posteriors(t, {"A": "AG", "B": "AG", "C": "A-", "D": "WG"})
    assert names == ["r", "x", "y"] and p.shape == (3, 2, 20) and np.allclose(p.sum(2), 1)
    assert p[1, 0].argmax() == ancestors.STATES.index("A") and p[1, 1].argmax() == ancestors.STATES.index("G") and p[1, 0].max() > 0.95


def test_duplications_and_composition(spark):
    nodes = spark.createDataFrame([("D",), ("S",), ("D",), (None,)], "event string")
    leaves = spark.createDataFrame([("a|b",), ("b",)], "paralog string")
    r = trees.duplications(nodes, leaves).first()
    assert (r.expected, r.observed, r.excess) == (1, 2, 1)
    df = spark.createDataFrame([(1, "x")] * 9 + [(1, "y")] * 9 + [(1, "z")], "g int, m string")
    assert trees.composition(df, "g", "m").first()["call"] == "y|x"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.newick").write_text("((A,B),(C,D));\n" * 20)
    state = convergence.Halves(str(tmp_path / "state"), cutoff=0.9, least=40)
    q = convergence.follow(convergence.tree_stream(spark, str(folder), 2), state, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert state.done and state.trees >= 40
    held = spark.read.parquet(str(tmp_path / "state"))
    assert {r.split_key for r in held.collect()} == {"TREE", "C,D"}
    # a state made anew goes on from the table, and an epoch that runs again replaces its own counts
    again = convergence.Halves(str(tmp_path / "state"), cutoff=0.0, least=10**6)
    batch = spark.createDataFrame([("((A,B),(C,D));",)] * 41, "value string")
    last = max(r.epoch for r in held.collect())
    for _ in range(2):
        again(batch, last + 1)
    assert again.trees == state.trees + 41 and again.history[-1][2] <= 1 / 41 + 1e-9
    stream = convergence.running_support(convergence.tree_stream(spark, str(folder)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.split_key: r.n for r in spark.table("running").collect()} == {"TREE": 120, "C,D": 120}
