import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlattice.operators import alignment, budgets, dedup, intervals, posterior, search, taxonomy, validate
from kinlattice.schema import HITS, ROW, TableError
from kinlattice.sources.newick import parse


def core(spark, rows, more="", extra=()):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, species string, name string, sequence string{more}")


def test_validator(spark):
    df = core(spark, [("Homo", "a", "MK V\nL", "yes", "ott12", "AB-C-"), ("Homo", "a", "MK V\nL", "yes", "ott12", "AB-C-"), ("Mus", "b", "MLL", "0", "None", "ABX--"), (" ", None, "", None, "", None), ("Rat", "c", "K", "T", None, "-----")], ", keep string, ott string, alignment string")
    out = validate.check_table(df)
    got = {r.species: r for r in out.collect()}
    assert len(got) == 3 and got["Homo"].sequence == "MKVL" and [got[s].keep for s in ("Homo", "Mus", "Rat")] == [True, False, True]
    assert got["Homo"].ott == "ott12" and got["Mus"].ott is None and got["Homo"].alignment == "ABC"
    assert len({r.uid for r in got.values()}) == 3 and all(len(r.uid) == 10 for r in got.values())
    again = validate.check_table(out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert out.columns[:5] == [ROW, "keep", "species", "name", "sequence"]
    for bad in ("ott", "ottstupid", "732213"):
        with pytest.raises(TableError):
            validate.check_table(core(spark, [("a", "b", "c", bad)], ", ott string"))
    with pytest.raises(TableError):
        validate.check_table(core(spark, [("a", "b", "c", "AA"), ("a", "c", "c", "AAA")], ", alignment string"))
    with pytest.raises(TableError):
        validate.check_table(core(spark, [("a", "b", "c", "not")], ", keep string"))
    with pytest.raises(TableError):
        validate.check_table(df.drop("name"))
    with pytest.raises(TableError):
        validate.check_table(core(spark, [("a", "", "c")]))


def test_bool_and_uid(spark):
    df = spark.createDataFrame([("1",), ("False",), ("yes",), ("not",), ("zz",), (None,)], "k string")
    assert [r[0] for r in df.select(validate.to_bool(df, "k")).collect()] == [True, False, True, None, None, None]
    df = spark.createDataFrame([(0.0,), (1e-9,), (float("nan"),), (2.0,)], "k double")
    assert [r[0] for r in df.select(validate.to_bool(df, "k")).collect()] == [False, False, True, True]
    df = core(spark, [("a", "b", "c", "ABCDEFGHIJ"), ("b", "b", "c", "ABCDEFGHIJ"), ("c", "b", "c", "KLMNOPQRST"), ("d", "b", "c", "bad1")], ", uid string")
    got = [r.uid for r in validate.check_table(df).orderBy(ROW).collect()]
    assert got[2] == "KLMNOPQRST" and "ABCDEFGHIJ" not in got and len(set(got)) == 4
    s = spark.createDataFrame([("abcdef", 1, 3), ("abcdef", -3, -1), ("abcdef", 4, 2)], "s string, a int, b int")
    assert [r[0] for r in s.select(validate.sliced(F.col("s"), F.col("a"), F.col("b"))).collect()] == ["bc", "de", ""]


def slow_clusters(rows):
    """Connected components of closed intervals that overlap."""
    n = len(rows)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if rows[i][0] <= rows[j][1] and rows[j][0] <= rows[i][1]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in set(label)}


def test_islands_against_pairs(spark):
    rng = random.Random(3)
    rows = [(g, k, a := rng.randint(0, 60), a + rng.randint(0, 8)) for g in range(40) for k in range(rng.randint(1, 9))]
    got = intervals.islands(spark.createDataFrame(rows, "g long, k long, a long, b long"), ["g"], "a", "b").collect()
    for g in range(40):
        mine = [(r[2], r[3]) for r in rows if r[0] == g]
        want = slow_clusters(mine)
        found = {frozenset(r.k for r in got if r.g == g and r.island == i) for i in {r.island for r in got if r.g == g}}
        assert found == want


def test_fold_and_merge(spark):
    assert intervals.fold_labels([1, 5, 100], [6, 9, 110]) == [1, 1, -1]
    assert intervals.fold_labels([1, 20, 5], [6, 30, 22]) == [2, 2, 2]
    rows = [("x", None, None, None, None, 0.1, 1.0, "S1", 1, 10, 0, 0, "q0"), ("x", None, None, None, None, 0.01, 1.0, "S2", 5, 20, 0, 0, "q1"), ("x", None, None, None, None, 0.5, 1.0, "S3", 50, 60, 0, 0, "q0"), ("y", None, None, None, None, 0.2, 1.0, "S4", 1, 10, 0, 0, "q0")]
    hits = spark.createDataFrame(rows, HITS).coalesce(1).withColumn(ROW, F.monotonically_increasing_id())
    got = sorted((r.accession, r.subject_start, r.subject_end, r.e_value, r.query, r.sequence) for r in intervals.merge_hits(hits).collect())
    assert got == [("x", 1, 20, 0.01, "q0|1-10;q1|5-20", "S2"), ("x", 50, 60, 0.5, "q0", "S3"), ("y", 1, 10, 0.2, "q0", "S4")]
    longest = intervals.merge_hits(hits, "longest").where("accession = 'x' AND subject_start = 1").first()
    assert longest.sequence == "S2"


@pytest.mark.parametrize(("hits", "temperature", "want"), [([(1, "A"), (1, "B")], 1, (0.5, 0.5)), ([(100, "A"), (1, "B")], 1, (1.0, 0.0)), ([(100, "A"), (1, "B")], 1e9, (0.5, 0.5)), ([(1, "A"), (1, "A")], 1, (1.0, 0.0)), ([(1, "X"), (1, "Y")], 1, (0.0, 0.0)), ([(3000, "A"), (2900, "B")], 1, (2 ** (3000 / 4) / (2 ** (3000 / 4) + 2 ** (2900 / 4)), None))])
def test_posteriors(spark, hits, temperature, want):
    df = spark.createDataFrame([(1, float(b), d) for b, d in hits], "q long, bits double, hit_def string")
    r = posterior.shares(df, "q", "bits", {n: F.col("hit_def").contains(n) for n in "AB"}, temperature).first()
    for got, w in zip((r.post_A, r.post_B), want, strict=True):
        assert w is None or got == pytest.approx(w, abs=1e-6)


def walk(posts, limit, drop):
    import itertools

    names = sorted(posts)
    combos = [c for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]
    scored = sorted(((sum(posts[n] for n in c), i) for i, c in enumerate(combos)), reverse=True)
    best = scored[0]
    for x in scored[1:]:
        if abs(best[0]) > 1e-8 and x[0] / best[0] > drop:
            best = x
    return ("/".join(combos[best[1]]), True) if best[0] > limit else (None, False)


def test_calls_against_walk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        p = rng.dirichlet(np.ones(3) * rng.choice([0.1, 1])) * rng.choice([1, 0.96, 0.5, 0])
        rows.append((i, *map(float, p)))
    df = spark.createDataFrame(rows, "q long, post_a double, post_b double, post_c double")
    got = {r.q: (r.paralog, r.found) for r in posterior.call(df, ["a", "b", "c"]).collect()}
    assert got == {i: walk(dict(zip("abc", p, strict=True)), 0.95, 0.9) for i, *p in rows}


def test_alignment_scores(spark):
    rng = random.Random(7)
    rows = [(f"u{i}", "".join(rng.choice("AC-") for _ in range(20)), True) for i in range(9)]
    df = spark.createDataFrame(rows, "uid string, alignment string, keep boolean")
    got = {r.uid: (r.fx_in_sparse, r.fx_missing_dense, r.sparse_run_length) for r in alignment.score(df, cutoff=0.4, trim=(0.1, 0.9)).collect()}
    a, b = round(20 * 0.1), round(20 * 0.9)
    cut = [r[1][a:b] for r in rows]
    cols = [c for c in range(b - a) if any(s[c] != "-" for s in cut)]
    sparse = [sum(s[c] == "-" for s in cut) / 9 >= 0.4 for c in cols]
    for (u, *_), s in zip(rows, cut, strict=True):
        res = [s[c] != "-" for c in cols]
        best = run = 0
        for r, p in zip(res, sparse, strict=True):
            run = run + r if p else 0
            best = max(best, run)
        want = (sum(r and p for r, p in zip(res, sparse, strict=True)) / len(cols), sum(not r and not p for r, p in zip(res, sparse, strict=True)) / max(1, sparse.count(False)), best)
        assert got[u][0] == pytest.approx(want[0]) and got[u][1] == pytest.approx(want[1]) and got[u][2] == want[2]
    nan = alignment.score(df, cutoff=0.0).first().fx_missing_dense
    assert nan != nan
    polished = alignment.polish(df.withColumn("partial", F.lit(False)))
    assert polished.count() == 9 and polished.where("NOT keep").count() < 9


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbca")], "g int, i int, v string")
    got = sorted((r.start, r.value, r.length) for r in alignment.run_lengths(df, ["g"], ["i"], "v").collect())
    assert got == [(0, "a", 2), (2, "b", 3), (5, "c", 1), (6, "a", 1)]


def test_greedy(spark):
    assert dedup.greedy(["TEST", "TAST"], [(0,), (1,)], 0.9, [False] * 2, [False] * 2, False) == [True, True]
    assert dedup.greedy(["TEST", "TAST"], [(0,), (1,)], 0.5, [False] * 2, [False] * 2, False) == [True, False]
    assert dedup.greedy(["TEST", "TAST"], [(1,), (0,)], 0.5, [False] * 2, [False] * 2, False) == [False, True]
    assert dedup.greedy(["TEST", "TAST"], [(1,), (0,)], 0.5, [True] * 2, [False] * 2, False) == [True, True]
    assert dedup.greedy(["TEST", "TAST"], [(0,), (0,)], 0.5, [False] * 2, [True] * 2, False) == [True, True]
    assert dedup.greedy(["TEST", "TAST"], [(0,), (0,)], 0.5, [False] * 2, [True] * 2, True) == [True, False]
    rows = [("Homo", f"n{i}", "MKVLAWWCDEFGH"[: 13 - i % 3] + "AC" * (i % 4), f"{'ABCDEFGHIJ'[i] * 10}", True, i == 3) for i in range(8)]
    df = core(spark, rows, ", uid string, keep boolean, always_keep boolean")
    out = dedup.remove_redundancy(df, 0.9)
    kept = {r.name for r in out.where("keep").collect()}
    assert "n3" in kept and 0 < len(kept) < 8
    assert {r.name for r in dedup.shrink_in_species(df, 0.9).where("keep").collect()} == kept
    assert dedup.find_cutoff(lambda c: round(100 * c), 50) == pytest.approx(0.5, abs=0.02)
    assert dedup.find_cutoff(lambda c: 5, 10) == 0.99 and dedup.find_cutoff(lambda c: 50, 10) == 0.25


def test_budgets():
    t = parse("(((A,B),(C,(D,H))),(E,F));")
    for leaf in t.leaves():
        leaf.props["uids"] = [f"x{leaf.name}"]
    assert budgets.capped({"X": 9, "Y": 9}, {"X": 7, "Y": 7}) == {"X": 7, "Y": 7}
    assert budgets.capped({"Y": 10, "X": 11}, {"Y": 14, "X": 7}) == {"Y": 14, "X": 7}
    assert budgets.even_budget(["X", "Y"], 18) == {"X": 9, "Y": 9} and sum(budgets.even_budget(["a", "b", "c"], 10).values()) >= 10
    budgets.clade_budgets(t, 4)
    left, right = t.children
    assert (left.props["budget"], right.props["budget"]) == (2, 2)
    blocks = budgets.taxonomic_blocks(t, 4)
    assert sum(b for b, _ in blocks) == 4 and sorted(u for _, us in blocks for u in us) == [f"x{c}" for c in "ABCDEFH"]
    assert sorted(map(len, budgets.even_blocks(t, 3))) == [2, 2, 3]
    rows = budgets.merge_blocks({"p": t}, 5)
    assert {r[3] for r in rows} == {f"x{c}" for c in "ABCDEFH"}
    with pytest.raises(TableError):
        budgets.clade_budgets(parse("(A,B,C);"), 2)


def test_taxonomy(spark):
    t = taxonomy.induced_tree({"a": "g1", "b": "g1", "c": "g2", "g1": "f", "g2": "f", "f": "root", "root": None}, ["a", "b", "c"])
    assert sorted(x.name for x in t.leaves()) == ["a", "b", "c"] and all(len(n.children) in (0, 2) for n in t.preorder())
    assert taxonomy.taxa_order(t, "c")[0] == "c" and taxonomy.taxa_order(t, "a")[:2] == ["a", "b"]
    lin = spark.createDataFrame([(1, ["cellular organisms", "Eukaryota", "Chordata", "Homo"]), (1, ["cellular organisms", "Eukaryota", "Chordata", "Mus"]), (2, ["cellular organisms", "Bacteria", "X"]), (3, [])], "g long, l array<string>")
    got = {r.g: r for r in taxonomy.common_prefix(lin, ["g"], "l").select("g", "prefix", taxonomy.mrca(F.col("prefix")).alias("m"), taxonomy.mrca(F.col("prefix"), 1).alias("up")).collect()}
    assert got[1].m.taxon == "Chordata" and got[1].up.taxon == "Eukaryota" and not got[1].m.is_microbial
    assert got[2].m.taxon == "Bacteria" and got[2].m.is_microbial and got[3].m.taxon == "life"
    names = spark.createDataFrame([("homo sapiens", "ott1", "Homo sapiens", True, False), ("mus", "ott2", "Mus musculus", False, False), ("two", "ott3", "Two a", True, False), ("two", "ott4", "Two b", False, False), ("syn", "ott5", "Syn a", True, False), ("syn", "ott6", "Syn b", False, True)], "query string, ott string, canonical string, is_exact boolean, is_synonym boolean")
    df = core(spark, [("Homo sapiens", "a", "M"), ("mus strain 7", "b", "M"), ("two", "c", "M"), ("syn", "d", "M"), ("none", "e", "M")]).withColumn("keep", F.lit(True)).withColumn("always_keep", F.col("name") == "e")
    got = {r.name: r for r in taxonomy.add_species_ids(df, names).collect()}
    assert [got[n].ott for n in "abcde"] == ["ott1", "ott2", None, "ott5", None]
    assert [got[n].keep for n in "abcde"] == [True, True, False, True, False] and not got["e"].always_keep
    assert got["b"].species == "Mus musculus" and got["b"].orig_species == "mus strain 7"
    order = taxonomy.sort_by_taxa(df.withColumn("ott", F.concat(F.lit("ott"), F.col(ROW).cast("string"))).withColumn("name", F.lit("p")), ["ott3", "ott0", "ott4"]).collect()
    assert [r[ROW] for r in order][:3] == [3, 0, 4]
    paths = taxonomy.tree_paths(spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "r"), ("r", None), ("d", "c"), ("e", "d")], "node string, parent string"))
    assert {(r.node, r.ancestor, r.distance) for r in paths.where("node = 'e'").collect()} == {("e", x, i) for i, x in enumerate("edcbar")}


def test_search(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120)) for _ in range(30)]
    db = spark.createDataFrame([(f"acc{i}", f"protein {i}", s) for i, s in enumerate(seqs)], "accession string, hit_def string, sequence string")
    q = spark.createDataFrame([("count10", seqs[4][20:100]), ("count2", seqs[7][:60] + "WWWW" + seqs[7][60:])], "query string, sequence string")
    got = search.in_query_order(search.search(q, db)).collect()
    assert [(r.query, r.accession) for r in got] == [("count2", "acc7"), ("count10", "acc4")] and all(r.e_value < 1e-9 for r in got)
    assert search.search(q, db, cutoff=0.0).count() == 0


def test_search_scores_every_candidate(spark):
    rng = random.Random(6)
    query = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60))
    grams = [query[i : i + 4] for i in range(0, 60, 4)]
    decoys = ["GP".join(rng.sample(grams, len(grams))) for _ in range(510)]  # more 4-mers in common than the relative has
    relative = "".join(c if i % 5 else "GP"[c == "G"] for i, c in enumerate(query))
    db = spark.createDataFrame([*[(f"acc{i:03d}", "", s) for i, s in enumerate(decoys)], ("relative", "", relative)], "accession string, hit_def string, sequence string")
    got = search.search(spark.createDataFrame([("q1", query)], "query string, sequence string"), db).orderBy(ROW).collect()
    assert got[0].accession == "relative"


def test_limits_of_old_are_gone(spark):
    """More than 64 steps to the root, more than 12 paralogs, bits far beyond the temperature, long report tables."""
    import itertools

    from kinlattice.operators import posterior
    from kinlattice.plans import report

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 139 else None) for i in range(140)], "node string, parent string")
    paths = taxonomy.tree_paths(chain)
    assert paths.count() == 140 * 141 // 2 and paths.agg({"distance": "max"}).first()[0] == 139
    hits = spark.createDataFrame([("q", 1000.0, "a"), ("q", 999.0, "b"), ("r", 3.0, "b")], "query string, bits double, hit string")
    marks = {n: posterior.F.col("hit") == n for n in ("a", "b")}
    got = {r["query"]: r for r in posterior.shares(hits, "query", "bits", marks, 0.01).collect()}
    t = 0.01 * 2**7  # the first temperature at which 2^(1000 / T) + 2^(999 / T) is finite
    assert got["q"].post_a == pytest.approx(2 ** (1 / t) / (1 + 2 ** (1 / t))) and got["r"].post_b == 1
    names = [f"p{i:02}" for i in range(14)]
    rows = [[0.0] * 14 for _ in range(4)]
    rows[0][3] = 1.0
    rows[1][1], rows[1][5] = 0.5, 0.5
    rows[2][0], rows[2][12], rows[2][13] = 0.6, 0.3, 0.1
    posts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + ", ".join(f"post_{n} double" for n in names))
    many = {r.k: (r.paralog, r.found) for r in posterior.call(posts, names).collect()}
    small = {}
    for i, r in enumerate(rows):
        some = [n for n, p in zip(names, r, strict=True) if p] or names[:1]
        one = posterior.call(posts.where(f"k = {i}"), some).first()
        small[i] = (one.paralog, one.found)
    assert many == small and many[0][0] == "p03" and list(itertools.islice(many, 4))
    page = report.table_of(spark.range(30), limit=10)
    assert "20 more rows" in page and page.count("<tr") == 11


def test_headers_may_hold_the_record_sign(spark, tmp_path):
    from kinlattice.sources import fasta

    (tmp_path / "a.fasta").write_text(">a1 beta->alpha kinase\nMK\nLV\n>b2 x\nGG\n")
    for got in (fasta.read_fasta(spark, str(tmp_path / "a.fasta")), fasta.records(spark, (tmp_path / "a.fasta").read_text().splitlines())):
        assert [(r.header, r.sequence) for r in got.orderBy("row_id").collect()] == [("a1 beta->alpha kinase", "MKLV"), ("b2 x", "GG")]
