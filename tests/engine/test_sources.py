import gzip

import pytest
from pyspark.sql import functions as F

from kinlattice import cli
from kinlattice.operators.validate import check_table
from kinlattice.plans import pipeline, report
from kinlattice.schema import ROW, TableError
from kinlattice.sources import catalog, fasta, hits_xml, logs, phylip, remote, tables
from kinlattice.sources.newick import parse


def aligned(spark):
    rows = [(0, "Homo sapiens", "A", "MKVL", "AAAAAAAAAA", True, "MK-VL", "ott1"), (1, "Mus musculus", "B, x", "MKL", "BBBBBBBBBB", True, "MK--L", "ott2"), (2, "Rattus", "C", "MX", "CCCCCCCCCC", False, "XX---", "ott3")]
    return spark.createDataFrame(rows, f"{ROW} long, species string, name string, sequence string, uid string, keep boolean, alignment string, ott string")


@pytest.mark.parametrize("ext", ["csv", "tsv", "dat"])
def test_tables_round_trip(spark, tmp_path, ext):
    path = str(tmp_path / f"t.{ext}")
    df = check_table(aligned(spark))
    tables.write_table(df, path)
    back = tables.read_table(spark, path)
    cols = [c for c in df.columns if c != ROW]
    assert [tuple(r) for r in back.orderBy(ROW).select(cols).collect()] == [tuple(r) for r in df.orderBy(ROW).select(cols).collect()]
    with pytest.raises(Exception):  # noqa: B017
        tables.write_table(df, path)
    (tmp_path / "i.csv").write_text(",species,name,sequence\n0,a,b,MK\n1,c,d,ML\n")
    assert "_c0" not in tables.read_table(spark, str(tmp_path / "i.csv")).columns
    assert tables.delimiter("a;b;c") == ";"


def test_fasta(spark, tmp_path):
    df = aligned(spark)
    fasta.write_fasta(df, str(tmp_path / "o"))
    f = fasta.read_fasta(spark, str(tmp_path / "o"))
    assert {(r.header, r.sequence) for r in f.collect()} == {("AAAAAAAAAA|Homo sapiens|A", "MK-VL"), ("BBBBBBBBBB|Mus musculus|B, x", "MK--L")}
    got = {r.uid: (r.keep, r.alignment) for r in fasta.read_into(df.withColumn("keep", F.lit(True)), f).collect()}
    assert got == {"AAAAAAAAAA": (True, "MK-VL"), "BBBBBBBBBB": (True, "MK--L"), "CCCCCCCCCC": (False, None)}
    with pytest.raises(TableError):
        fasta.read_into(df, fasta.records(spark, [">nope|x", "AA"]))
    with pytest.raises(TableError):
        fasta.read_into(df, fasta.records(spark, [">AAAAAAAAAA", "AA", ">AAAAAAAAAA|z", "AC"]))
    with pytest.raises(TableError):
        fasta.write_fasta(df.where("name = 'C'"), str(tmp_path / "none"), only_kept=False)
    with gzip.open(tmp_path / "z.faa.gz", "wt") as g:
        g.write(">XP_1.1 thing [Mus]\nMK\nVL\n>XP_2.1 other\nA\n")
    assert [(r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "z.faa.gz")).collect()] == [("XP_1.1 thing [Mus]", "MKVL"), ("XP_2.1 other", "A")]
    recs = fasta.records(spark, [">sp|P1|S1_HUMAN Protein one OS=Homo sapiens OX=9606 GN=ONE PE=1 SV=2", "MK", ">sp|P2|S2_HUMAN PROTEIN ONE OS=Mus musculus OX=1", "ML"])
    got = {r.name: r for r in fasta.protein_seed(recs).collect()}
    assert got["ONE"].aliases == "P1;S1_HUMAN;Protein one" and got["ONE"].species == "Homo sapiens" and got["S2_HUMAN"].aliases == "P2"


def test_phylip(spark, tmp_path):
    phylip.write_phylip(aligned(spark), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in (tmp_path / "p").glob("part*"))
    assert text.split("\n")[0] == "2 5"
    got = [(r.uid, r.alignment) for r in phylip.read_phylip(spark, str(tmp_path / "p")).orderBy(ROW).collect()]
    assert got == [("AAAAAAAAAA", "MK-VL"), ("BBBBBBBBBB", "MK--L")]
    with pytest.raises(TableError):
        phylip.to_phylip(aligned(spark), column="sequence")


XML = """<?xml version="1.0"?>

<BlastOutput><BlastOutput_iterations>
CREATE_VIEW
<Iteration><Iteration_query-def>count0</Iteration_query-def><Iteration_hits>
<Hit><Hit_id>ref|XP_1.1|</Hit_id><Hit_def>thing [Mus]</Hit_def><Hit_accession>XP_1</Hit_accession><Hit_len>50</Hit_len><Hit_hsps>
<Hsp><Hsp_bit-score>99.5</Hsp_bit-score><Hsp_evalue>1e-20</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>3</Hsp_hit-from><Hsp_hit-to>12</Hsp_hit-to><Hsp_hseq>MK-VL</Hsp_hseq></Hsp>
<Hsp><Hsp_bit-score>9</Hsp_bit-score><Hsp_evalue>1</Hsp_evalue><Hsp_hit-from>30</Hsp_hit-from><Hsp_hit-to>32</Hsp_hit-to><Hsp_hseq>AA</Hsp_hseq></Hsp>
</Hit_hsps></Hit></Iteration_hits></Iteration>
<Iteration><Iteration_query-def>count1</Iteration_query-def>{message}</Iteration>
</BlastOutput_iterations></BlastOutput>
"""


def test_hits_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(message=""))
    got, bad = hits_xml.read_hits(spark, str(tmp_path / "a.xml"), clean=True, check_limit=True)
    rows = got.orderBy(ROW, "ord").collect()
    assert bad == [] and [(r.query, r.accession, r.bits, r.e_value, r.sequence, r.subject_start, r.subject_end) for r in rows] == [("count0", "XP_1", 99.5, 1e-20, "MKVL", 3, 12), ("count1", None, None, None, None, None, None)]
    (tmp_path / "b.xml").write_text(XML.replace("CREATE_VIEW\n", "").format(message="<Iteration_message>CPU usage limit was exceeded</Iteration_message>"))
    none, bad = hits_xml.read_hits(spark, str(tmp_path / "b.xml"), check_limit=True)
    assert none is None and len(bad) == 1 and bad[0].endswith("b.xml")
    assert hits_xml.read_hits(spark, str(tmp_path / "b.xml"))[0].count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "fit.log").write_text("Final LogLikelihood: -530.25\nAIC score: 1086.5 / AICc score: 1092.532923 / BIC score: 1093.8\nFree parameters (model + branch lengths): 13\n")
    r = logs.model_fit(spark, str(tmp_path / "fit.log")).first()
    assert (r.L, r.AIC, r.AICc, r.BIC, r.N) == (-530.25, 1086.5, 1092.532923, 1093.8, 13)
    (tmp_path / "conv.log").write_text(" # trees  avg WRF  avg WRF in %  # perms: wrf <= 3.00 %  converged?\n 50 12.5 4.2 0 NO\n 100 9.1 2.5 995 YES\n")
    got = logs.convergence(spark, str(tmp_path / "conv.log")).orderBy("trees").collect()
    assert [(x.trees, x.converged, x.converged_at) for x in got] == [(50, True, False), (100, True, True)]
    (tmp_path / "c.txt").write_text("S:12\nD:3\n")
    assert {r.event: r.n for r in logs.event_counts(spark, str(tmp_path / "c.txt")).collect()} == {"S": 12, "D": 3}


def test_run_folders(spark, tmp_path):
    a = catalog.Run(str(tmp_path / "00_a"), "ml_tree", seed="s1")
    a.event("made", n=3)
    (a.path / "output" / "tree.newick").write_text("(A,B);")
    a.finalize()
    assert a.status == "complete" and a.tree_prefix == "gene"
    b = catalog.Run(catalog.next_folder(str(tmp_path), "b"), "reconcile_x", previous=a)
    assert b.path.name == "01_b" and b.facts["seed"] == "s1" and (b.path / "input" / "tree.newick").exists() and b.tree_prefix == "reconciled"
    b.check_required(["seed"], ["tree.newick"])
    with pytest.raises(TableError):
        b.check_required(["nothing"])
    with pytest.raises(TableError):
        catalog.Run(str(tmp_path / "00_a"), "x")
    runs = catalog.read_runs(spark, str(tmp_path / "*" / catalog.RECORD))
    assert runs.count() == 2 and [r.calc_type for r in catalog.latest(runs).collect()] == ["ml_tree"]
    (tmp_path / "list.txt").write_text("a # x\n\n# y\nb\n")
    assert [r.value for r in catalog.list_file(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]


def test_offline_services(spark):
    store = spark.createDataFrame([("1STN_A", "MK"), ("XP_1", "ML")], "accession string, sequence string")
    wanted = spark.createDataFrame([(0, "pdb|1STN|A"), (1, "nope"), (2, "ref|XP_1|")], f"{ROW} long, accession string")
    assert [r.sequence for r in remote.fetch_sequences(wanted, store).orderBy(ROW).collect()] == ["MK", None, "ML"]
    names = spark.createDataFrame([("Homo sapiens", 9606)], "name string, taxid long")
    assert remote.taxon_ids(spark.createDataFrame([("homo sapiens strain x",)], "species string"), names).first().taxid == 9606
    with pytest.raises(TableError):
        remote.taxon_ids(spark.createDataFrame([("x",)], "species string"), names)
    a = spark.createDataFrame([(1, "g1", "u1", "na", "refseq", "2020/01/01"), (1, "g2", "u2", "reference genome", "genbank", "2021/01/01"), (1, "g3", "u3", "reference genome", "genbank", "2019/01/01")], "taxid int, assembly string, url string, refseq_class string, place string, date string")
    assert remote.choose_assembly(a).first().assembly == "g3"
    b = remote.batches(spark.createDataFrame([(i, "x" * 30) for i in range(10)], f"{ROW} long, s string"), 100, F.length("s")).collect()
    assert max(sum(r.batch == k for r in b) for k in {r.batch for r in b}) <= 4


def test_pipelines_and_report(spark, tmp_path):
    import random

    rng = random.Random(2)
    base = {p: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for p in ("ONE", "TWO")}

    def near(s, n):
        out = list(s)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        return "".join(out)

    species = ["Homo sapiens", "Mus musculus", "Gallus gallus", "Danio rerio"]
    seed = spark.createDataFrame([(sp, p, f"{p} protein", base[p]) for p in base for sp in species[:2]], "species string, name string, aliases string, sequence string")
    db = spark.createDataFrame([(f"XP_{i}", f">ref|XP_{i}.1| {p} protein [{sp}]", near(base[p], 6)) for i, (p, sp) in enumerate((p, sp) for p in base for sp in species)], "accession string, title string, sequence string")
    proteomes = db.select("accession", F.col("title").alias("hit_def"), "sequence")
    out = str(tmp_path / "s2a")
    done = pipeline.seed_to_alignment(spark, seed, db, proteomes, out, overwrite=True)
    rows = done.collect()
    assert len({len(r.alignment) for r in rows}) == 1 and {r.nickname for r in rows} <= {"ONE", "TWO"} and len(rows) >= 6
    assert all(r.recip_paralog in ("ONE", "TWO") for r in rows)
    s = pipeline.Stages(spark, out, restart=True)
    s.table("03_initial", lambda: 1 / 0)
    assert s.ran == []
    with pytest.raises(ValueError):
        pipeline.Stages(spark, out, True, True)
    ott = {sp: f"ott{i}" for i, sp in enumerate(species)}
    df = done.drop("ott").withColumn("ott", F.element_at(F.create_map(*[F.lit(x) for kv in ott.items() for x in kv]), F.col("species")))
    tree = "(((ott0,ott1),ott2),ott3);"
    got = pipeline.alignment_to_ancestors(spark, df, str(tmp_path / "a2a"), tree, replicates=4, overwrite=True)
    assert got["sites"].count() == (len(rows) - 1) * len(rows[0].alignment) and got["summary"].count() == len(rows) - 1
    assert got["reconciled"].first().duplications >= 1 and got["support"].where("bs_support > 0").count() >= 1
    boot = pipeline.bootstrap_reconcile(spark, df, tree, str(tmp_path / "br"), replicates=4, step=2, overwrite=True)
    assert boot["replicates"].count() == 4 and boot["convergence"].count() == 1
    page = report.write_report(str(tmp_path / "rep"), "R <1>", [report.input_card(df), report.tree_card("T", parse("((A:1,B:1)90:1,C:2);"), "bs_support"), report.ancestor_card("anc1", got["sites"]), report.param_card({"a": 1.5})])
    text = open(page).read()
    assert "R &lt;1&gt;" in text and "<svg" in text and (tmp_path / "rep.zip").exists()
    assert report.histogram([0.0, 1.0, 0.05])[0] == 1 and report.histogram([1.0])[-1] == 1
    assert cli.main(["check-installed"]) == 0 and cli.parser().parse_args(["create-report", "a", "b"]).command == "create-report"
