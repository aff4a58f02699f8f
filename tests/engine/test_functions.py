import math
import random

import pytest
from pyspark.sql import functions as F

from kinlattice.functions import arguments, numbers, text
from kinlattice.functions.patterns import Pattern, alias_regex, build_patterns, with_nicknames
from kinlattice.functions.sequences import align_group, lcs_length, local_score, similarity


def test_cutoffs(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert numbers.rank_cutoff(df, "x", 0.975).first()["cutoff"] == 10
    assert numbers.binned_cutoff(list(range(1, 11)), 5, 0.9) == 7.75
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        xs = [rng.randint(0, 9) for _ in range(n)]
        got = numbers.rank_cutoff(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x", 0.9).first()["cutoff"]
        assert got == sorted(xs)[min(round(n * 0.9), n - 1)]


def test_modal_bin(spark):
    xs = [1.0, 1.5, 2.0, 9.0, 9.5, 9.9, 10.0]
    r = numbers.modal_bin(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()
    bins, w = 5, 9 / 5
    held = [sum(min(int((x - 1) / w), bins - 1) == b for x in xs) for b in range(bins)]
    assert r["in_bin"] == max(held) and r["left_edge"] == pytest.approx(1 + held.index(max(held)) * w)
    assert numbers.modal_bin(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").first()["left_edge"] == 3


def test_small_numbers(spark):
    assert [numbers.digits_to_round(v) for v in (0, 0.00123, 1.5, 120)] == [0, 4, 1, 0]
    assert numbers.compare_versions((5, 1), (5, 1, 0)) == 0 and numbers.compare_versions((5,), (5, 1)) == -1
    r = spark.range(1).select(numbers.half_even(F.lit(2.5)).alias("a"), numbers.half_even(F.lit(3.5)).alias("b"), numbers.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("e"), numbers.scaled(F.lit(5.0), 0, 10, 1, 3).alias("s")).first()
    assert (r.a, r.b, r.s) == (2, 4, 2.0) and r.e == pytest.approx(math.log(2))


def test_arguments():
    assert arguments.as_bool(1) is True and arguments.as_int(3.0, low=3) == 3 and arguments.as_float(2) == 2.0
    for bad in (lambda: arguments.as_int(3.5), lambda: arguments.as_int(3, low=3, inclusive=(False, True)), lambda: arguments.as_bool("x"), lambda: arguments.as_list("abc"), lambda: arguments.as_float(float("nan")), lambda: arguments.as_list([1], kind=str)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("alias", "want"), [("ABC1", r"abc[\ \-_\.]*1"), ("a-b c", r"a[\ \-_\.]*b[\ \-_\.]*c"), ("MD2", r"md[\ \-_\.]*2"), (" LY 96 ", r"ly[\ \-_\.]*96")])
def test_alias_regex(alias, want):
    assert alias_regex(alias) == want


def test_patterns_and_nicknames(spark):
    ps = {p.name: p for p in build_patterns({"test": ["A"], "this": ["AX"]})}
    assert ps["this"].regex == "ax|this" and ps["test"].regex == "^(?!.*(ax)).*(a|test)"
    assert ps["test"].search("A thing") and not ps["test"].search("ax") and ps["this"].search("AX")
    with pytest.raises(ValueError):
        build_patterns({"x": ["same"], "y": ["Same "]})
    df = spark.createDataFrame([(n,) for n in ("rocking", "out", "in", "the", "usa")], "name string")
    got = with_nicknames(df, [Pattern("fixed", "rocking|out"), Pattern("junk", "the|usa")]).collect()
    assert [r.nickname for r in got] == ["fixed", "fixed", "unassigned", "junk", "junk"]
    with pytest.raises(ValueError):
        with_nicknames(df, [], source="nope")


def test_headers(spark):
    lines = [
        "pdb|1STN|A Chain A, STAPHYLOCOCCAL NUCLEASE [Staphylococcus aureus]",
        ">ref|XP_0123.1| low quality protein:  S100-A9 isoform X1 [Homo sapiens]",
        "ref|XP_1.2| thing [[Candida] auris]",
        "no bars at all",
        "gb|AB.1| one [Mus musculus]>gb|CD.2| two [[x] Rattus rattus]",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    got = {r.i: r.h for r in df.select("i", text.parse_header(F.col("line")).alias("h")).collect()}
    assert got[0].accession == "1STN_A" and got[0].species == "Staphylococcus aureus"
    assert (got[1].accession, got[1].species, got[1].name) == ("XP_0123", "Homo sapiens", "low quality protein: S100-A9 isoform X1")
    assert got[2].species == "[Candida] auris" and got[3] is None and got[4].accession == "AB"
    two = df.where("i = 4").select(text.parse_header(F.col("line"), F.lit("CD")).alias("h")).first().h
    assert (two.accession, two.species) == ("CD", "[x] Rattus rattus")
    f = df.where("i = 1").select(*text.flags(F.col("line"))).first().asDict()
    assert f == {"structure": False, "low_quality": True, "predicted": False, "precursor": False, "isoform": True, "hypothetical": False, "partial": False}
    s = spark.createDataFrame([("Escherichia coli strain K12",), ("E. coli str. K",)], "s string").select(text.without_strain(F.col("s")).alias("s")).collect()
    assert [r.s for r in s] == ["Escherichia coli", "E. coli"]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("u1", "Homo", "a long protein name", True), ("u2", "Homo", "a long protein", True), ("u3", "Mus", "b", False)], "uid string, species string, name string, keep boolean")
    assert {r.uid: r.label for r in text.labels(df).collect()} == {"u1": "Homo|a long pro...|u1", "u2": "Homo|a long pro...|u2", "u3": "Mus|b"}
    assert {r.uid: r.label for r in text.labels(df, ["species", "name"]).collect()} == {"u1": "Homo|a long protein name", "u2": "Homo|a long protein"}
    r = df.select(text.unprotect_name(text.protect_name(F.col("name"))).alias("n"), F.col("name"), text.text_uid("uid").alias("u")).collect()
    assert all(x.n == x.name and len(x.u) == 10 and x.u.isalpha() for x in r) and len({x.u for x in r}) == 3
    assert text.css_color([1, 0, 0]) == "#ff0000" and text.blend("#000000", "#ffffff", 0.5) == "#808080"


def test_sequences():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    assert similarity("TEST", "TAST") == 0.75
    assert local_score("MKVLAWWCDE", "MKVLAWWCDE")[0] == 50 and local_score("AAAA", "WWWW")[0] == 0
    ali = align_group(["MKVLAWWCDE", "MKVLWWCDE", "KVLAWWCD", "MKVLAWWCDE"])
    assert len({len(x) for x in ali}) == 1 and [x.replace("-", "") for x in ali] == ["MKVLAWWCDE", "MKVLWWCDE", "KVLAWWCD", "MKVLAWWCDE"]
    assert align_group([]) == [] and align_group(["A"]) == ["A"]
