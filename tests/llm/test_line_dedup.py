import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kinlattice.llm import line_dedup as ld


def brute(rows, least, spare=False):
    sites = defaultdict(set)
    for _, text, _, site, _ in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(" ") and site is not None:
                sites[line.strip(" ")].add(site)
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None))
            continue
        lines = text.split("\n")
        keep = [x for x in lines if not x.strip(" ") or len(sites[x.strip(" ")]) < least]
        out.append((i, text if spare and not any(x.strip(" ") for x in keep) else "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 5, 9])
def test_against_brute_force(docs, least, monkeypatch):
    rng = random.Random(least)
    common = [f"line {i} é" for i in range(12)] + ["", "  ", " line 3 é "]
    rows = []
    for i in range(120):
        lines = [rng.choice(common[: 3 + i % 13]) if rng.random() < 0.4 else f"own {i} {j} some longer text" for j in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines), "en", rng.choice([None, *[f"s{k}" for k in range(12)]]), 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (3, rows[3][1], "en", "s4", 1), (None, "line 1 é\nmine alone, and long enough", "en", "s2", 1), (502, "\n".join(f"x{i}" for i in range(20_000)), "en", "s3", 1)]
    monkeypatch.setattr(ld, "SALTED", 20)  # hot lines are salted
    names = ["r1", "r2", "_r1", "_r2", "_at", "at", "_lines", "lines", "done", "h1", "salt", "places"]
    df = docs(rows).withColumnRenamed("n_chars", "row").withColumns({n: F.lit(n) for n in names})
    for spare in (False, True):
        got = ld.dedup(df, least, spare_copies=spare)
        assert got.columns == df.columns
        rest = got.collect()
        assert sorted(((r.doc_id, r.text) for r in rest), key=repr) == brute(rows, least, spare)
        assert all(r[n] == n for r in rest for n in names)
    assert ld.dedup(docs([])).count() == 0


def test_exact_counts_decide_near_the_threshold(docs):
    rows = [(i * 100 + j, f"shared {i}\nown line of {i} and {j} that is long", "en", f"site{j}", 1) for i in range(1, 80) for j in range(i)]
    got = {r.h1 for r in ld.boilerplate(docs(rows), 40).collect()}
    assert len(got) == 40


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, ld.query(spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.sql(ld.ORACLE).fetchall())
    assert sum(r[2] for r in got) > 0 and got[0][3] == hashlib.sha256(spark.read.parquet(f"{d}/documents.parquet").where(f"doc_id = {got[0][0]}").first().text.encode()).hexdigest() or got[0][2]
