import random
from collections import defaultdict

import test_decontam
import test_line_dedup
import test_ngram_join
from pyspark.sql import functions as F

import corpus_pipeline
from kinlattice.llm import common, language_id, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows, computed the slow way; language by the trained network itself."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    rng = random.Random(6)
    some = [r for r in rows if len(r[1] or "") < 3000][:120]
    footer = "All of this text may be shared by anyone who reads it"
    made = []
    for i, r in enumerate(some):
        own = f"{r[1]}\n{footer}"
        made.append((r[0], own, r[2], f"s{i % 15}", len(own)))
    long = [m for m in made if len(m[1].split()) > 80 and len(set(m[1].split())) > 60]
    w = long[5][1].split()
    w[3] = "changed"
    made += [(9001, " ".join(w), "en", "s2", 1), (9002, long[6][1], "en", "s3", 1), (9003, None, None, None, None), (9004, "12 !! 34", "en", "s1", 8), (9005, "", None, "s1", 0)]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    made += [(9006, f"{long[9][1]} {items[2][1].upper()} {long[8][1]}", "en", "s4", 1)]
    rng.shuffle(made)
    d = str(tmp_path)
    spark.createDataFrame(made, table.schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = language_id.fit(docs.where(~language_id.held_out()))
    lang, score = language_id.classifier(net)([r[1] for r in made])
    left = [r for r, a, s in zip(made, lang, score, strict=True) if a != "und" and s >= 0.5]
    got = corpus_pipeline.known_language(spark, docs, d)
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} == {r[0] for r in left}
    assert not {9003, 9004, 9005} & {r[0] for r in left} and len(left) >= len(made) - 6
    edited = dict(test_line_dedup.brute(left, 10, spare=True))
    assert sum(footer in t for t in edited.values()) < 40
    left = [(r[0], edited[r[0]]) for r in left]
    firsts = {c for _, _, c in test_ngram_join.brute(left)}
    left = [r for r in left if r[0] in firsts]
    assert 9001 not in firsts and 9002 not in firsts
    bad = {r[0] for r in test_decontam.brute(left, items)}
    assert 9006 in bad
    left = [r for r in left if r[0] not in bad]

    pieces = corpus_pipeline.run(spark, d).collect()
    encode = packing.encoder(packing.default_vocabulary())
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert dict(tokens) == {k: len(encode([t])[0]) // 4 + 1 for k, t in left}
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontam", "packing"]


def test_stages_begin_with_what_earlier_ones_held_given_back(spark, docs):
    """Also before a stage without Python, and by a stage's own Python function that isn't run by map_columns."""

    def fill(n: list) -> dict:
        from kinlattice.llm import packing as there

        there.encoder(there.default_vocabulary())
        return {"held": [there.encoder.cache_info().currsize] * len(n)}

    def look(n: list) -> dict:
        from kinlattice.llm import packing as there

        return {"held": [there.encoder.cache_info().currsize] * len(n)}

    def held(work) -> set:
        rows = spark.range(4, numPartitions=1).select("id")
        return {r.held for r in common.map_columns(rows, [F.col("id")], common.keeping(work), "held long").collect()}

    some = docs([(1, "one two")]).coalesce(1)
    assert held(fill) == {1}
    language_id.accepted(some, None).collect()
    assert held(look) == {0}
    assert held(fill) == {1}
    gc = spark.range(1).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")))
    assert len(gc.collect()) == 1
    corpus_pipeline.own_lines(spark, some, "")
    assert held(look) == {0}
