import random
import re
from collections import Counter

from kinlattice.llm import decontam as dc

ITEM = "item_id long, text string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items):
    out = set()
    for i, t in rows:
        w = words(t)
        for item, text in items:
            v = words(text)
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            b, size = grams(v, k), min(len(v), len(w))
            best = None
            n = 0
            for s in range(len(w) - size + 1):
                a = grams(w[s : s + size], k)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.75:
                    n += 1
                    if best is None or sim > best[0]:
                        best = (sim, s)
            if best:
                out.add((i, item, round(best[0], 6), best[1], size, n))
    return out


def test_against_brute_force(spark, docs):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(60)] + ["été", "Groß"]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randint(12, 45))) for i in range(12)] + [(50, "One two"), (51, None), (52, "?!"), (53, "same words here again and again"), (54, "same words here again and again")]
    rows = []
    for i in range(90):
        t = say(rng.randint(0, 60))
        if i % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 1)] = [rng.choice(voc)] * rng.randint(0, 1)
            t += ". " + ", ".join(w).upper() + "\n" + say(rng.randint(0, 30))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "x ONE, two! y one two"), (204, "same words here again and again; " * 3), (0, rows[0][1]), (205, items[3][1] + " " + "z " * 2_000), (None, items[4][1])]
    bench = spark.createDataFrame(items, ITEM)
    got = dc.matches(docs(rows).withColumnRenamed("n_chars", "pos"), bench).collect()
    want = brute(sorted(set(rows), key=repr), items)
    assert {(r.doc_id, r.item_id, round(r.similarity, 6), r.start_word, r.window_words, r.n_windows) for r in got} == want and len(got) == len(want) > 15
    bad = {r[0] for r in want}
    names = ["row", "r1", "r2", "_r1", "_r2", "hs", "key"]
    left = dc.clean(docs(rows).withColumns({n: dc.F.lit(n) for n in names}), bench)
    assert all(r[n] == n for r in left.collect() for n in names)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)
    assert left.columns == [*docs(rows).columns, *names]
    assert dc.matches(docs([]), bench).count() == 0 and dc.clean(docs(rows), bench.limit(0)).count() == len(rows)


def test_fingerprints_and_blocks(spark):
    rng = random.Random(2)
    arrays = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    df = spark.createDataFrame([(a,) for a in arrays], "hs array<bigint>")
    for a, r in zip(arrays, df.select(dc.simhash("hs").alias("f")).collect(), strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in a) > len(a))
        assert r.f & (1 << 64) - 1 == want
    for span in (1, 3, 17):
        df = spark.createDataFrame([(a,) for a in arrays if len(a) >= span], "hs array<bigint>")
        for r in df.select("hs", dc.rolling("hs", str(span)).alias("f")).collect():
            want = [sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r.hs[i : i + span]) > span) for i in range(len(r.hs) - span + 1)]
            assert [f & (1 << 64) - 1 for f in r.f] == want
    masks = [m & (1 << 64) - 1 for m in dc.block_masks()]
    assert sum(masks) == (1 << 64) - 1 and len(masks) == dc.RADIUS + 1
    for _ in range(200):  # any RADIUS changed bits leave a block as it is
        x = sum(1 << b for b in rng.sample(range(64), dc.RADIUS))
        assert any(not x & m for m in masks)


def test_repeated_shingles_beyond_the_radius(spark, docs):
    items, rows = [], []
    for i in range(8):
        own = [f"a{i}x{j}" for j in range(104)]
        items.append((i, " ".join(own + ["0"] * 14)))
        rows += [(i, " ".join(own + ["9"] * 14)), (10 + i, "before " + " ".join(own + ["0"] * 14) + " after"), (20 + i, " ".join(own[:60] + ["9"] * 58))]
    rows += [(30, "0 " * 300), (31, items[0][1] + " " + "0 " * 200)]
    bench = spark.createDataFrame(items, ITEM)
    got = dc.matches(docs(rows), bench).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id, round(r.similarity, 6), r.start_word, r.window_words, r.n_windows) for r in got} == want and len(got) == len(want)
    assert {(i, i) for i in range(8)} <= {r[:2] for r in want}


def test_very_long_items_and_texts(spark, docs):
    """33 000 equal words and 70 000 different ones: no lane overflows, and nothing is quadratic."""
    long = " ".join(f"u{i}" for i in range(70_000))
    items = [(1, "la " * 33_000), (2, long), (3, "short item of just some words here")]
    rows = [(1, "la " * 40_000), (2, "x " + long + " y"), (3, "la " * 20_000), (4, "nothing like any of these at all"), (5, "la " * 33_000)]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start_word, r.window_words, r.n_windows) for r in dc.matches(docs(rows), spark.createDataFrame(items, ITEM)).collect()}
    assert got[1, 1] == (1.0, 0, 33_000, 7_001) and got[5, 1] == (1.0, 0, 33_000, 1)
    assert got[2, 2][:3] == (1.0, 1, 70_000) and got[2, 2][3] == 3 and set(got) == {(1, 1), (5, 1), (2, 2)}


def test_pairs_that_are_compared_follow_the_seeds(spark, docs):
    """Items that share nothing with a window aren't met, however many there are."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(300)]
    rows = [(i, "before " + items[i][1] + " after") for i in range(50)]
    df, bench = docs(rows), spark.createDataFrame(items, ITEM)
    held = df.select(dc.F.col("doc_id").alias("r1"), dc.F.lit(0).alias("r2"), dc.F.col("text").alias("t"))
    assert dc.seeds(held, dc.items_of(bench), 5, lambda x: x).select("r1", "item_id").distinct().count() == 50
    assert dc.matches(df, bench).count() == 50
