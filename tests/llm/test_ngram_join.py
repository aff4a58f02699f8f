import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from kinlattice.llm import common
from kinlattice.llm import ngram_join as nj


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    by_key = list(range(len(rows)))

    def root(i):
        while by_key[i] != i:
            i = by_key[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                by_key[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return sorted(((k, len(sets[i]), min(least[root(i)], default=None) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)] + ["É", "Straße", "THE"]
    rows, texts = [], []
    for i in range(140):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                j = rng.randrange(len(w) + 1)
                w[j : j + rng.randint(0, 2)] = [rng.choice(voc)] * rng.randint(0, 2)
        else:
            w = [rng.choice(voc) for _ in range(rng.choice([1, 4, 5, 7, 8, 9, 15, 40, 90, 200]))]
        texts.append(" ".join(w) or "x")
        rows.append((i + 5, texts[-1]))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, texts[3].upper()), (1, texts[8].replace(" ", "\n\x0b")), (904, "a\xa0b   c d e f g"), (905, " ".join(rng.choice(voc) for _ in range(30_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "heavy", "tile"), [(1, 128, 200_000), (2, 1, 300), (3, 2, 10**6)])
def test_against_brute_force(docs, seed, heavy, tile):
    rows = corpus(seed)
    df = docs(rows).withColumnRenamed("n_chars", "component_id").repartition(5)
    got = sorted((tuple(r) for r in nj.join(df, heavy=heavy, tile=tile).collect()), key=repr)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 15


def test_repeated_rows_and_stage(docs):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(4, long), (4, long), (3, long + " z"), (7, long), (8, "own text that is not like the others at all"), (9, None), (None, "no key but some words in here"), (10, "")]
    got = sorted(((r.doc_id, r.component_id) for r in nj.join(docs(rows)).collect()), key=repr)
    assert got == sorted([(4, 3), (4, 3), (3, 3), (7, 3), (8, 8), (9, 9), (None, None), (10, 10)], key=repr)
    assert sorted((r.doc_id for r in nj.one_of_each(docs(rows)).collect()), key=repr) == sorted([3, 8, 9, None, 10], key=repr)
    names = ["row", "r1", "r2", "key", "component", "component_id", "n_shingles"]
    clash = nj.one_of_each(docs(rows).withColumns({n: nj.F.lit(n) for n in names}))
    assert clash.columns[-len(names) :] == names and all(r[n] == n for r in clash.collect() for n in names) and clash.count() == 5
    assert nj.join(docs([])).count() == 0 and nj.one_of_each(docs([])).count() == 0


def near(i, edits, n=120):
    w = [f"t{i}w{j}" for j in range(n)]
    for e in edits:
        w[e] = "edit"
    return " ".join(w)


@pytest.mark.parametrize("slots", [8, 1 << 20])
def test_null_keys_link_and_bridge(docs, monkeypatch, slots):
    """Near copies without a key, a bridge without a key, and a group without any key; maps that are too small lose nothing."""
    monkeypatch.setattr(nj, "SLOTS", slots)
    rows = [(5, near(1, [])), (None, near(1, [50])), (None, near(2, [1])), (8, near(2, [1, 4, 7]))]
    rows += [(20, near(3, [10, 11])), (None, near(3, [10, 11, 90])), (21, near(3, [10, 11, 90, 60])), (None, near(4, [])), (None, near(4, [7])), (30, near(5, []))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(docs(rows)).collect()), key=repr)
    assert got == brute(rows) and (None, 116, 5) in got
    left = [(r.doc_id, r.text) for r in nj.one_of_each(docs(rows)).collect()]
    assert sorted((k for k, _ in left), key=repr) == sorted([5, 8, 20, None, 30], key=repr)
    assert nj.one_of_each(docs([(None, near(1, [])), (None, near(1, []))])).count() == 2  # one row twice is one document


def test_a_hub_with_many_members(docs, monkeypatch):
    monkeypatch.setattr(nj, "MEMBERS", 4)
    rows = [(i, near(1, [i])) for i in range(119)] + [(500 + i, near(9 + i % 3, [i])) for i in range(40)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(docs(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in [3, 4, 5, 6, 7, 10, 31, 100, 400]:
        for _ in range(30):
            union = rng.integers(0, 1 << 63, size * 4 // 3 + 1).astype(np.uint64)
            inter = int(rng.integers(0, size + 1))
            a, b = union[:size], np.concatenate([union[:inter], union[size : size + int(rng.integers(0, len(union) - size + 1))]])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if not len(b) or min(len(a), len(b)) < 3 or 4 * both < 3 * (len(a) + len(b) - both):
                continue
            band = max(nj.band_of(len(a)), nj.band_of(len(b)))
            assert abs(int(nj.band_of(len(a))) - int(nj.band_of(len(b)))) <= 1
            for shape in nj.LADDER:
                assert set(nj.signatures(a, int(band), shape).tolist()) & set(nj.signatures(b, int(band), shape).tolist())


@pytest.mark.parametrize("tile", [40, 10**6])
def test_tiles_find_all_links(spark, tile):
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = []
    for _ in range(50):
        keep = base[rng.random(len(base)) < 0.9]
        own = rng.integers(0, 1 << 63, int(rng.integers(0, 9))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([keep, own])))
    rows = [(i, len(s), 0, bytearray(s.astype("<u8").tobytes()), i // 2) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "cid long, n long, u long, set binary, label long")
    groups = spark.createDataFrame([(i, 0) for i in range(50)], "node long, label long")
    want = set()
    for i in range(50):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if i // 2 != j // 2 and 4 * inter >= 3 * (len(sets[i]) + len(sets[j]) - inter):
                want.add((j, i))
    assert {(r.a, r.b) for r in nj.tiled(df, groups, tile).collect()} == want and len(want) > 50


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    label = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in nj.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


def test_a_shared_template_makes_no_tiles(docs, monkeypatch):
    """Texts of one template that are else alike in pairs at most: only pairs with a rare shingle in common are compared."""

    def none(*_):
        raise AssertionError("dealt into blocks, whose number grows with the group")

    monkeypatch.setattr(nj, "tiled", none)
    template = " ".join(f"t{j}" for j in range(60))
    block = [" ".join(f"b{i}w{j}" for j in range(30)) for i in range(41)]
    rows = [(i, f"{template} {block[i]} {block[i + 1]}") for i in range(40)]
    rows += [(900, rows[7][1] + " end"), (901, rows[31][1].replace("b31w5", "other"))]
    got = sorted((tuple(r) for r in nj.join(docs(rows), heavy=8).collect()), key=repr)
    assert got == brute(rows) and len({r[2] for r in got}) == 40


def test_linked_sets_share_a_rare_shingle():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 3, nj.PLACES).astype(np.uint8)
    sign = nj.by_rarity(nj.zlib.compress(levels.tobytes()))
    for size in [1, 2, 3, 4, 5, 8, 33, 150]:
        for _ in range(40):
            union = rng.integers(0, 1 << 63, size * 4 // 3 + 1).astype(np.uint64)
            a, b = np.unique(union[:size]), np.unique(union[int(rng.integers(0, size)) :])
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both):
                assert set(sign(a).tolist()) & set(sign(b).tolist())


def test_dead_tables_go(docs, tmp_path, monkeypatch):
    """Scanned shingles and the first copy of the sets don't stay on the disk until the end."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = [(i, near(i // 2, [i])) for i in range(20)]
    assert nj.join(docs(rows)).count() == 20
    left = [p.name for p in tmp_path.glob("*/*")]
    assert "scan" not in left and left.count("sets") == 1 and "survivors" in left


def test_counting_unshared_values_holds_little():
    rng = np.random.default_rng(1)

    def row(ids, sizes, values) -> tuple:
        return np.array(ids, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), np.array(values).astype("<u4").tobytes()

    for _ in range(50):
        rows, owners = [], defaultdict(set)
        for _ in range(int(rng.integers(1, 5))):
            ids = rng.choice(np.arange(-3, 3), int(rng.integers(1, 5)), replace=False)
            sizes = rng.integers(0, 6, len(ids))
            values = rng.integers(0, 30, int(sizes.sum())) * 143165576  # up to the last bit
            rows.append(row(ids, sizes, values))
            for i, v in zip(np.repeat(ids, sizes).tolist(), values.tolist(), strict=True):
                owners[v].add(i)
        want = defaultdict(int)
        for o in owners.values():
            want[min(o)] += len(o) == 1
        of, u = nj.alone(rows)
        assert dict(zip(of.tolist(), u.tolist(), strict=True)) == {i: n for i, n in want.items() if n}
    rows = [row(np.arange(i * 4000, i * 4000 + 4000), np.full(4000, 8), rng.integers(0, 1 << 32, 32_000)) for i in range(30)]
    tracemalloc.start()
    nj.alone(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * 32_000 * 32  # bytes a value; 64 before
