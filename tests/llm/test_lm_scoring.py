import math
import random
import zlib

import numpy as np
import pytest

from kinlattice.llm import lm_scoring as lm
from kinlattice.llm.packing import default_vocabulary, encoder

SIZE = 400


def small_codes(seed=2):
    rng = np.random.default_rng(seed)
    return lm.Codes(rng.zipf(1.4, SIZE).clip(1, 5000).astype(np.int64))


def noisy(codes, seed=4):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.1, v.shape) for k, v in lm.fresh(codes).items()}


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)  # the room's arrays too
    codes = small_codes()
    p = noisy(codes)
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, SIZE, 60).astype(np.uint32), rng.integers(0, SIZE, 5).astype(np.uint32)]
    line, place = lm.laid_out(pieces, codes)
    ids = np.concatenate(pieces)
    g, _ = lm.gradients(p, codes, line, place, ids)
    assert g.keys() == p.keys()
    for k in p:
        x = p[k].reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            old, losses = x[i], []
            for d in (1e-5, -1e-5):
                x[i] = old + d
                losses.append(lm.gradients(p, codes, line, place, ids)[1])
            x[i] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[k].reshape(-1)[i], rel=1e-2, abs=1e-5), k


def naive_log_prob(p, codes, ids, i):
    """One token: its three digits, one after the other."""
    soft = lambda z: z - math.log(sum(math.exp(v) for v in z if v > -1e8))
    h = np.array(p["b"], float)
    for e, o in zip(p["E"], lm.OFFSETS, strict=True):
        h = h + e[codes.rows[ids[i + o]] if 0 <= i + o < len(ids) else lm.INPUTS]
    h = np.maximum(h, 0)
    t = ids[i]
    d1, g = int(codes.d1[t]), int(codes.group[t])
    out = soft(h @ p["V1"] + codes.base1)[d1]
    if codes.more[t]:
        out += soft(np.maximum(h @ p["W2"] + p["A2"][d1], 0) @ p["V2"] + codes.base2[d1])[codes.d2[t]]
        out += soft(np.maximum(h @ p["W3"] + p["A3"][g], 0) @ p["V3"] + codes.base3[g])[codes.d3[t]]
    return float(out)


def test_probabilities_of_all_ids_add_up_to_one():
    codes = small_codes()
    assert len({(a, b, c) for a, b, c in zip(codes.d1, codes.group, codes.d3, strict=True)}) == SIZE
    p = noisy(codes)
    ids = np.random.default_rng(3).integers(0, SIZE, 9)
    total = 0.0
    for t in range(SIZE):
        some = ids.copy()
        some[4] = t
        total += math.exp(naive_log_prob(p, codes, some, 4))
    assert total == pytest.approx(1, abs=1e-5)


def naive_train(pieces, codes, rounds):
    """The same training written token by token and weight by weight: all in one shard."""
    p = {k: v.astype(np.float64) for k, v in lm.fresh(codes).items()}
    rows = sorted((zlib.crc32(x.tobytes(), zlib.crc32(str(k).encode())), x) for k, x in pieces)
    for turn in range(rounds):
        m, v = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}
        chosen = [(x, i) for own, x in rows for i in range(len(x)) if (i + i // rounds + own) % rounds == turn]
        line, place = lm.laid_out([x for _, x in rows], codes)
        flat_at = [j for j, (own, i) in enumerate((own, i) for own, x in rows for i in range(len(x))) if (i + i // rounds + own) % rounds == turn]
        keep = np.random.default_rng(7).permutation(flat_at)
        ids = np.concatenate([x for _, x in rows])
        assert len(chosen) == len(keep)
        for step, at in enumerate(range(0, len(keep), lm.BATCH), 1):
            k = keep[at : at + lm.BATCH]
            g, _ = lm.gradients({n: x.astype(np.float32) for n, x in p.items()}, codes, line, place[k], ids[k])  # itself held against differences above
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
                rate = lm.RATE / (1 + turn) * min(1.0, len(k) / lm.BATCH * 2)
                p[name] = p[name] - rate / (1 - 0.9**step) * m[name] / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    return p


def table_of(spark, pieces):
    return spark.createDataFrame([(k, bytearray(x.astype("<u2").tobytes())) for k, x in pieces], "doc_id long, ids binary")


def test_training_against_the_plain_way(spark):
    rng = np.random.default_rng(5)
    pieces = [(k, rng.integers(0, SIZE, int(rng.integers(1, 400))).astype("<u2")) for k in range(40)]
    tokens = table_of(spark, pieces).cache()
    counts = lm.id_counts(tokens, SIZE)
    assert (counts - 1 == np.bincount(np.concatenate([x for _, x in pieces]), minlength=SIZE)).all()
    codes = lm.Codes(counts)
    total = int(counts.sum()) - SIZE
    got, want = lm.train(tokens, codes, total), naive_train(pieces, codes, lm.ROUNDS)
    for k in want:
        assert np.abs(got[k] - want[k]).max() < 2e-3, k
    scores = {r.doc_id: r.pll for r in lm.score(tokens, got, codes).collect()}
    for k, x in pieces[:6]:
        assert scores[k] == pytest.approx(sum(naive_log_prob(got, codes, x, i) for i in range(len(x))), rel=1e-4)


def test_weights_do_not_depend_on_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = lm.scored(table.repartition(2), shard=40_000).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = lm.scored(table.repartition(7).sortWithinPartitions("text"), shard=40_000).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (a.doc_id == b.doc_id).all() and (a.n_tokens == b.n_tokens).all()
    assert np.abs(a.pll - b.pll).max() < 0.01


def test_scores(spark, docs):
    vocabulary = default_vocabulary()
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    tokens = lm.tokenized(table, vocabulary).cache()
    size = lm.vocabulary_size(vocabulary)
    counts = lm.id_counts(tokens, size)
    codes = lm.Codes(counts)
    p = lm.train(tokens, codes, int(counts.sum()) - size)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").limit(30).collect()]
    got = {r.doc_id: r for r in lm.score(tokens, p, codes).collect()}
    n = sum(r.n_tokens for r in got.values())
    unigram = sum((c - 1) * math.log(c / counts.sum()) for c in counts if c > 1) / n
    assert sum(r.pll for r in got.values()) / n > unigram + 0.8  # both sides tell much
    edge = docs([(1, None), (2, ""), (3, "a"), (4, rows[0][1] * 40), (5, "a"), (None, "b c")]).withColumnRenamed("n_chars", "ids")
    e = {r.doc_id: r for r in lm.score(lm.tokenized(edge, vocabulary), p, codes).collect()}
    assert (e[1].n_tokens, e[1].pll, e[1].mean_pll) == (0, 0.0, None) == (e[2].n_tokens, e[2].pll, e[2].mean_pll)
    assert e[3].pll == e[5].pll < 0 and e[None].n_tokens == 2 and e[4].n_tokens > 39 * len(encoder(vocabulary)([rows[0][1]])[0]) // 4 - 100
    # shuffled words, and words put in the place of others of like frequency, are less likely than the text
    worse, within = 0, 0
    for i, t in rows:
        w = t.split(" ")
        random.Random(1).shuffle(w)
        r = lm.score(lm.tokenized(docs([(i, " ".join(w))]), vocabulary), p, codes).first()
        worse += r.mean_pll < got[i].mean_pll
        ids = np.frombuffer(encoder(vocabulary)([t])[0], "<u4").copy()
        for d in np.unique(codes.d1[ids]):
            at = np.flatnonzero(codes.d1[ids] == d)
            ids[at] = ids[np.random.default_rng(0).permutation(at)]
        within += lm.score(table_of(spark, [(i, ids)]), p, codes).first().mean_pll < got[i].mean_pll
    assert worse >= 27 and within >= 25


def test_empty(docs):
    assert lm.scored(docs([])).count() == 0 and lm.scored(docs([(1, None)])).count() == 1


def test_every_place_trains_once(spark):
    tokens = table_of(spark, [(k, np.arange(n)) for k, n in enumerate((1, 4, 8, 100, 1000))])
    rows = lm.segments(tokens, 3, SIZE, length=64).collect()
    seen = []
    for r in rows:
        x = np.frombuffer(r.ids, "<u2")
        inner = np.arange(r.lead, len(x) - r.trail)
        turn = lm.phases(r.at + inner - r.lead, r.o, lm.ROUNDS)
        assert set(turn.tolist()) <= set(range(lm.ROUNDS)) and (x[inner] == r.at + inner - r.lead).all()
        assert r.lead == min(lm.SIDE, r.at)
        seen += x[inner].tolist()
    assert sorted(seen) == sorted(i for n in (1, 4, 8, 100, 1000) for i in range(n))
    # texts of period 8: all fields are learned
    text = np.tile(np.arange(10, 18), 60)
    tokens = table_of(spark, [(i, text) for i in range(400)]).repartition(2).cache()
    counts = lm.id_counts(tokens, SIZE)
    codes = lm.Codes(counts)
    assert lm.score(tokens, lm.train(tokens, codes, 400 * len(text)), codes).first().mean_pll > math.log(0.5)


def test_frequent_classes_take_only_their_own_columns(monkeypatch):
    """Over the columns of the largest class, most of a batch's logits would be those of no value."""
    counts = (1e7 / np.arange(1, 20_001) ** 1.2).astype(np.int64) + 1
    codes = lm.Codes(counts)
    p = {k: v.astype(np.float32) for k, v in noisy(codes).items()}
    ids = np.random.default_rng(6).choice(len(counts), 3000, p=counts / counts.sum()).astype(np.uint16)
    ids[:3] = 19_999, 10_000, 3_000  # of the last classes
    made, softmax = [], lm._softmax
    monkeypatch.setattr(lm, "_softmax", lambda z, d: made.append(z.size) or softmax(z, d))
    line, place = lm.laid_out([ids], codes)
    got = lm.log_probs(p, codes, line, place, ids)
    deep = np.count_nonzero(codes.more[ids])
    assert sum(made) - lm.OUTPUTS * len(ids) < 1.2 * deep * codes.values  # of twice as many
    for i in (0, 1, 2, *range(3, 3000, 100)):
        assert got[i] == pytest.approx(naive_log_prob(p, codes, ids, i), abs=1e-3)
    made.clear()
    lm.gradients(p, codes, line, place, ids)
    assert sum(made) - lm.OUTPUTS * len(ids) < 1.2 * deep * codes.values
