import numpy as np
import pytest

from kinlattice.llm import language_id as lid

DATA = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = lid.Network(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    wide = net.tables
    net.tables = lambda dtype=np.float64: wide(np.float64)
    g = net.gradients(x, y)

    def loss():
        return -net.log_probs(x, net.tables(np.float64))[np.arange(5), y].mean()

    for name in net.p:
        flat = net.p[name].reshape(-1)
        i = int(np.abs(g[name]).argmax())
        old = flat[i]
        flat[i] = old + 1e-5
        up = loss()
        flat[i] = old - 1e-5
        down = loss()
        flat[i] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name].reshape(-1)[i], rel=1e-2, abs=1e-5), name


def test_windows_cover_every_place():
    for n in [0, 1, 3, 255, 256, 257, 509, 510, 5000]:
        raw = bytes(np.random.default_rng(n).integers(97, 122, n).astype(np.uint8))
        w = lid.windows(raw)
        seen = {bytes(r[i : i + 4]) for r in w for i in range(lid.WINDOW - 3)}
        x = np.frombuffer(raw, np.uint8)
        assert all(bytes(x[i : i + 4]) in seen for i in range(n - 3))


def test_held_out_accuracy_and_edge_cases(spark, docs):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    net = lid.fit(table.where(~lid.held_out()))
    got = lid.predict(table, net).join(table, "doc_id").where(lid.held_out() & (lid.F.length("text") > 0)).select("lang", "lang_pred", "score").collect()
    assert len(got) > 250 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the thing and that other one"), (5, "the thing and that other one"), (None, "der und die das"), (7, "Éoution la éleele qui de une queéch est ouaux dans les mentier pour étreai. " * 6_000)]
    got = {r.doc_id: r for r in lid.predict(docs(rows).withColumnRenamed("n_chars", "score"), net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred == got[5].lang_pred == "en" and got[4].score == got[5].score
    assert got[None].lang_pred == "de" and got[7].lang_pred == "fr"


def test_no_labels(spark, docs):
    assert lid.fit(docs([])) is None
    df = docs([(1, "abc", None, None, None)])
    assert lid.fit(df) is None
    r = lid.predict(df, None).collect()[0]
    assert (r.lang_pred, r.score) == ("und", 0.0)


def naive(net, text):
    """One window, one place, one filter at a time."""
    raw = text.encode()
    step, total, weight = lid.WINDOW - max(lid.WIDTHS) + 1, 0.0, 0.0
    for at in range(0, max(1, len(raw) - max(lid.WIDTHS) + 1), step):
        w = raw[at : at + lid.WINDOW].ljust(lid.WINDOW, b" ")
        pooled = []
        for k in lid.WIDTHS:
            for f in range(lid.FILTERS):
                pooled.append(max(0.0, max(sum(net.p["E"][w[i + j]] @ net.p[f"W{k}"][j][:, f] for j in range(k)) + net.p[f"b{k}"][f] for i in range(lid.WINDOW - k + 1))))
        z = np.array(pooled) @ net.p["V"] + net.p["c"]
        z = z - z.max()
        letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in w) + 1e-9
        total, weight = total + letters * (z - np.log(np.exp(z).sum())), weight + letters
    p = np.exp(total / weight - (total / weight).max())
    return net.labels[int(p.argmax())], float(p.max() / p.sum())


def test_against_a_plain_convolution():
    net = lid.Network(["a", "b", "c"])
    rng = np.random.default_rng(4)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.2, net.p[k].shape)
    texts = ["Hello, world", "x" * 256, "größe μέγεθος размер 大きさ " * 12, "a1 " * 100]
    lang, score = lid.classifier(net)(texts)
    for t, a, s in zip(texts, lang, score, strict=True):
        want = naive(net, t)
        assert a == want[0] and s == pytest.approx(want[1], abs=1e-4)


def test_many_labels_and_scripts(spark, docs):
    """More languages than any limit of old, and scripts whose bytes all are beyond ASCII."""
    alphabets = {"el": "αβγδεζηθικλμνξοπ", "ru": "абвгдежзийклмноп", "he": "אבגדהוזחטיכלמנסע", "ja": "あいうえおかきくけこさしすせそた"}
    rng = np.random.default_rng(1)
    say = lambda a: " ".join("".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(40))
    rows = [(i, say(a), y, "s", 1) for y, a in alphabets.items() for i in range(60)]
    net = lid.fit(docs(rows))
    lang, _ = lid.classifier(net)([say(a) for a in alphabets.values() for _ in range(5)])
    assert lang == [y for y in alphabets for _ in range(5)]
    many = lid.fit(docs([(i, f"text {i}", f"l{i:04}", "s", 1) for i in range(700)]), most_rows=70_000)
    assert len(many.labels) == 700


def test_accepted_keeps_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = [(1, "der und die das nicht", "de", "s", 1), (2, "the and that with from", "en", "s", 1), (3, None), (4, "12"), (5, "")]
    df = docs(rows).withColumnRenamed("n_chars", "_guess").withColumns({"lang_pred": F.lit(1), "score": F.lit("x")})
    net = lid.fit(df)
    got = lid.accepted(df, net, least=0.0)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert {r.score for r in got.collect()} == {"x"} and lid.accepted(docs([]), net).count() == 0
