"""Language ID: a byte convolutional network in numpy.

Every byte of the UTF-8 text has a learned vector of its own; filters of widths 2, 3 and 4 run over them, a maximum over each
fixed-length window of the text is taken, and a softmax. A text's scores are the mean log-probabilities of all its
windows, weighted by their bytes of letters.

Training takes a bounded sample of labelled rows, about sample_rows for each language and most_rows in
all, chosen by a hash of the key among all training rows, and at most windows_per_text windows of each,
spread evenly; every language with a row in the sample is learned. The language, the source and the key
never enter a prediction, which reads every byte of a text.

Defined cases: a text that is null or has no letter is 'und' with score 1; a row without label never
trains; with no labelled row at all every text is 'und' with score 0; ties go to the language first
in alphabetical order; repeated rows and equal texts get equal results; very long texts go through in
steps of a bounded number of windows; an empty table gives no row; other columns are not read (predict)
or pass through (accepted), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, small_batches, starting, table, trimmed

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
DIM = 12
UNKNOWN = "und"


PAD = 32  # a space
STEP = 16  # windows that go through the filters at a time


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """Bytes of a text in rows of one window; neighbours share as many bytes as a filter is wide, less one."""
    x = np.frombuffer(raw, np.uint8)
    step = size - max(WIDTHS) + 1
    n = max(1, -(-(len(x) - (max(WIDTHS) - 1)) // step))
    full = np.full((n - 1) * step + size, PAD, np.uint8)
    full[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(full, size)[::step]


class Network:
    """Weights: E[byte, dim], W[width][width, dim, filter], b[width], V[filters, labels], c."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.3, (256, DIM))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["V"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        self.p["c"] = np.zeros(len(labels))

    def tables(self, dtype=np.float32) -> dict[int, list[np.ndarray]]:
        """For each width and place in the filter, what each byte adds to each filter."""
        out = {w: [(self.p["E"] @ self.p[f"W{w}"][j]).astype(dtype) for j in range(w)] for w in WIDTHS}
        for w in WIDTHS:
            out[w][0] = out[w][0] + self.p[f"b{w}"].astype(dtype)
        return out

    def sums(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Every filter of one width at every place of each row of x: rows, places, filters. The result is overwritten by the next call."""
        n, span = len(x), x.shape[1] - len(tables) + 1
        held = self.__dict__.get("room")
        if held is None or held[0].dtype != tables[0].dtype or held[0].size < n * x.shape[1] * FILTERS:
            held = self.room = [np.empty(max(n, STEP) * x.shape[1] * FILTERS, tables[0].dtype) for _ in range(2)]
        total, more = (r[: n * span * FILTERS].reshape(n, span, FILTERS) for r in held)
        np.take(tables[0], x[:, :span], axis=0, out=total, mode="clip")
        for j, t in enumerate(tables[1:], 1):
            total += np.take(t, x[:, j : j + span], axis=0, out=more, mode="clip")
        return total

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Maxima over each row of x of every filter, after the ramp function."""
        return np.maximum(np.concatenate([self.sums(x, tables[w]).max(axis=1) for w in WIDTHS], axis=1), 0)

    def log_probs(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        pooled = np.concatenate([self.pooled(x[i : i + STEP], tables) for i in range(0, len(x), STEP)])
        z = pooled @ self.p["V"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 5) -> None:
        """Adam on the cross entropy; gradients go through the maximum to the place that gave it."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        step = 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), -(-len(x) // batch)):
                g = self.gradients(x[at], y[at])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k, p in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        tables, rows = self.tables(), np.arange(n)
        h, where = [], []
        for w in WIDTHS:
            sums = self.sums(x, tables[w])
            where.append(sums.argmax(axis=1))
            h.append(np.take_along_axis(sums, where[-1][:, None, :], axis=1)[:, 0].copy())
        h = np.concatenate(h, axis=1).astype(np.float64)
        on = h > 0
        h = h * on
        z = h @ self.p["V"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[rows, y] -= 1
        z /= n
        g = {k: np.zeros_like(p) for k, p in self.p.items()}
        g["V"], g["c"] = h.T @ z, z.sum(axis=0)
        back = (z @ self.p["V"].T) * on
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(axis=0)
            for j in range(w):
                s = np.take_along_axis(x, where[i] + j, axis=1)  # byte under the filter's j-th place
                hot = np.zeros((256, FILTERS))
                np.add.at(hot, (s, np.arange(FILTERS)[None, :].repeat(n, 0)), d)
                g[f"W{w}"][j] = self.p["E"].T @ hot
                g["E"] += hot @ self.p[f"W{w}"][j].T
        return g


def fit(docs: DataFrame, sample_rows: int = 600, most_rows: int = 60_000, windows_per_text: int = 4, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network | None:
    """Train on a bounded sample of the labelled rows of docs: about sample_rows for each label, and most_rows in all."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("y"), F.col(key).alias("k"), F.col(text).alias("t"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row for each language
    sample_rows = min(sample_rows, most_rows / max(1, len(counts)))
    if not counts:
        return None
    share = F.create_map(*[F.lit(z) for y, n in counts.items() for z in (y, min(1.0, sample_rows / n))])
    chosen = F.pmod(F.xxhash64("k", F.lit("train")), F.lit(1 << 20)) < F.try_element_at(share, F.col("y")) * (1 << 20)

    def sample(ys: list, ts: list) -> dict:
        y, x = [], []
        for label_, t in zip(ys, ts, strict=True):
            w = windows(t.encode("utf-8", "surrogatepass"))
            for i in np.unique(np.linspace(0, len(w) - 1, windows_per_text).round().astype(int)):
                y.append(label_)
                x.append(w[i].tobytes())
        return {"y": y, "x": x}

    got = map_columns(rows.where(chosen), [F.col("y"), F.col("t")], sample, "y string, x binary").orderBy("y", "x").collect()
    labels = sorted(counts)
    if not got:
        return None
    net = Network(labels)
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in got])
    y = np.array([labels.index(r["y"]) for r in got])
    # a window is seen whole and as two short pieces, so that short texts look familiar
    rng = np.random.default_rng(9)
    short = np.full((2 * len(x), WINDOW), PAD, np.uint8)
    for row, w, n, o in zip(short, np.concatenate([x, x]), np.exp(rng.uniform(np.log(8), np.log(WINDOW), len(short))).astype(int), rng.random(len(short)), strict=True):
        at = int(o * (WINDOW - n))
        row[:n] = w[at : at + n]
    net.train(np.concatenate([x, short]), np.concatenate([y, y, y]))
    return net


def classifier(net: Network | None):
    """A function from texts to languages and scores."""
    tables = net.tables() if net else None

    def run(texts: list) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [1.0] * len(texts)
        pending: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if not pending:
                return
            x = np.concatenate([w for _, w in pending])
            lp = net.log_probs(x, tables)
            letters = (((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 128)).sum(axis=1) + 1e-9
            at = np.cumsum([0, *(len(w) for _, w in pending)])[:-1]
            mean = np.add.reduceat(lp * letters[:, None], at) / np.add.reduceat(letters, at)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for (i, _), row in zip(pending, p, strict=True):
                lang[i], score[i] = net.labels[int(row.argmax())], float(row.max())
            pending.clear()

        held = 0
        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):
                continue
            if net is None:
                score[i] = 0.0
                continue
            w = windows(t.encode("utf-8", "surrogatepass"))
            pending.append((i, w))
            held += len(w)
            if held >= 2000:
                settle()
                held = 0
        settle()
        return lang, score

    return run


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score for every row of docs, from its whole text."""

    @starting
    def work():
        run = classifier(net)

        def named(keys: list, texts: list) -> dict:
            lang, score = run(texts)
            return {key: keys, "lang_pred": lang, "score": score}

        return named

    return map_columns(docs, [F.col(key).cast("long"), F.col(text)], work, f"`{key}` long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that have no letters, or a score under least; the same columns."""

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trimmed(forget=True)
        run = classifier(net)
        for texts in batches:
            lang, score = run([t if isinstance(t, str) else None for t in texts])
            yield pd.Series([a != UNKNOWN and s >= least for a, s in zip(lang, score, strict=True)])
        run = texts = None
        trimmed()

    small_batches(docs.sparkSession)
    return docs.where(known(F.col(text)))


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
