"""LM scoring: masked pseudo-likelihood under a bidirectional window network trained in numpy.

Every token of a document is predicted from the SIDE tokens before and the SIDE tokens after it; the
document's score is the sum of these conditional log-probabilities. Tokens are ids of a public
tokenizer, and the network gives the probability of the id itself, in three digits of its code:

    P(id | both sides) = P(d1 | sides) * P(d2 | sides, d1) * P(d3 | sides, d1, d2)

Each factor is a softmax over all values of the digit, so that the ids' probabilities add up to one. Codes go by falling
frequency: d1 is one of OUTPUTS classes of equal shares of the square roots of the counts, the most
frequent ids alone in theirs; d2 and d3 cut a class in groups of about the root of its size. A factor's
logits are the logarithm of the digit's share in the whole corpus, given the digits before it, plus what
the network adds: learned vectors of the 2 * SIDE neighbours (one of INPUTS rows for each, the most
frequent ids with a row of their own) are added up and go through a ramp; for d2 and d3 a second ramp
layer mixes them with a learned vector of the digits before.

A class has far fewer digits than the largest one: d2 and d3 are computed over a tier of classes of like
width, and only over the columns that these have. The others have no value, so nothing is left out.

Training sees every token once. Documents are cut into segments and dealt by a hash over shards of
about SHARD tokens; in each of ROUNDS rounds every shard trains from the common weights on its share of
the places, and the weights are averaged by the places seen. Shards, their order and the sums (of
whole numbers) don't depend on how rows lie in partitions, so the weights don't either. Id counts and shards'
weights, which are gathered, grow with the input; the driver gets one count for each id and one
number for each weight.

Defined cases: a null or empty text has no token, score 0 and a null mean; the ends of a text are seen
as a sign of their own; ids that training never met count as met once; ties in frequency go by id;
repeated rows get equal scores; very long texts train in segments and are scored whole; a null key is
scored like any; other columns are not read, whatever their names; an empty table gives no row. Scores
are rounded to three digits, as sums of single-precision terms.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeping, map_columns, staged, table
from .packing import default_vocabulary, encoder

SIDE = 2
INPUTS = 768
OUTPUTS = 48
DIM = 16
HIDDEN = 16
ROUNDS = 2
SHARD = 4_000_000
SEGMENT = 8192
BATCH = 4096
SCORED = 16384  # places that are scored at a time: each step has a fixed cost
RATE = 0.02
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
NARROW = 16  # columns of the first tier of classes; each further one has up to four times as many
GRID = 1 << 20  # weights are summed as whole multiples of 1 / GRID
Weights = dict[str, np.ndarray]


def vocabulary_size(vocabulary: str) -> int:
    return encoder(vocabulary).tokenizer.get_vocab_size()


def kind(size: int) -> str:
    """The smallest unsigned little-endian type that holds ids under size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the ids of each text, as numbers of the vocabulary's kind."""
    narrow = kind(vocabulary_size(vocabulary))

    @keeping
    def ids(keys: list, texts: list) -> dict:
        return {key: keys, "ids": [np.frombuffer(x, "<u4").astype(narrow).tobytes() for x in encoder(vocabulary)(texts)]}

    return map_columns(docs, [F.col(key).cast("long"), F.col(text)], ids, f"`{key}` long, ids binary")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each of size ids stands in the whole corpus, plus one."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind(size)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id
    out = np.ones(size, np.int64)
    for r in got:
        out[r["id"]] += r["n"]
    return out


def classes(counts: np.ndarray, number: int) -> np.ndarray:
    """Class of each id: by falling frequency, equal shares of the square roots, single ids first."""
    order = np.argsort(-counts, kind="stable")
    own = number // 2
    weight = np.sqrt(counts[order].astype(np.float64))
    rest = np.cumsum(weight[own:])
    out = np.empty(len(counts), np.int16)
    out[order[:own]] = np.arange(min(own, len(counts)))
    if len(rest):
        out[order[own:]] = own + np.minimum((rest - weight[own:]) / rest[-1] * (number - own), number - own - 1).astype(np.int16)
    return out


class Codes:
    """Three digits for each id, and the logarithms of their shares of the counts.

    d1: class; group: number of (d1, d2) in a row over all classes; d2: group within the class; d3: place
    within the group. base1, base2[d1], base3[group]: log shares, -1e9 where there is no such value.
    """

    def __init__(self, counts: np.ndarray):
        self.kind = kind(len(counts))
        order = np.argsort(-counts, kind="stable")
        d1 = classes(counts, OUTPUTS)[order].astype(np.int64)
        sizes = np.bincount(d1, minlength=OUTPUTS)
        place = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[d1]
        wide = np.ceil(np.sqrt(np.maximum(sizes, 1))).astype(np.int64)
        groups = -(-np.maximum(sizes, 1) // wide)
        self.values = int(max(wide.max(), groups.max()))
        d2, d3 = place // wide[d1], place % wide[d1]
        group = (np.cumsum(groups) - groups)[d1] + d2
        self.groups = int(groups.sum())
        n = counts[order].astype(np.float64)

        def shares(of: np.ndarray, value: np.ndarray, rows: int, columns: int) -> np.ndarray:
            total = np.zeros((rows, columns))
            np.add.at(total, (of, value), n)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.log(total / total.sum(axis=1, keepdims=True))
            return np.where(total > 0, out, -1e9).astype(np.float32)

        self.base1 = shares(np.zeros_like(d1), d1, 1, OUTPUTS)[0]
        self.base2 = shares(d1, d2, OUTPUTS, self.values)
        self.base3 = shares(group, d3, self.groups, self.values)
        digits = np.empty((len(order), 4), np.uint16)
        digits[order] = np.stack([d1, group, d2, d3], 1)
        self.d1, self.group, self.d2, self.d3 = np.ascontiguousarray(digits.T)
        self.more = (sizes > 1)[self.d1]  # whether the first digit doesn't say all
        # classes of like width in a row: from one class to the next tier's, and the columns that their digits have
        width = np.maximum.accumulate(np.maximum(wide, groups))
        tier = np.ceil(np.log2(np.maximum(width, NARROW) / NARROW) / 2).astype(np.int64)
        first = np.flatnonzero(np.diff(tier, prepend=-1))
        start = np.cumsum(groups) - groups
        self.tiers = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), OUTPUTS], strict=True):
            w, g = int(width[b - 1]), slice(int(start[a]), int(start[b - 1] + groups[b - 1]))
            self.tiers.append((a, b, w, {2: (a, np.ascontiguousarray(self.base2[a:b, :w])), 3: (g.start, np.ascontiguousarray(self.base3[g, :w]))}))
        self.rows = classes(counts, INPUTS).astype(np.uint16)

    def shapes(self) -> dict[str, tuple]:
        return {
            "E": (2 * SIDE, INPUTS + 1, DIM),
            "b": (DIM,),
            "V1": (DIM, OUTPUTS),
            "W2": (DIM, HIDDEN),
            "A2": (OUTPUTS, HIDDEN),
            "V2": (HIDDEN, self.values),
            "W3": (DIM, HIDDEN),
            "A3": (self.groups, HIDDEN),
            "V3": (HIDDEN, self.values),
        }


def fresh(codes: Codes, seed: int = 3) -> Weights:
    """Vectors at random; the last layers are zero, so that training starts from the corpus's shares."""
    rng = np.random.default_rng(seed)
    scale = {"E": 0.2, "W2": 0.2, "A2": 0.3, "W3": 0.2, "A3": 0.3}
    return {k: (rng.normal(0, 1, s) * scale.get(k, 0.0) + (0.1 if k == "b" else 0)).astype(np.float32) for k, s in codes.shapes().items()}


def flat(p: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unflat(x: np.ndarray, codes: Codes) -> Weights:
    out, at = {}, 0
    for k, s in codes.shapes().items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def laid_out(pieces: list[np.ndarray], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Input rows of several documents in one line, SIDE end marks around each; and each token's place in it."""
    n = np.array([len(x) for x in pieces], np.int64)
    ids = np.concatenate(pieces) if len(pieces) else np.empty(0, np.uint32)
    place = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(n)), n))
    line = np.full(len(ids) + SIDE * (len(n) + 1), INPUTS, np.uint16)
    line[place] = codes.rows[ids]
    return line, place


class Room:
    """Arrays for one batch, made once and used again: fresh memory for each costs more than the arithmetic."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        a = self.held.get(name)
        if a is None or len(a) < rows or a.shape[1] != columns:
            a = self.held[name] = np.empty((max(rows, BATCH), columns), np.float32)
        return a[:rows]


def hidden(p: Weights, line: np.ndarray, place: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Rows of E for the neighbours of each place (a line for each side), and the first layer."""
    near = np.stack([line[place + o] for o in OFFSETS])
    n = len(place)
    h, t = room("h", n, DIM), room("t", n, DIM)
    np.take(p["E"][0], near[0], axis=0, out=h, mode="clip")
    for e, x in zip(p["E"][1:], near[1:], strict=True):
        h += np.take(e, x, axis=0, out=t, mode="clip")
    h += p["b"]
    np.maximum(h, 0, out=h)
    return near, h


def _softmax(z: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """The log-probability of each row's digit; z becomes the probabilities."""
    if len(z) and z.max() > 60:  # logits are log shares and what the network adds, which seldom needs this
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), digit]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z *= (1 / total)[:, None]
    return own - np.log(total)


def _first(p: Weights, codes: Codes, h: np.ndarray, room: Room) -> np.ndarray:
    z = np.dot(h, p["V1"], out=room("z1", len(h), OUTPUTS))
    z += codes.base1
    return z


def _spans(codes: Codes, d1: np.ndarray) -> list[tuple[slice, int, dict]]:
    """Rows, columns and log shares of each tier, for rows in the order of their first digits."""
    ends = np.searchsorted(d1, [b for _, b, _, _ in codes.tiers]).tolist()
    return [(slice(i, j), w, base) for i, j, (_, _, w, base) in zip([0, *ends], ends, codes.tiers, strict=False) if j > i]


def _mixed(p: Weights, h: np.ndarray, level: int, before: np.ndarray, room: Room) -> np.ndarray:
    """The second ramp layer of a level."""
    m = np.dot(h, p[f"W{level}"], out=room("m", len(h), HIDDEN))
    m += np.take(p[f"A{level}"], before, axis=0, out=room("a", len(h), HIDDEN), mode="clip")
    return np.maximum(m, 0, out=m)


def _narrow(p: Weights, m: np.ndarray, level: int, before: np.ndarray, span: tuple, room: Room) -> np.ndarray:
    """Logits of a tier's rows: only its columns, as the log share of all others is that of no value."""
    at, w, base = span
    first, shares = base[level]
    z = np.dot(m[at], p[f"V{level}"][:, :w], out=room(f"z{w}", at.stop - at.start, w))
    z += np.take(shares, before[at] - first, axis=0, out=room(f"base{w}", at.stop - at.start, w), mode="clip")
    return z


def _deep_rows(codes: Codes, ids: np.ndarray) -> np.ndarray:
    """Rows whose first digit doesn't say all, in the order of their groups and so of their classes."""
    on = np.flatnonzero(codes.more[ids])
    return on[np.argsort(codes.group[ids[on]], kind="stable")]


def log_probs(p: Weights, codes: Codes, line: np.ndarray, place: np.ndarray, ids: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Log-probability of the id at each place, given its neighbours."""
    room = room or Room()
    _, h = hidden(p, line, place, room)
    out = _softmax(_first(p, codes, h, room), codes.d1[ids])
    on = _deep_rows(codes, ids)
    if len(on):
        h, ids = np.take(h, on, axis=0, out=room("some", len(on), DIM), mode="clip"), ids[on]
        more, spans = np.zeros(len(on), h.dtype), _spans(codes, codes.d1[ids])
        for level, before, digit in ((2, codes.d1[ids], codes.d2[ids]), (3, codes.group[ids], codes.d3[ids])):
            m = _mixed(p, h, level, before, room)
            for span in spans:
                more[span[0]] += _softmax(_narrow(p, m, level, before, span, room), digit[span[0]])
        out[on] += more
    return out


def _summed(of: np.ndarray, rows: np.ndarray, shape: tuple, room: Room | None = None) -> np.ndarray:
    """Rows added up by the row (of 16 bits) that they belong to; without room they come in this order."""
    out = np.zeros(shape, np.float32)
    if len(of):
        if room:
            order = np.argsort(of, kind="stable")
            of, rows = of[order], np.take(rows, order, axis=0, out=room("sorted", len(rows), rows.shape[1]), mode="clip")
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def gradients(p: Weights, codes: Codes, line: np.ndarray, place: np.ndarray, ids: np.ndarray, room: Room | None = None) -> tuple[Weights, float]:
    """Of the mean negative log-probability, and that itself."""
    room = room or Room()
    n = len(place)
    near, h = hidden(p, line, place, room)
    z = _first(p, codes, h, room)
    d1 = codes.d1[ids]
    loss = -float(_softmax(z, d1).sum())
    z[np.arange(n), d1] -= 1
    z *= np.float32(1 / n)
    g = {"V1": h.T @ z}
    back = np.dot(z, p["V1"].T, out=room("back", n, DIM))
    on = _deep_rows(codes, ids)
    some, h2 = ids[on], np.take(h, on, axis=0, out=room("some", len(on), DIM), mode="clip")
    spans, deep = _spans(codes, codes.d1[some]), np.zeros_like(h2)
    for level, before, digit in ((2, codes.d1[some], codes.d2[some]), (3, codes.group[some], codes.d3[some])):
        m, v = _mixed(p, h2, level, before, room), p[f"V{level}"]
        d, g[f"V{level}"] = room("d", len(some), HIDDEN), np.zeros_like(v)
        for span in spans:
            at, w, _ = span
            z = _narrow(p, m, level, before, span, room)
            loss -= float(_softmax(z, digit[at]).sum())
            z[np.arange(len(z)), digit[at]] -= 1
            z *= np.float32(1 / n)
            g[f"V{level}"][:, :w] += m[at].T @ z
            np.dot(z, v[:, :w].T, out=d[at])
        d *= m > 0
        g[f"W{level}"] = h2.T @ d
        g[f"A{level}"] = _summed(before, d, p[f"A{level}"].shape)
        deep += np.dot(d, p[f"W{level}"].T, out=room("t", len(some), DIM))
    back[on] += deep
    back *= h > 0
    g["b"] = back.sum(axis=0)
    g["E"] = np.stack([_summed(x, back, p["E"].shape[1:], room) for x in near])
    return {k: g[k] for k in p}, loss / n


class Adam:
    """Steps over all weights in one line, of which p's arrays become parts."""

    def __init__(self, p: Weights):
        self.line = flat(p)
        self.m, self.v = np.zeros_like(self.line), np.zeros_like(self.line)
        self.t = 0
        at = 0
        for k, x in p.items():
            p[k] = self.line[at : at + x.size].reshape(x.shape)
            at += x.size

    def step(self, g: Weights, rate: float) -> None:
        """g: in the order of p."""
        self.t += 1
        a, b = np.float32(rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.99**self.t))
        m, v, d = self.m, self.v, flat(g)
        m *= np.float32(0.9)
        m += np.float32(0.1) * d
        v *= np.float32(0.99)
        d *= d
        d *= np.float32(0.01)
        v += d
        np.multiply(v, b, out=d)
        np.sqrt(d, out=d)
        d += np.float32(1e-6)
        np.divide(m, d, out=d)
        d *= a
        self.line -= d


def segments(tokens: DataFrame, shards: int, size: int, key: str = "doc_id", length: int = SEGMENT) -> DataFrame:
    """shard, place in its order (o, at), and ids of a segment with the SIDE neighbours that it has: lead before, trail after."""
    names = ("shard", "o", "at", "lead", "trail", "ids")
    wide = np.dtype(kind(size)).itemsize

    def cut(keys: list, stored: list):
        rows, held = [], 0
        for k, raw in zip(keys, stored, strict=True):
            n = len(raw) // wide
            own = zlib.crc32(raw, zlib.crc32(str(k).encode()))
            for s in range(0, n, length):
                e = min(n, s + length)
                lead, trail = min(SIDE, s), min(SIDE, n - e)
                at = zlib.crc32(s.to_bytes(8, "little"), own)
                rows.append((at % shards, own, s, lead, trail, raw[wide * (s - lead) : wide * (e + trail)]))
                held += e - s
                if held > 1 << 20:
                    yield {c: [r[i] for r in rows] for i, c in enumerate(names)}
                    rows, held = [], 0
        yield {c: [r[i] for r in rows] for i, c in enumerate(names)}

    return map_columns(tokens, [F.col(key), F.col("ids")], cut, "shard int, o long, at long, lead int, trail int, ids binary")


def phases(places: np.ndarray, own: int, rounds: int) -> np.ndarray:
    """Which of the rounds trains on each place; it moves on by one from block to block, so that regular text has no field left out."""
    return (places + places // rounds + own) % rounds


def train_shard(p: Weights, codes: Codes, rows: list[tuple], turn: int, rounds: int, rate: float, batch: int = BATCH) -> int:
    """Train p on a shard's segments (o, at, lead, trail, ids); the number of places seen."""
    rows = sorted(rows)
    adam, room, rng, seen = Adam(p), Room(), np.random.default_rng(7), 0
    at = 0
    while at < len(rows):
        chosen, size = [], 0
        while at < len(rows) and size < 1 << 18:
            chosen.append(rows[at])
            size += len(rows[at][4]) // 2
            at += 1
        pieces = [np.frombuffer(r[4], codes.kind) for r in chosen]
        line, place = laid_out(pieces, codes)
        ids = np.concatenate(pieces)
        keep = np.zeros(len(ids), bool)
        start = 0
        for (own, first, lead, trail, _), x in zip(chosen, pieces, strict=True):
            inner = np.arange(lead, len(x) - trail)
            keep[start + inner] = phases(first + inner - lead, own, rounds) == turn
            start += len(x)
        keep = rng.permutation(np.flatnonzero(keep))
        for i in range(0, len(keep), batch):
            k = keep[i : i + batch]
            g, _ = gradients(p, codes, line, place[k], ids[k], room)
            adam.step(g, rate * min(1.0, len(k) / batch * 2))
        seen += len(keep)
    return seen


def train(tokens: DataFrame, codes: Codes, total: int, rounds: int = ROUNDS, shard: int = SHARD, rate: float = RATE, key: str = "doc_id") -> Weights:
    """Weights after rounds of training in all shards and averaging."""
    p = fresh(codes)
    shards = max(1, -(-total // shard))
    dealt = segments(tokens, shards, len(codes.d1), key)

    def trained(start: np.ndarray, turn: int):
        def work(t: pa.Table) -> pa.Table:
            p = unflat(start, codes)
            rows = list(zip(*(t.column(c).to_pylist() for c in ("o", "at", "lead", "trail", "ids")), strict=True))
            seen = train_shard(p, codes, rows, turn, rounds, rate / (1 + turn))
            w = np.rint(flat(p).astype(np.float64) * GRID).astype(np.int64)
            share = -(-seen // 1024)
            return pa.table({"k": np.arange(len(w), dtype=np.int64), "w": w * share, "n": np.full(len(w), share, np.int64)})

        return work

    for turn in range(rounds):
        start = flat(p)
        moved = dealt.groupBy("shard").applyInArrow(trained(start, turn), "k long, w long, n long")
        got = moved.groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toArrow()  # one row for each weight
        if not got.num_rows:
            break
        mean = start.astype(np.float64)
        k, w, n = (got.column(c).to_numpy() for c in ("k", "w", "n"))
        mean[k] = np.where(n > 0, w / np.maximum(n, 1) / GRID, mean[k])
        p = unflat(mean, codes)
    return p


def score(tokens: DataFrame, p: Weights, codes: Codes, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, pll (sum of log-probabilities) and mean_pll."""

    def work():
        room = Room()

        def run(keys: list, stored: list) -> dict:
            wide = np.dtype(codes.kind).itemsize
            n, total = [len(x) // wide for x in stored], [0.0] * len(stored)
            pending: list[int] = []

            def settle() -> None:
                if not pending:
                    return
                pieces = [np.frombuffer(stored[i], codes.kind) for i in pending]
                line, place = laid_out(pieces, codes)
                ids = np.concatenate(pieces)
                lp = np.empty(len(ids), np.float64)
                for s in range(0, len(ids), SCORED):
                    part = slice(s, s + SCORED)
                    lp[part] = log_probs(p, codes, line, place[part], ids[part], room)
                sums = np.add.reduceat(lp, np.cumsum([0, *(len(x) for x in pieces)])[:-1])
                for i, v in zip(pending, sums, strict=True):
                    total[i] = round(float(v), 3)
                pending.clear()

            held = 0
            for i, k in enumerate(n):
                if k:
                    pending.append(i)
                    held += k
                if held > 200_000:
                    settle()
                    held = 0
            settle()
            return {key: keys, "n_tokens": n, "pll": total, "mean_pll": [round(t / k, 5) if k else None for t, k in zip(total, n, strict=True)]}

        return run

    work.starts = True
    return map_columns(tokens, [F.col(key), F.col("ids")], work, f"`{key}` long, n_tokens long, pll double, mean_pll double")


def scored(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    vocabulary = vocabulary or default_vocabulary()
    tokens = staged(tokenized(docs, vocabulary, key, text), "tokens")
    counts = id_counts(tokens, vocabulary_size(vocabulary))
    codes = Codes(counts)
    return score(tokens, train(tokens, codes, int(counts.sum()) - len(counts), key=key, shard=shard), codes, key)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
