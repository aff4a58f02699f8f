"""Sequence comparison on small inputs: common subsequences, local scores, progressive alignment."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from ..schema import AMINO_ACIDS

# fixed values: residue groups by chemistry
GROUPS = ["AVILMC", "FWY", "STNQ", "KRH", "DE", "G", "P"]
GAP_OPEN, GAP_EXTEND = 11, 1
# fixed values: published ungapped statistics of protein scores
LAMBDA, K = 0.267, 0.041


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by carries in a bit vector."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    return lcs_length(a, b) / min(len(a), len(b)) if a and b else 0.0


def may_reach(a: Counter, b: Counter, least: int) -> bool:
    """Whether a common subsequence can have least letters: it never has more than the shared multiset."""
    return sum((a & b).values()) >= least


def substitution(match: int = 5, similar: int = 1, other: int = -3) -> np.ndarray:
    """Scores of the twenty residues and one for anything else, by rule: same, same group, other."""
    group = {aa: i for i, g in enumerate(GROUPS) for aa in g}
    out = np.full((21, 21), other, np.int32)
    for i, x in enumerate(AMINO_ACIDS):
        for j, y in enumerate(AMINO_ACIDS):
            out[i, j] = match if x == y else similar if group[x] == group[y] else other
    return out


CODE = {c: i for i, c in enumerate(AMINO_ACIDS)}


def codes(s: str) -> np.ndarray:
    return np.array([CODE.get(c, 20) for c in s.upper()], np.int64)


def local_score(a: str, b: str, matrix: np.ndarray | None = None) -> tuple[int, int, int]:
    """Best local score with affine gaps, and where it ends in a and b; anti-diagonals at once."""
    m = substitution() if matrix is None else matrix
    x, y = codes(a), codes(b)
    n, k = len(x), len(y)
    if not n or not k:
        return 0, 0, 0
    low = -(1 << 30)
    h1 = np.zeros(n + 1, np.int64)
    h2 = np.zeros(n + 1, np.int64)
    e = np.full(n + 1, low)
    f = np.full(n + 1, low)
    best, where = 0, (0, 0)
    for d in range(2, n + k + 1):
        i = np.arange(max(1, d - k), min(n, d - 1) + 1)
        e_new, f_new, h = np.full(n + 1, low), np.full(n + 1, low), np.zeros(n + 1, np.int64)
        e_new[i] = np.maximum(h1[i] - GAP_OPEN, e[i] - GAP_EXTEND)
        f_new[i] = np.maximum(h1[i - 1] - GAP_OPEN, f[i - 1] - GAP_EXTEND)
        h[i] = np.maximum(np.maximum(h2[i - 1] + m[x[i - 1], y[d - i - 1]], 0), np.maximum(e_new[i], f_new[i]))
        top = int(h[i].max())
        if top > best:
            j = int(i[h[i].argmax()])
            best, where = top, (j, d - j)
        h2, h1, e, f = h1, h, e_new, f_new
    return best, *where


def bit_score(raw: float) -> float:
    return (LAMBDA * raw - math.log(K)) / math.log(2)


def e_value(raw: float, query: int, database: int) -> float:
    return K * query * database * math.exp(-LAMBDA * raw)


def _to_profile(profile: np.ndarray, seq: np.ndarray, m: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Global alignment of a sequence to column frequencies; pairs of places, -1 for a gap."""
    n, k = len(profile), len(seq)
    fit = profile[:, :21] @ m[:, seq]
    s = np.zeros((n + 1, k + 1))
    s[:, 0], s[0] = -gap * np.arange(n + 1), -gap * np.arange(k + 1)
    back = np.zeros((n + 1, k + 1), np.int8)
    back[1:, 0], back[0, 1:] = 1, 2
    for i in range(1, n + 1):
        diag, up = s[i - 1, :-1] + fit[i - 1], s[i - 1, 1:] - gap
        best = np.maximum(diag, up)
        step = np.where(diag >= up, 0, 1)
        left = -gap * np.arange(1, k + 1)
        # left moves: a running maximum of best + gap * column
        run = np.maximum.accumulate(np.concatenate([[s[i, 0]], best - left]))
        along = run[:-1] + left
        s[i, 1:] = np.maximum(best, along)
        back[i, 1:] = np.where(best >= along, step, 2)
    i, j, pairs = n, k, []
    while i or j:
        b = back[i, j]
        if b == 0:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif b == 1:
            i -= 1
            pairs.append((i, -1))
        else:
            j -= 1
            pairs.append((-1, j))
    return pairs[::-1]


def align_group(seqs: list[str], gap: float = 4.0) -> list[str]:
    """Progressive alignment: the sequence nearest to all others by shared 3-mers first, then by falling share."""
    if len(seqs) < 2:
        return list(seqs)
    grams = [Counter(s[i : i + 3] for i in range(max(1, len(s) - 2))) for s in seqs]
    total = sum(grams, Counter())
    near = [sum(min(c, total[g] - c) for g, c in x.items()) / max(1, sum(x.values())) for x in grams]
    first = max(range(len(seqs)), key=lambda i: (near[i], -i))
    rest = sorted((i for i in range(len(seqs)) if i != first), key=lambda i: (-sum((grams[i] & grams[first]).values()), i))
    m = substitution().astype(float)
    rows: dict[int, list[str]] = {first: list(seqs[first])}
    for i in rest:
        width = len(rows[first])
        profile = np.zeros((width, 22))
        for r in rows.values():
            for p, c in enumerate(r):
                profile[p, 21 if c == "-" else CODE.get(c.upper(), 20)] += 1
        profile /= len(rows)
        pairs = _to_profile(profile, codes(seqs[i]), m, gap)
        for j, r in rows.items():
            rows[j] = ["-" if p < 0 else r[p] for p, _ in pairs]
        rows[i] = ["-" if q < 0 else seqs[i][q] for _, q in pairs]
    return ["".join(rows[i]) for i in range(len(seqs))]
