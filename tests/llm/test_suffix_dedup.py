import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kinlattice.llm import suffix_dedup as sd


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    n = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (k, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if n[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((k, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    pool = [say(rng.randint(150, 420)) for _ in range(10)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, 120)
            parts += [say(rng.randint(0, 150)), p[a : a + rng.randint(100, 400)] if rng.random() < 0.7 else p]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1]), (5, rows[5][1]), (104, "The " * 300), (105, "x" * 199), (106, "x" * 200), (107, "ab" * 101), (None, pool[0] * 2), (108, pool[1] + say(90) + pool[1]), (109, "y" * 201), (109, say(300))]
    got = sorted((tuple(r)[:5] for r in sd.removed(docs(rows).withColumnRenamed("n_chars", "a").repartition(7)).collect()), key=repr)
    assert got == brute(rows)
    assert any(0 < r[2] < r[1] for r in got)


@pytest.mark.parametrize("heavy", [3, 2_000])
def test_a_passage_of_a_third_of_texts(docs, monkeypatch, heavy):
    """One passage between different neighbours: its runs are cut, and results stay the same."""
    monkeypatch.setattr(sd, "HEAVY", heavy)
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = say(700), say(230)
    rows = [(i, say(rng.randint(0, 260)) + (passage[rng.randint(0, 30) : 700 - rng.randint(0, 30)] if i % 3 == 0 else other if i % 7 == 0 else "") + say(rng.randint(0, 260))) for i in range(90)]
    got = sorted((tuple(r)[:5] for r in sd.removed(docs(rows).repartition(5)).collect()), key=repr)
    assert got == brute(rows)


def test_blocks_keep_equal_strings_together():
    rng = np.random.default_rng(2)
    mid = bytes(rng.integers(97, 120, 500).astype(np.uint8))
    a, b = bytes(rng.integers(97, 120, 90).astype(np.uint8)) + mid, bytes(rng.integers(97, 120, 41).astype(np.uint8)) + mid
    parts = []
    for raw, at in ((a, 90 + 200), (b, 41 + 200)):
        cut = sd.blocks(raw, 12345, at, at - 149, at)
        assert cut[-1][1] == at - 149 and cut[0][2] == at and sum(e - f + 1 for _, f, e in cut) == 150
        parts.append({(k, raw[s : s + 200]) for k, f, e in cut for s in range(f, e + 1)})
    assert {x for _, x in parts[0]} == {x for _, x in parts[1]} and parts[0] == parts[1]


@pytest.mark.parametrize("collide", [False, True])
def test_later_passes_order_groups_by_bytes(monkeypatch, collide):
    if collide:  # all digits have one hash
        monkeypatch.setattr(sd, "mix", lambda x: x * np.uint64(0))
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(0, 256, 200).astype(np.uint8)) for _ in range(20)]
    runs = [words[i] for i in rng.integers(0, 20, 60)] + [bytes(200), bytes(199) + b"\x01"]
    at = np.arange(len(runs)) * 200
    first, last = sd.later_passes(b"".join(runs), at, np.full(len(runs), 200), np.zeros(len(runs), np.uint64), np.zeros(len(runs), np.int64), np.ones(len(runs), np.int64))
    n = Counter(runs)
    assert [f == 0 for f in first] == [n[r] > 1 for r in runs] and (last == first).all()


def test_runs_split_all_suffixes(monkeypatch):
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    anchor, first, last = sd.runs(raw)
    assert first[0] == 0 and last[-1] == len(raw) - sd.DEPTH and (first[1:] == last[:-1] + 1).all()
    assert ((anchor >= last) & (anchor < first + sd.STRETCH)).all()
    monkeypatch.setattr(sd, "SEGMENT", 700)
    for x, y in zip(sd.runs(raw), (anchor, first, last), strict=True):
        assert (x == y).all()
    part = sd.runs(raw[1000:2000])
    whole = {(a, s) for a, f, e in zip(anchor, first, last, strict=True) for s in range(f, e + 1)}
    assert {(a + 1000, s + 1000) for a, f, e in zip(*part, strict=True) for s in range(f, e + 1)} <= whole


def test_empty(docs):
    assert sd.removed(docs([])).count() == 0
