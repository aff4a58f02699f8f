"""Queries that take whole strings, against brute force on tables whose strings differ only after a common start."""

import random

from kinlattice.plans import catalogue


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def survivors(rows):
    """The scan of greedy() over (doc_id, text) rows by doc_id; the shorter text wins, then the lower doc_id."""
    rows = sorted(rows)
    dead = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a not in dead and b not in dead and common(x, y) / min(len(x), len(y)) > 0.9:
                dead.add(max((len(x), a), (len(y), b))[1])
    return {i: i not in dead for i, _ in rows}


def test_in_group_dedup(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    head, tail = say(80), say(300)
    texts = [(1, head + say(300)), (2, head + say(310)), (3, head + tail), (4, say(80) + tail * 2), (5, head + tail[:150] + "zz" + tail[150:]), (6, say(60) + tail + head)]
    rows = [(s * 10 + i, f"s{s}", t, len(t)) for s in range(3) for i, t in texts[s:]]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.stays for r in catalogue.in_group_dedup(spark, str(tmp_path)).collect()}
    want = {}
    for s in range(3):
        want |= survivors([(i, t) for i, source, t, _ in rows if source == f"s{s}"])
    assert got == want and got[1] and got[2] and not all(got.values())
