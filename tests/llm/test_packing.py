import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlattice.llm import common, packing


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=64))
@settings(max_examples=80, deadline=None)
def test_patterns_hold_every_piece(histogram):
    got = Counter()
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert 0 < sum(pattern) <= 64
        for size in pattern:
            got[size] += count
    assert got == Counter({k: v for k, v in histogram.items() if v})


def naive(histogram, length):
    packs = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        packs.sort(key=sum)
        if packs and sum(packs[0]) + size <= length:
            packs[0].append(size)
        else:
            packs.append([size])
    return packs


def test_as_many_packs_as_piece_by_piece():
    rng = random.Random(3)
    for _ in range(30):
        h = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(25)}
        got = packing.shortest_pack_first(h, 100)
        assert sum(n for _, n in got) == len(naive(h, 100))


def test_work_does_not_follow_counts():
    small = packing.shortest_pack_first({k: 3 for k in range(1, 1025)})
    large = packing.shortest_pack_first({k: 3 * 10**9 for k in range(1, 1025)})
    assert len(large) < 20_000 and len(small) < 20_000
    used = sum(sum(p) * n for p, n in large)
    assert used > 0.97 * 1024 * sum(n for _, n in large)


def test_ids_are_the_file_s(spark):
    """Of all texts of two tables, and of odd ones, against the library on the whole text."""
    from tokenizers import Tokenizer

    encode, whole = packing.Encoder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    texts = [r.text for d in ("sf0.001", "sf0.01") for r in spark.read.parquet(f"/root/testdata/{d}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    alphabet = [*"ab  \n\t'1.é", "ß", "漢", "🙂", " ", " ", "'s", "<|endoftext|>", "\x00", "\r\n", "Ω", "\xa0", "\x1c", "\u3000", "\x85"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 50_000 + " " * 5_000, "ab " * 700_000, "a  " * 400_000, None, "", " " + "y" * 60]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encode(texts) == want == encode(texts)


@pytest.mark.parametrize("group_rows", [7, 50_000])
def test_every_id_once_gapless(spark, docs, group_rows):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "a", "zebra", "Straße", "7"]) for _ in range(rng.choice([0, 1, 3, 40, 200, 900]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (5, texts[5]), (None, "abc")]
    vocabulary = packing.default_vocabulary()
    df = docs(rows).withColumnRenamed("n_chars", "length")
    pieces = packing.cut(df, vocabulary, 64).cache()
    got = packing.pack(pieces, 64, group_rows=group_rows).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == {r[0] for r in rows}
    for k, t in rows:
        ids = np.append(np.frombuffer(packing.encoder(vocabulary)([t])[0], "<u4"), np.uint32(0))
        for r in by_doc[k]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        assert sum(r.length for r in by_doc[k]) == len(ids) * sum(x[0] == k for x in rows)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(by_seq) == list(range(len(by_seq)))
    tokens = sum(r.length for r in got)
    assert len(by_seq) <= tokens / 64 * 1.1 + 1


def test_empty_table(docs):
    assert packing.packed(docs([])).count() == 0


def test_other_work_lets_a_worker_forget_the_tokenizer(spark):
    """A worker is used for many stages; what one stage cached is not held beside the next one's memory."""

    def held(n: list) -> dict:
        from kinlattice.llm import packing as there

        return {"held": [there.encoder.cache_info().currsize] * len(n)}

    def fill(n: list) -> dict:
        from kinlattice.llm import packing as there

        there.encoder(there.default_vocabulary())
        return held(n)

    rows = spark.range(4, numPartitions=1).select("id")
    assert {r.held for r in common.map_columns(rows, [F.col("id")], common.keeping(fill), "held long").collect()} == {1}
    assert {r.held for r in common.map_columns(rows, [F.col("id")], held, "held long").collect()} == {0}
