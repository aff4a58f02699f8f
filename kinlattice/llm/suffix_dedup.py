"""Suffix-array dedup: remove every byte under a string of DEPTH bytes that also starts elsewhere.

The suffixes of all texts are sorted by most-significant-digit passes, only as deep as DEPTH bytes and
only as long as a suffix has company; the groups left after the last pass are the repeated strings.

First pass, across the cluster. The digit of a suffix is its anchor: among its first STRETCH places the
one with the smallest hash of 8 bytes (the first of equals), with the KEY bytes from there on. Equal
strings of DEPTH bytes have equal anchors at equal distances, and neighbouring suffixes mostly share
one, so a run of suffixes with one anchor travels as one record. Anchors that stand only once end here.

A key that stands at more than HEAVY anchors would bring all its runs to one task. Its runs are cut where they
travel, in blocks of BLOCK distances from the anchor, and a block's next digit goes into the key: all the
bytes that every suffix of the block holds, DEPTH - BLOCK + 1 of them. So a passage of many texts in different
surroundings is dealt over tasks, and its equal blocks are one record of a batch.

Later passes, within an anchor's group. A run brings its bytes; its suffixes are ordered by four digits
of 50 bytes each, the most significant first, and a suffix that is alone after a pass leaves. A pass gathers like digits
by hash, compares their bytes, and ranks the different digits of each group by their bytes, so that the
groups stand in the order of the suffixes; those left after the last pass are equal through DEPTH bytes.

Equal texts are one text with several copies: it goes through once, and all of it is repeated if it has
DEPTH bytes. Matches never cross documents. Within a batch, equal runs travel as one with a count.

Defined cases: null is empty; texts under DEPTH bytes lose nothing; a string may repeat within its own
text, also overlapping itself; repeated rows are copies; a null key is a key of its own text; ties between
anchors go to the first; very long texts go through in segments; an empty table gives no row; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_columns, mix, staged, table

DEPTH = 200
STRETCH = 150
KEY = 50
DIGITS = 4
SEGMENT = 1 << 20
HEAVY = 2_000
HEAVY_SLOTS = 1 << 20
BLOCK = 15
CHUNK = 3 << 20  # bytes of runs that one step of the later passes holds
_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _M)


def raw_of(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def text_ids(raw: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last start of the runs of suffixes that share an anchor, for starts 0 .. len - DEPTH."""
    n = len(raw) - DEPTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    parts = [_runs(raw, a, min(a + SEGMENT, n)) for a in range(0, n, SEGMENT)]
    anchor, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 1:  # a run may go on in the next segment
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        anchor, first, last = anchor[new], first[new], last[np.append(new[1:], len(last)) - 1]
    return anchor, first, last


def _runs(raw: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.uint8, b - a + STRETCH + 6, a).astype(np.uint64)
    g = x[:-1] | (x[1:] << np.uint64(8))
    g = g[:-2] | (g[2:] << np.uint64(16))
    g = g[:-4] | (g[4:] << np.uint64(32))
    g *= _M
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g &= np.uint64(0xFFFFFFFF00000000)
    g |= np.arange(len(g), dtype=np.uint64)  # the first of equal hashes is the smallest
    rows = -(-len(g) // STRETCH)
    full = np.full(rows * STRETCH, np.iinfo(np.uint64).max, np.uint64)
    full[: len(g)] = g
    full = full.reshape(rows, STRETCH)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = b - a
    low = np.minimum(behind[:n], ahead[STRETCH - 1 : STRETCH - 1 + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], new + a, np.append(new[1:], n) - 1 + a


def keys_of(raw: bytes, anchor: np.ndarray) -> np.ndarray:
    """64-bit hashes of the KEY bytes at each anchor."""
    w = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), KEY)[anchor]
    words = np.ascontiguousarray(w[:, :48]).view("<u8")
    acc = mix(np.ascontiguousarray(w[:, KEY - 8 :]).view("<u8")[:, 0] + _M)
    for j in range(words.shape[1]):
        acc = mix((acc ^ words[:, j]) * _M + np.uint64(j))
    return acc


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, digest of the text, and the text's 128-bit identity."""

    def work(keys: list, texts: list) -> dict:
        raw = [raw_of(t) for t in texts]
        ids = [text_ids(r) for r in raw]
        return {key: keys, "n_bytes": [len(r) for r in raw], "sha": [hashlib.sha256(r).hexdigest() for r in raw], "a": [i[0] for i in ids], "b": [i[1] for i in ids]}

    return map_columns(docs, [F.col(key).cast("long"), F.col(text)], work, f"`{key}` long, n_bytes long, sha string, a long, b long")


def _spread(rows: list, values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    b = ((values >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.diff(b[order], prepend=-1, append=buckets))
    return [(int(b[order[i]]), order[i:j]) for i, j in zip(edge, edge[1:], strict=False)]


def repeated_anchors(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """a and packed places: the anchors of that text whose key stands somewhere else too (or in its batch).

    Rows without places: a is a key of more than HEAVY anchors.
    """
    names = ("bucket", "ids", "n", "keys", "places", "known", "many")

    def emit(texts: list) -> dict:
        ids, keys, owner, place = [], [], [], []
        for t in set(texts):
            raw = raw_of(t)
            if len(raw) < DEPTH:
                continue
            anchor, _, _ = runs(raw)
            keys.append(keys_of(raw, anchor))
            owner.append(np.full(len(anchor), len(ids)))
            place.append(anchor)
            ids.append(text_ids(raw)[0])
        if not ids:
            return {n: [] for n in names}
        ids, keys, owner, place = np.array(ids, np.int64), np.concatenate(keys), np.concatenate(owner), np.concatenate(place)
        _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        several = count[back] > 1
        rows = []
        sent = np.sort(first)  # of keys that the batch has several times, one stands for all
        for b, at in _spread(rows, keys[sent], buckets):
            at = np.sort(sent[at])
            of, n = np.unique(owner[at], return_counts=True)
            rows.append((b, ids[of].tobytes(), n.astype("<u4").tobytes(), keys[at].tobytes(), place[at].astype("<u4").tobytes(), several[at].astype(np.uint8).tobytes(), count[back[at]].astype("<u4").tobytes()))
        known = np.flatnonzero(several)
        if len(known):
            of, n = np.unique(owner[known], return_counts=True)
            rows.append((int(keys[known[0]] % np.uint64(buckets)), ids[of].tobytes(), n.astype("<u4").tobytes(), b"", place[known].astype("<u4").tobytes(), b"", b""))
        return columns(names, rows)

    schema = "bucket int, ids binary, n binary, keys binary, places binary, known binary, many binary"
    packed = map_columns(docs, [F.col(text)], emit, schema).repartition(buckets, "bucket")

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2]:
                    held.setdefault(b, []).append(row)
                else:
                    yield told(np.frombuffer(row[0], "<i8"), np.frombuffer(row[1], "<u4"), np.frombuffer(row[3], "<u4"))
        for b in list(held):
            rows = held.pop(b)
            ids = np.concatenate([np.repeat(np.frombuffer(r[0], "<i8"), np.frombuffer(r[1], "<u4")) for r in rows])
            keys, place, known, times = (np.concatenate([np.frombuffer(r[j], kind) for r in rows]) for j, kind in ((2, "<u8"), (3, "<u4"), (4, "u1"), (5, "<u4")))
            order = np.argsort(keys)
            keys, ids, place, known, times = keys[order], ids[order], place[order], known[order], times[order]
            first = np.flatnonzero(np.diff(keys.view(np.int64), prepend=keys.view(np.int64)[:1] - 1))
            tag = mix(ids.view(np.uint64) + mix(place.astype(np.uint64) + _M))
            many = (np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)) | (np.maximum.reduceat(known, first) > 0)
            heavy = keys[first[np.add.reduceat(times.astype(np.int64), first) > HEAVY]]
            if len(heavy):
                yield pa.RecordBatch.from_arrays([pa.array(heavy.view(np.int64)), pa.nulls(len(heavy), pa.binary())], names=["a", "places"])
            keep = np.repeat(many, np.diff(np.append(first, len(keys))))
            ids, place = ids[keep], place[keep]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                of, n = np.unique(ids, return_counts=True)
                yield told(of, n, place[order])

    def told(of: np.ndarray, n: np.ndarray, place: np.ndarray):
        ends = np.cumsum(n)
        raw = np.ascontiguousarray(place, "<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["a", "places"])

    return packed.mapInArrow(meet, "a long, places binary")


def blocks(raw: bytes, key: int, at: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """A heavy key's run in parts of at most BLOCK distances from the anchor: key with the next digit, first and last start.

    Parts begin at distances that are multiples of BLOCK, so that equal strings lie in parts of equal distances.
    """
    import xxhash

    out = []
    for far in range((at - last) // BLOCK, (at - first) // BLOCK + 1):
        low, high = far * BLOCK, far * BLOCK + BLOCK - 1  # distances of this part
        digit = raw[max(0, at - low) : at - high + DEPTH]
        out.append((xxhash.xxh64_intdigest(digit, (key ^ far) & 0xFFFFFFFFFFFFFFFF), max(first, at - high), min(last, at - low)))
    return out


def repeated_starts(held: DataFrame, buckets: int, heavy: np.ndarray | None = None) -> DataFrame:
    """a, first, last: within a run of text a, the first and the last start of a repeated string.

    held: a, t (text) and places (repeated anchors) of each different text. heavy: a mark for each slot of heavy keys, if there are any.
    """
    names = ("bucket", "ids", "keys", "shift", "starts", "sizes", "count", "bytes")

    def emit(ids: list, texts: list, places: list) -> dict:
        rows, found = [], {}
        for i, t, p in zip(ids, texts, places, strict=True):
            raw = raw_of(t)
            anchor, first, last = runs(raw)
            keep = np.flatnonzero(np.isin(anchor, np.frombuffer(b"".join(p), "<u4")))
            keys = keys_of(raw, anchor[keep])
            for k, at, f, e in zip(keys.tolist(), anchor[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                cut = blocks(raw, k, at, f, e) if heavy is not None and heavy[k % len(heavy)] else [(k, f, e)]
                for own, b, c in cut:
                    found.setdefault((own, at - b, raw[b : c + DEPTH]), []).append((i, b))
        if not found:
            return {n: [] for n in names}
        entries = list(found.items())
        keys = np.array([e[0][0] for e in entries], np.uint64)
        for b, at in _spread(rows, keys, buckets):
            some = [entries[j] for j in at]
            own = [(i, f) for _, v in some for i, f in v]
            rows.append(
                (
                    b,
                    np.array([i for i, _ in own], "<i8").tobytes(),
                    np.array([e[0][0] for e in some], "<u8").tobytes(),
                    np.array([e[0][1] for e in some], "<u4").tobytes(),
                    np.array([f for _, f in own], "<u4").tobytes(),
                    np.array([len(e[0][2]) for e in some], "<u4").tobytes(),
                    np.array([len(e[1]) for e in some], "<u4").tobytes(),
                    b"".join(e[0][2] for e in some),
                )
            )
        return columns(names, rows)

    schema = "bucket int, ids binary, keys binary, shift binary, starts binary, sizes binary, count binary, bytes binary"
    packed = map_columns(held, [F.col("a"), F.col("t"), F.col("places")], emit, schema).repartition(buckets, "bucket")

    def meet(batches):
        held_: dict[int, list] = {}
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held_.setdefault(b, []).append(row)
        for b in list(held_):
            rows = held_.pop(b)
            ids, keys, shift, starts, sizes, count = (np.concatenate([np.frombuffer(r[j], kind) for r in rows]) for j, kind in enumerate(("<i8", "<u8", "<u4", "<u4", "<u4", "<u4")))
            text = b"".join(r[6] for r in rows)
            del rows
            at = np.cumsum(sizes, dtype=np.int64) - sizes
            own = np.cumsum(count, dtype=np.int64) - count
            order = np.argsort(keys, kind="stable")
            edge = np.flatnonzero(np.diff(keys[order].view(np.int64), prepend=keys[order].view(np.int64)[:1] - 1))
            total = np.add.reduceat(sizes[order].astype(np.int64), edge)
            part = np.cumsum(total) // CHUNK
            for c in np.unique(part):
                inside = np.flatnonzero(part == c)
                lo, hi = edge[inside[0]], edge[inside[-1] + 1] if inside[-1] + 1 < len(edge) else len(order)
                some = order[lo:hi]
                first, last = later_passes(text, at[some], sizes[some].astype(np.int64), keys[some], shift[some].astype(np.int64), count[some])
                hit = np.flatnonzero(first >= 0)
                n = count[some[hit]].astype(np.int64)
                pick = np.repeat(own[some[hit]], n) + _within(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(starts[pick].astype(np.int64) + np.repeat(first[hit], n)), pa.array(starts[pick].astype(np.int64) + np.repeat(last[hit], n))], names=["a", "first", "last"])

    return packed.mapInArrow(meet, "a long, first long, last long")


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _together(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values are neighbours, and where a new one begins."""
    order = np.argsort(values, kind="stable")
    return order, np.append(True, values[order[1:]] != values[order[:-1]])[: len(order)]


def _words(digits: np.ndarray, wide: int) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers whose order is that of the bytes; the last one overlaps the one before."""
    return [np.ascontiguousarray(digits[:, at : at + 8]).view(">u8")[:, 0].astype(np.uint64) for at in (*range(0, wide - 7, 8), wide - 8)]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of whole numbers, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def later_passes(text: bytes, at: np.ndarray, sizes: np.ndarray, keys: np.ndarray, shift: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, its first and last suffix (from the run's start) that has company through DEPTH bytes; -1 if none.

    at and sizes: the runs' bytes in text; shift: from a run's start to its anchor; count: texts that have the run.
    """
    n = sizes - DEPTH + 1
    flat = np.frombuffer(text, np.uint8)[np.repeat(at, sizes) + _within(sizes)]
    power = np.full(len(flat) + 1, np.uint64(1), np.uint64)
    power[1:] = np.uint64(_BASE)
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_TABLE[flat] * power[:-1], out=sums[1:])
    power[0] = 1
    power[1:] = np.uint64(_INVERSE)
    np.multiply.accumulate(power, out=power)
    run = np.repeat(np.arange(len(n)), n)
    inside = _within(n)
    place = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    group = _ranks(keys[run], (shift[run] - inside).astype(np.uint64))  # anchor and its distance
    alone = count[run] < 2
    wide = DEPTH // DIGITS
    rows = np.lib.stride_tricks.sliding_window_view(flat, wide)
    for digit in range(DIGITS):
        i = place + digit * wide
        like = mix(mix(group.astype(np.uint64) + _M) ^ ((sums[i + wide] - sums[i]) * power[i]))
        order, new = _together(like)
        one = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))  # the first of like ones, which the others must equal
        other = np.flatnonzero(~new)
        for s in range(0, len(other), 1 << 16):
            x, y = order[other[s : s + (1 << 16)]], one[other[s : s + (1 << 16)]]
            if (group[x] != group[y]).any() or (rows[i[x]] != rows[i[y]]).any():  # different digits of one hash: by their bytes, then
                order, new = _together(_ranks(group, *_words(rows[i], wide)))
                break
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        company = np.empty(len(order), bool)
        company[order] = np.repeat(size > 1, size)
        keep = company | ~alone
        # ranks of the digits that stay, by the group before and then by their bytes
        part = np.empty(len(order), np.int64)
        part[order] = np.cumsum(new) - 1
        first_of = order[new]
        stay = np.flatnonzero((size > 1) | ~alone[first_of])
        reps = first_of[stay]
        by = np.lexsort((*_words(rows[i[reps]], wide)[::-1], group[reps]))
        rank = np.zeros(len(size), np.int64)
        rank[stay[by]] = np.arange(len(by))
        run, inside, place, group, alone = run[keep], inside[keep], place[keep], rank[part[keep]], alone[keep]
    first, last = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int64)
    if len(run):
        new = np.flatnonzero(np.diff(run, prepend=-1))
        first[run[new]] = inside[new]
        last[run[new]] = inside[np.append(new[1:], len(run)) - 1]
    return first, last


def spans_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes under the strings that start at first .. last, as rows start, end."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + DEPTH)
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return np.stack([a[new], b[np.append(new[1:], len(a)) - 1]], 1)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes) for every row."""
    spark = docs.sparkSession
    ids = staged(identities(docs, key, text), "identities")
    total = ids.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = ids.groupBy("a", "b").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.max(F.col(key).isNull().cast("int")).alias("some_null"))
    anchors = staged(repeated_anchors(docs, max(least, total // (128 << 20)), text), "anchors")
    slots = anchors.where("places IS NULL").select(F.pmod("a", F.lit(HEAVY_SLOTS)).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()  # at most so many numbers
    heavy = np.zeros(HEAVY_SLOTS, bool) if len(slots) else None
    if len(slots):
        heavy[slots] = True
    places = anchors.where("places IS NOT NULL").dropDuplicates(["a", "places"]).groupBy("a").agg(F.collect_list("places").alias("places"))
    of = classes.join(places, "a").select("a", "b", F.col("rep").alias("k"), "places")
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def own(a: list, b: list, ts: list, ps: list) -> dict:
        keep = [i for i, t in enumerate(ts) if text_ids(raw_of(t)) == (a[i], b[i])]
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep], "t": [ts[i] for i in keep], "places": [ps[i] for i in keep]}

    joined = texts.join(of, texts["k"].eqNullSafe(of["k"])).drop(of["k"])
    held = staged(map_columns(joined, [F.col(c) for c in ("a", "b", "t", "places")], own, "a long, b long, t string, places array<binary>"), "held")
    starts = repeated_starts(held, max(least, total // (64 << 20)), heavy)
    spans = starts.groupBy("a").agg(F.collect_list(F.struct("first", "last")).alias("s"))

    def result(a: list, b: list, ts: list, ss: list) -> dict:
        out = []
        for t, s in zip(ts, ss, strict=True):
            raw = raw_of(t)
            cut = spans_of(np.array([x["first"] for x in s]), np.array([x["last"] for x in s]))
            h, at = hashlib.sha256(), 0
            for i, j in cut.tolist():
                h.update(raw[at:i])
                at = j
            h.update(raw[at:])
            out.append((int((cut[:, 1] - cut[:, 0]).sum()), h.hexdigest(), [{"start": i, "end": j} for i, j in cut.tolist()]))
        return {"a": a, "b": b, "gone": [o[0] for o in out], "kept": [o[1] for o in out], "spans": [o[2] for o in out]}

    # several rows with one key and text are one text; its result is taken once
    partly = map_columns(held.join(spans, "a"), [F.col(c) for c in ("a", "b", "t", "s")], result, "a long, b long, gone long, kept string, spans array<struct<start:long,end:long>>").dropDuplicates(["a", "b"])
    known = classes.select("a", "b", "copies").join(partly, ["a", "b"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= DEPTH)
    none = F.array().cast("array<struct<start:long,end:long>>")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    got = ids.join(known, ["a", "b"]).withColumn("spans", F.when(whole, every).otherwise(F.coalesce("spans", none)))
    return got.select(
        key,
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        "spans",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


# every window's hash by brute force, over hexadecimal digits
ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), s AS (
  SELECT rid, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200
), k AS (
  SELECT rid, i, hash(substr(h, 2 * i + 1, 400)) AS g FROM s
), r AS (
  SELECT rid, i FROM k WHERE g IN (SELECT g FROM k GROUP BY g HAVING count(*) > 1)
), p AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r
), q AS (
  SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM p
), sp AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM q GROUP BY rid, run
), sq AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS pb FROM sp
), g AS (
  SELECT d.rid, count(*) AS spans, sum(b - a) AS gone, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS head, max(b) AS last FROM sq JOIN d ON sq.rid = d.rid GROUP BY d.rid
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN g.rid IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN g ON d.rid = g.rid
"""
