"""N-gram Jaccard join: all links of similarity 3/4 or more between word-shingle sets, by PartEnum.

Documents with equal sets form a class, and only one set of a class goes on. For the others:

1. Elimination. A link at 3/4 needs three quarters of a set in common with another one. Of a fixed
   share of the shingle domain it is counted how many shingles of a set no other set holds; a set with
   more than a quarter of its size of them can have no link. Nothing that could link is lost.
2. Signatures (PartEnum). Sets are banded by size, each band reaching down to 3/4 of its largest size
   r, so that two linked sets lie in one band or in neighbouring ones, and their symmetric difference
   has at most k = floor(2r/7) shingles. The domain is partitioned by hash into n1 parts with
   n1 * (k2 + 1) > k, so that some part holds at most k2 differences; it is cut into n2 smaller parts, and
   every subset of n2 - k2 of these gives a signature. One of them holds no difference: linked sets of a
   band share a signature. k2 and n2 are chosen for each band by the number of its sets.
3. Verification. Sets that share a signature are compared exactly. A signature's sets are first
   compared with one of them (a star), so that a group of copies needs as many comparisons as it has
   sets; then one set of each component found so far with another hub, STARS times; at last all pairs
   that share a signature and still lie in different components, unless their sizes and unshared shingles
   exclude a link. Where more than HEAVY sets share a signature, as sets of one template do, two of them
   can only be linked if they share one of their floor(n / 4) + 1 rarest shingles, in an order that is the
   same for all; only such pairs become rows. Where more than HEAVY sets share such a shingle too, they are
   dealt into blocks, and a task counts the common shingles of two blocks. No pair is left out that
   could join two components.
4. Components of the links, by smallest label, in joins that stay on the executors.

The plan is the same at every size: texts and sets are shuffled only where their slot in a map of fixed
size has a partner, and never sent to a broadcast side; slim tables of numbers are joined as Spark's own size checks say. All shuffles carry fixed-size records, or packed arrays whose buckets are made as small as a parameter
says; a shingle or signature that a third of all documents have is one entry of each of them.

Defined cases: null or empty texts have no shingle, no link and themselves as component; a text of
fewer than five words has one shingle; repeated rows are a class of their own; a row with a null key links
like any, but a null never becomes a component's number unless no key is there; ties between hubs go by
size and number; very long texts are one set; an empty table gives no row; other columns are not read
(join) or pass through (one_of_each), whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slots, WordHash, columns, dropped, flattened, hash128, map_columns, mix, nested, salted, shingle_sets, staged, starting, table, trimmed

WIDTH = 5
SAMPLED = 6  # sixteenths of the shingle domain in which unshared shingles are counted
STARS = 2
SLOTS = 7 << 20  # of the maps that tell which rows have a partner
MEMBERS = 256  # pairs of one hub that may meet one copy of its set
COUNTED = 2_000_000  # values of shingles that one task holds at a time to count unshared ones
BUCKET = 500_000  # signatures that one task holds at a time
LADDER = [(1, 3), (1, 4), (2, 5), (3, 6), (3, 7), (4, 8)]  # k2 and n2, by rising selectivity and cost
SLACK = 5  # quarters
ROUGH = 8  # the stars look at one in so many signatures, the last round at all
HEAVY = 64  # sets that share a signature, above which pairs are looked for in tiles
TILE = 500_000  # shingles of a block of sets
PLACES = 1 << 22  # of the map of frequent shingles
_CH = np.uint64(0x9E3779B97F4A7C15)


def _buckets(spark, total: int, each: int = BUCKET) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, -(-total // each), 1)


def _identity(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _deal(values: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Sort values of one batch into buckets: bucket, values, and index of each value's owner."""
    b = ((values >> np.uint64(44)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order], prepend=-1, append=buckets))
    return [(int(b[order[i]]), values[order[i:j]], owner[order[i:j]]) for i, j in zip(edges, edges[1:], strict=False)]


PACKED = ("bucket", "ids", "n", "values")


def _pack(ids: list, sets: list[np.ndarray], buckets: int) -> list[tuple]:
    """Rows bucket, ids, n, values: what each bucket gets of several sets, 32 bits of each shingle."""
    if not sets:
        return []
    ids = np.array(ids, np.int64)
    rows = []
    for b, v, o in _deal(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), buckets):
        of, n = np.unique(o, return_counts=True)
        rows.append((b, ids[of].tobytes(), n.astype("<u4").tobytes(), v.astype("<u4").tobytes()))
    return rows


def scanned(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts. Rows with bucket -1 hold keys, the rows' own hashes, sizes and 128-bit identities of sets; the
    others what a bucket gets of the sampled shingles of each different set in a batch."""

    @starting
    def work():
        words = WordHash()

        def run(keys: list, r1: list, r2: list, texts: list) -> dict:
            sets = shingle_sets(texts, words, WIDTH)
            own = [_identity(s) for s in sets]
            some = {i[0]: s for i, s in zip(own, sets, strict=True) if len(s) >= 3}
            part = [s[(s >> np.uint64(32)) & np.uint64(15) < SAMPLED] for s in some.values()]
            packed = _pack(list(some), part, buckets)
            none = [None] * len(packed)
            out = columns(PACKED, packed)
            return {
                "key": keys + none,
                "r1": r1 + none,
                "r2": r2 + none,
                "n_shingles": [len(s) for s in sets] + none,
                "s1": [i[0] for i in own] + none,
                "s2": [i[1] for i in own] + none,
                "bucket": [-1] * len(keys) + out["bucket"],
                **{c: [None] * len(keys) + out[c] for c in PACKED[1:]},
            }

        return run

    inputs = [F.col(key).cast("long"), *hash128(F.col(key), F.col(text)), F.col(text)]
    return map_columns(docs, inputs, work, "key long, r1 long, r2 long, n_shingles long, s1 long, s2 long, bucket int, ids binary, n binary, values binary")


def alone(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and how many of their values no other id has, where any; from a bucket's rows ids, n, values, of which rows is emptied.

    A value and its owner's number are one 64-bit number, sorted in place: a task holds little more than that.
    """
    ids, owner = np.unique(np.concatenate([np.frombuffer(r[0], "<i8") for r in rows]), return_inverse=True)
    n = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows]).astype(np.int64)
    both = np.empty(int(n.sum()), np.uint64)
    at = 0
    for r in rows:
        v = np.frombuffer(r[2], "<u4")
        both[at : at + len(v)] = v
        at += len(v)
    rows.clear()
    both <<= np.uint64(32)
    at = 0
    for i in range(0, len(n), 4096):
        some = np.repeat(owner[i : i + 4096].astype(np.uint64), n[i : i + 4096])
        both[at : at + len(some)] |= some
        at += len(some)
    both.sort()
    v = (both >> np.uint64(32)).astype(np.uint32)
    of = both.astype(np.uint32)  # the lower half
    del both
    last = np.append(v[1:] != v[:-1], True)[: len(v)]  # of the places of one value
    first = np.append(True, last[:-1])[: len(v)]
    count = np.bincount(of[first][of[first] == of[last]], minlength=len(ids))
    some = np.flatnonzero(count)
    return ids[some], count[some]


def unshared(packed: DataFrame, buckets: int) -> DataFrame:
    """id and u: how many of a set's packed values no other set has (left out where none)."""

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, i, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append((i, n, v))
        batch = None
        for b in list(held):
            of, u = alone(held.pop(b))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(u)], names=["id", "u"])
        trimmed()

    dealt = packed.select(*PACKED).repartition(buckets, "bucket")
    return dealt.mapInArrow(count, "id long, u long").groupBy("id").agg(F.sum("u").alias("u"))


def band_of(n: int) -> int:
    """Bands end at sizes 4, 5, 6, 8, 10, ...: each band's largest size is that of the one below over 3/4."""
    return _BANDS.searchsorted(n)


def _bands() -> np.ndarray:
    ends = [4]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 4 // 3)
    return np.array([0, *ends])


_BANDS = _bands()


def choose(sets: int) -> tuple[int, int]:
    """k2 and n2 for a band of so many sets: a step up the ladder for every tenfold number."""
    return LADDER[min(len(LADDER) - 1, max(0, int(math.log10(max(sets, 1) / 2000))))]


def signatures(s: np.ndarray, band: int, shape: tuple[int, int]) -> np.ndarray:
    """PartEnum signatures of a set in a band.

    There are SLACK times as many parts as the pigeonhole principle asks for, so that a linked set
    differs in at most k2 places in at least `good` of them. Subsets that hold no shingle of the set
    tell nothing; where fewer than `good` parts have such a subset, one of the good parts has none, and
    the signatures of empty subsets are left out without losing a link.
    """
    k = 2 * int(_BANDS[band]) // 7
    k2, n2 = min(shape[0], k), shape[1]
    n1 = -(-(k + 1) * SLACK // (4 * (k2 + 1)))
    good = n1 - k // (k2 + 1)
    h = mix(s ^ _CH)
    cell = ((h >> np.uint64(20)) % np.uint64(n1) * np.uint64(n2) + (h & np.uint64(0xFFFF)) % np.uint64(n2)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    sums = np.zeros(n1 * n2, np.uint64)
    if len(c):
        sums[c[first]] = np.add.reduceat(mix(h + _CH)[order], first)
    sums = sums.reshape(n1, n2)
    held = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
    pick = _subsets(n2, n2 - k2)
    full = held @ pick > 0
    out = np.zeros(full.shape, np.uint64)
    for i in range(n2):
        out += sums[:, i : i + 1] * pick[i].astype(np.uint64)
    place = mix((np.arange(out.size, dtype=np.uint64) + np.uint64(1)) * _CH + np.uint64(band << 40))
    out = mix(out.ravel() ^ place)
    return out[full.ravel()] if np.count_nonzero(~full.all(axis=1)) < good else out


@functools.lru_cache(maxsize=64)
def _subsets(n: int, size: int) -> np.ndarray:
    """A column for each subset of so many of n things, 1 where a thing is in it."""
    subsets = list(itertools.combinations(range(n), size))
    pick = np.zeros((n, len(subsets)), np.int64)
    for j, sub in enumerate(subsets):
        pick[list(sub), j] = 1
    return pick


def by_parts(shapes: dict[int, tuple[int, int]]):
    """A set's signatures by PartEnum, those of its own band marked by their last bit: it also signs as one of the next band."""

    def sign(s: np.ndarray) -> np.ndarray:
        b = int(band_of(len(s)))
        made = [(signatures(s, band, shapes[band]) & ~np.uint64(1)) | np.uint64(band == b) for band in (b, b + 1) if band in shapes]
        return np.concatenate(made) if made else np.empty(0, np.uint64)

    return sign


def by_rarity(levels: bytes):
    """A set's floor(n / 4) + 1 rarest shingles: of two linked sets, which have three quarters of either in common, these share one.

    levels: compressed, a byte for each of PLACES. The order is by level, then by value, and so the same for all sets.
    """

    def sign(s: np.ndarray) -> np.ndarray:
        level = _opened(levels)[(s & np.uint64(PLACES - 1)).astype(np.int64)]
        return s[np.argsort(level, kind="stable")[: len(s) // 4 + 1]] | np.uint64(1)  # s is sorted

    return sign


@functools.lru_cache(maxsize=1)
def _opened(levels: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(levels), np.uint8)


def frequent(sets: DataFrame, total: int, least: int = HEAVY) -> bytes:
    """For by_rarity(): the binary logarithm of how many of the sets have a shingle, where more than least do; else 0."""
    buckets = _buckets(sets.sparkSession, total, COUNTED)

    def whole(cids: list, stored: list) -> dict:
        return columns(PACKED, _pack(cids, [np.frombuffer(s, "<u8") for s in stored], buckets))

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append(v)
        for b in list(held):
            v, n = np.unique(np.frombuffer(b"".join(held.pop(b)), "<u4"), return_counts=True)
            v, n = v[n > least], n[n > least]
            yield pa.RecordBatch.from_arrays([pa.array((v & np.uint32(PLACES - 1)).astype(np.int32)), pa.array(np.log2(n).astype(np.int32))], names=["place", "level"])
        trimmed()

    packed = map_columns(sets, [F.col("cid"), F.col("set")], whole, "bucket int, ids binary, n binary, values binary")
    dealt = packed.select("bucket", "values").repartition(buckets, "bucket").mapInArrow(count, "place int, level int")
    got = dealt.groupBy("place").agg(F.max("level").alias("level")).toArrow()  # at most PLACES rows
    out = np.zeros(PLACES, np.uint8)
    out[got.column("place").to_numpy()] = got.column("level").to_numpy()
    return zlib.compress(out.tobytes())


def _meetings(sets: DataFrame, sign, total: int, mode: str, heavy_from: int) -> DataFrame:
    """Pairs a, b of cid that share a signature, could be linked by their sizes, and have different labels.

    sets: cid, n, u, set, label. Of n shingles u are in no other set, so that two sets have at most
    m = min(n - u) in common. mode 'best': for each set the hub, the smallest set of a signature, that it
    meets most often; 'star' and a number: one set of each label with a hub chosen by hash; 'all': every pair.
    Where more than heavy_from sets share a signature, the rows are heavy and only a forest over these sets.
    sign gives a set's signatures, whose last bit says whether it may be linked with sets that have it at 0; total is their number.
    """
    part = 1 if mode == "all" else ROUGH
    buckets = _buckets(sets.sparkSession, total // part)
    names = ("bucket", "ids", "labels", "sizes", "common", "n", "values")

    def emit(ids: list, sizes: list, alone: list, stored: list, labels: list):
        ids, labels, sizes, alone = (np.array(x, np.int64) for x in (ids, labels, sizes, alone))
        values, owner, held = [], [], 0
        for i, raw in enumerate(stored):
            v = sign(np.frombuffer(raw, "<u8"))
            v = v[(v >> np.uint64(8)) % np.uint64(part) == 0]
            values.append(v)
            owner.append(np.full(len(v), i))
            held += len(v)
            if held and (held > 500_000 or i == len(stored) - 1):
                rows = []
                for bucket, v, o in _deal(np.concatenate(values), np.concatenate(owner), buckets):
                    of, n = np.unique(o, return_counts=True)
                    rows.append((bucket, ids[of].tobytes(), labels[of].tobytes(), sizes[of].tobytes(), (sizes - alone)[of].tobytes(), n.astype("<u4").tobytes(), v.astype("<u8").tobytes()))
                yield columns(names, rows)
                values, owner, held = [], [], 0

    schema = "bucket int, ids binary, labels binary, sizes binary, common binary, n binary, values binary"
    packed = map_columns(sets, [F.col(c) for c in ("cid", "n", "u", "set", "label")], emit, schema).repartition(buckets, "bucket")

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append(row)
        for b in list(held):
            rows = held.pop(b)
            n = [np.frombuffer(r[4], "<u4") for r in rows]
            ids, labels, sizes, common = (np.concatenate([np.repeat(np.frombuffer(r[j], "<i8"), c) for r, c in zip(rows, n, strict=True)]) for j in range(4))
            v = np.concatenate([np.frombuffer(r[5], "<u8") for r in rows])
            del rows
            for x, y, heavy in _pairs(v, ids, labels, sizes, common, mode, heavy_from):
                pairs, count = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(count), pa.array(np.full(len(count), heavy))], names=["a", "b", "c", "heavy"])
        trimmed()

    found = packed.mapInArrow(meet, "a long, b long, c long, heavy boolean").groupBy("a", "b", "heavy").agg(F.sum("c").alias("c"))
    if mode == "best":
        return found.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b", F.lit(False).alias("heavy"))
    return found.select("a", "b", "heavy")


def could_link(n1, m1, n2, m2):
    """Whether sets of n shingles, of which others have m, can have a similarity of 3/4."""
    inter = np.minimum(m1, m2)
    return 100 * inter >= 75 * (n1 + n2 - inter)


def _pairs(v: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, common: np.ndarray, mode: str, heavy_from: int):
    """Arrays of pairs (hub or smaller, other) from a bucket's signatures, in batches."""
    sig = v >> np.uint64(1)
    if mode == "all":
        order = np.lexsort((ids, labels, sig))
    elif mode == "best":  # the smallest set of a signature is its hub: it is the likeliest to be contained in the others
        order = np.lexsort((ids, sizes, sig))
    else:  # another hub each time: that of the smallest hash
        order = np.lexsort((mix(ids.view(np.uint64) + np.uint64(int(_CH) * (int(mode[4:]) + 1) % (1 << 64))), sig))
    sig, v, ids, labels, sizes, common = (x[order] for x in (sig, v, ids, labels, sizes, common))
    native = (v & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.diff(sig.view(np.int64), prepend=sig.view(np.int64)[:1] - 1)) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    first, size = first[size > 1], size[size > 1]
    if mode != "all":
        hub = np.repeat(first, size)
        at = np.concatenate([np.arange(f, f + s) for f, s in zip(first.tolist(), size.tolist(), strict=True)]) if len(first) else np.empty(0, np.int64)
        ok = (labels[at] != labels[hub]) & (native[at] | native[hub]) & could_link(sizes[at], common[at], sizes[hub], common[hub])
        at, hub = at[ok], hub[ok]
        if mode != "best" and len(at):  # one set of each label meets the hub
            order = np.lexsort((labels[at], hub))
            at, hub = at[order], hub[order]
            new = np.append(True, (hub[1:] != hub[:-1]) | (labels[at[1:]] != labels[at[:-1]]))
            at, hub = at[new], hub[new]
        if len(at):
            yield ids[hub], ids[at], False
        return
    several = labels[first] != labels[first + size - 1]
    first, size = first[several], size[several]
    seen: set[bytes] = set()
    xs, ys, held = [], [], 0
    forest: dict[int, int] = {}

    def root(x: int) -> int:
        while forest.setdefault(x, x) != x:
            forest[x] = forest[forest[x]]
            x = forest[x]
        return x

    edges = []
    for f, s in zip(first.tolist(), size.tolist(), strict=True):
        span = slice(f, f + s)
        mark = hashlib.blake2b(ids[span].tobytes() + native[span].tobytes(), digest_size=16).digest()
        if mark in seen:  # another signature of the same sets
            continue
        seen.add(mark)
        i, l, z, m, nat = ids[span], labels[span], sizes[span], common[span], native[span]
        if s > heavy_from:
            different = i.tolist()
            for other in different[1:]:
                x, y = root(different[0]), root(other)
                if x != y:
                    forest[max(x, y)] = min(x, y)
                    edges.append((min(x, y), max(x, y)))
            continue
        for j in range(s - 1):
            ok = (l[j + 1 :] != l[j]) & (nat[j + 1 :] | nat[j]) & could_link(z[j + 1 :], m[j + 1 :], z[j], m[j])
            y = i[j + 1 :][ok]
            if len(y):
                xs.append(np.minimum(i[j], y))
                ys.append(np.maximum(i[j], y))
                held += len(y)
        if held > 500_000:
            yield np.concatenate(xs), np.concatenate(ys), False
            xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys), False
    if edges:
        x, y = np.array(edges, np.int64).T
        yield x, y, True


def tiled(sets: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """Links a, b between sets of different labels within groups that are too large for single pairs.

    groups: node, label of groups of sets. A group's sets are dealt into blocks of bounded size, and each
    pair of blocks is one task's work, which counts common shingles by their postings and gives only links.
    """
    of = sets.where(Slots(groups, "node", SLOTS).has(F.col("cid"))).join(groups.select(F.col("node").alias("cid"), F.col("label").alias("g")), "cid")
    size = of.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / tile), F.lit(1)).cast("int").alias("blocks"))
    held = of.join(size, "g").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "label", "n", "u", "set")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["i"].iloc[0])
        left = np.flatnonzero(pdf["own"].to_numpy() == first)
        right = np.flatnonzero(pdf["own"].to_numpy() == int(pdf["j"].iloc[0]))
        cid, label, n = (pdf[c].to_numpy() for c in ("cid", "label", "n"))
        m = n - pdf["u"].to_numpy()
        if not len(left) or not len(right):  # a block without sets
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        stored = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        out: list[np.ndarray] = []
        values = np.concatenate([stored[k] for k in right])
        owner = np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for k in left.tolist():
            ok = (label[right] != label[k]) & could_link(n[right], m[right], n[k], m[k])
            if not ok.any():
                continue
            a, b = np.searchsorted(values, stored[k], "left"), np.searchsorted(values, stored[k], "right")
            size = b - a
            places = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            inter = np.bincount(owner[places], minlength=len(right))
            ok &= 100 * inter >= 75 * (n[right] + n[k] - inter)
            hit = cid[right[ok]]
            if len(hit):
                out.append(np.stack([np.minimum(cid[k], hit), np.maximum(cid[k], hit)], 1))
        got = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return held.groupBy("g", "i", "j").applyInPandas(work, "a long, b long")


def of_nodes(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the sets that are an end of one of the edges a, b, as a table."""
    nodes = staged(edges.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "nodes")
    return staged(sets.where(Slots(nodes, "cid", SLOTS).has(F.col("cid"))).join(nodes.hint("merge"), "cid", "left_semi"), "crowd")


def labelled(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """sets with the label of their component; a set without links is its own."""
    if labels is None:
        return sets.select("cid", "n", "u", "set", F.col("cid").alias("label"))
    out = sets.join(labels.withColumnRenamed("node", "cid").hint("merge"), "cid", "left")
    return out.select("cid", "n", "u", "set", F.coalesce("label", "cid").alias("label"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets have a similarity of 3/4 or more. pairs: a table that can be read twice.

    A set that has more than MEMBERS pairs as a is sent several times, and these pairs are dealt over the copies.
    """
    some = sets.where(Slots(pairs.select(F.explode(F.array("a", "b")).alias("c")), "c", SLOTS).has(F.col("cid"))).select("cid", "set")
    salts = salted(staged(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs"), "a", "n", MEMBERS)
    left = some.join(pairs.select(F.col("a").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("a"), F.explode(F.sequence(F.lit(0), salts(F.col("cid")) - 1)).alias("salt"), F.col("set").alias("sa"))
    right = some.withColumnRenamed("cid", "b").withColumnRenamed("set", "sb").join(pairs.hint("merge"), "b").withColumn("salt", F.pmod(F.xxhash64("b"), salts(F.col("a"))).cast("int"))
    both = right.join(left.hint("merge"), ["a", "salt"])

    def verify(a: list, b: list, sa: list, sb: list) -> dict:
        keep = []
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            inter = int(np.count_nonzero(y[at] == x))
            if 100 * inter >= 75 * (len(x) + len(y) - inter):
                keep.append(i)
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return map_columns(both, [F.col(c) for c in ("a", "b", "sa", "sb")], verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that links reach, for every node of a table of links a, b."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        after = staged(best.join(jump, "best").select("node", F.col("label").alias("old"), F.least("best", "further").alias("label")), "labels")
        done = after.where(F.col("old") != F.col("label")).limit(1).count() == 0
        labels = after.select("node", "label")
        if done:
            return labels


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, tile: int = TILE, rows: bool = False) -> DataFrame:
    """key, n_shingles and component_id for every row of docs; with rows also r1, r2, the row's hashes, and component, a number that no other has."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = _buckets(spark, chars // 6 * SAMPLED // 16, COUNTED)
    scan = staged(scanned(docs, buckets, key, text), "scan")
    ids = staged(scan.where("bucket < 0").select(F.col("key").alias(key), "r1", "r2", "n_shingles", "s1", "s2"), "ids")
    classes = ids.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("n_shingles").alias("n"), F.min(key).alias("rep"), F.min(F.struct("r1", "r2")).alias("r"))
    alone = unshared(scan.where("bucket >= 0"), buckets).withColumnRenamed("id", "s1")
    survivors = classes.where("n >= 3").join(alone, "s1", "left").where("4 * coalesce(u, 0) <= n")
    survivors = staged(survivors.select("s1", "s2", "n", "rep", "r.r1", "r.r2"), "survivors")
    dropped(scan)
    # one row of each class brings the text, found by its own hash, whatever its key; rows without a slot stay where they are
    r1, r2 = hash128(F.col(key), F.col(text))
    wanted = Slots(survivors, "r1", SLOTS)
    texts = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(text).alias("t")).where(wanted.has(F.col("r1")))
    texts = texts.join(survivors.select("s1", "s2", "r1", "r2").hint("merge"), ["r1", "r2"])

    @starting
    def fetch():
        words = WordHash()

        def run(s1: list, ts: list) -> dict:
            return columns(("cid", "n", "set"), [(i, len(s), s.astype("<u8").tobytes()) for i, s in zip(s1, shingle_sets(ts, words, WIDTH), strict=True)])

        return run

    fetched = staged(map_columns(texts, [F.col("s1"), F.col("t")], fetch, "cid long, n long, set binary").dropDuplicates(["cid"]), "sets")
    held = fetched.agg(F.sum("n")).first()[0] or 0
    if not held:
        return _labelled(ids, classes, survivors, None, key, rows)

    def whole(cids: list, stored: list) -> dict:
        return columns(PACKED, _pack(cids, [np.frombuffer(s, "<u8") for s in stored], _buckets_of_sets))

    _buckets_of_sets = _buckets(spark, held, COUNTED)
    exact = unshared(map_columns(fetched, [F.col("cid"), F.col("set")], whole, "bucket int, ids binary, n binary, values binary"), _buckets_of_sets)
    sets = staged(fetched.join(exact.withColumnRenamed("id", "cid"), "cid", "left").withColumn("u", F.coalesce("u", F.lit(0))).where("4 * u <= n"), "sets")
    dropped(fetched)
    edges = [int(x) for x in _BANDS[:-1] if x < 1 << 31]
    band = F.expr("size(filter(array(" + ",".join(map(str, edges)) + "), e -> e < n))")
    per = {r["band"]: r["c"] for r in sets.groupBy("n").agg(F.count("*").alias("c")).groupBy(band.alias("band")).agg(F.sum("c").alias("c")).collect()}  # one row a band
    shapes = {b: choose(c + per.get(b - 1, 0)) for b, c in per.items()}
    weight = sum(c * 2.5 * int(_BANDS[b]) * 2 / 7 * math.comb(shapes[b][1], shapes[b][0]) / (shapes[b][0] + 1) for b, c in per.items())
    links, labels, tested = None, None, None
    for mode in ("best", *(f"star{i}" for i in range(STARS)), "all"):
        marked = labelled(sets, labels)
        met = staged(_meetings(marked, by_parts(shapes), int(weight), mode, heavy), "met")
        large = met.where("heavy").select("a", "b")
        crowded = mode == "all" and not large.isEmpty()
        if crowded:
            some = of_nodes(marked, large)
            total = some.agg(F.sum("n")).first()[0]
            closer = staged(_meetings(some, by_rarity(frequent(some, total, heavy)), total // 4, mode, heavy), "met")
            met, large = met.where("NOT heavy").unionByName(closer), closer.where("heavy").select("a", "b")
        pairs = met.where("NOT heavy").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = linked(pairs, sets)
        if crowded and not large.isEmpty():
            found = found.unionByName(tiled(some, components(large), tile))
        new = staged(found, "links")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    return _labelled(ids, classes, survivors, labels, key, rows)


def _labelled(ids: DataFrame, classes: DataFrame, survivors: DataFrame, labels: DataFrame | None, key: str, rows: bool) -> DataFrame:
    """Components' smallest keys, from labels of classes to rows."""
    if labels is not None:
        reps = labels.join(survivors.select(F.col("s1").alias("node"), "rep"), "node")
        least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
        joined = labels.join(least, "label").select(F.col("node").alias("s1"), "component_id", F.col("label").alias("component"))
        whole = classes.join(joined, "s1", "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "s1").alias("component"))
    else:
        whole = classes.select("s1", "s2", F.col("rep").alias("component_id"), F.col("s1").alias("component"))
    out = ids.join(whole, ["s1", "s2"], "left")
    least = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", key)).otherwise(F.col(key)).alias("component_id")
    return out.select(key, "n_shingles", least, *(["r1", "r2", "component"] if rows else []))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest key.

    Rows without shingles all stay; rows with one key and text are one document and stay together; of a
    component without any key the rows with the smallest hash stay. Other columns pass through, whatever their names.
    """
    found = join(docs, key, text, rows=True)
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col(key).isNull(), key, "r1", "r2")).alias("f"))
    kept = first.select("f.r1", "f.r2").unionByName(found.where("n_shingles = 0").select("r1", "r2"))
    gone = staged(found.select("r1", "r2").distinct().join(kept.hint("merge"), ["r1", "r2"], "left_anti"), "gone")
    slots = Slots(gone, "r1", SLOTS)
    r1, r2 = hash128(F.col(key), F.col(text))
    held = nested(docs, r1=r1, r2=r2)
    maybe = held.where(slots.has(F.col("r1"))).join(gone.hint("merge"), ["r1", "r2"], "left_anti")
    return flattened(held.where(~slots.has(F.col("r1"))).unionByName(maybe), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS least FROM r GROUP BY 1) m ON d.doc_id = m.a
"""
