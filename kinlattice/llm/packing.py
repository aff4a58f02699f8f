"""Packing: documents into fixed-length sequences by shortest-pack-first over the length histogram.

A document's ids are cut at multiples of the sequence length; the histogram of piece lengths has as
many bins as the length has tokens, so it and the packing patterns are of bounded size whatever the
corpus. Lengths are placed longest first, always into the shortest pack that stands; what is updated
is how often each pattern of lengths occurs. Patterns come back to the pieces by rank: among pieces
of one length, the r-th takes the r-th place that the patterns have for that length.

Defined cases: null text is empty, and a document without text is its end token alone; a null key is
a document of its own; repeated rows are packed once each; ties in rank are broken by the document's
key, a hash of its ids and the start; very long texts are cut into words a segment at a time, and no
piece is longer than a sequence; an empty table gives no row; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keeping, kept, map_columns, staged, table

LENGTH = 1024
END = 0
REMEMBERED = 100_000  # words whose ids a worker keeps
LONGEST = 48  # characters of a word that is kept
SEGMENT = 1 << 20  # characters that are cut into words at a time
_CUT = re.compile(r"(?= \S)")
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_ODD = re.compile(r" (?=\s|\Z)")


def _signs() -> dict[int, int]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for signs from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


_SIGNS = _signs()


class Encoder:
    """Texts to ids by a tokenizers file, each distinct word once.

    Byte-level BPE first cuts a text into words that may begin with one space, so that a space before
    another sign always begins a new word, and merges never cross. A text is cut there, the library
    encodes the parts that are not remembered, and a text's ids are its parts' ids in a row.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}  # ids of a space and the word, for the words that came first: mostly the frequent ones

        # bytes that each id stands for: one for each sign of its token, in the byte-level alphabet
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)

    def ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def words(self, parts: list[str]) -> list[bytes]:
        """ids() of words, each after a space: they go to the library as one text, whose ids are dealt out by their numbers of bytes."""
        out: list[bytes] = []
        if parts and _LETTERS.fullmatch(parts[0]):  # a space and letters are one word of the pattern: it needs no cutting
            tokenize = self.tokenizer.model.tokenize
            return [array("I", [t.id for t in tokenize("\u0120" + (w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(_SIGNS)))]).tobytes() for w in parts]
        for at in range(0, len(parts), 10_000):
            some = parts[at : at + 10_000]
            raw = self.ids([" " + " ".join(some)])[0]
            held = np.cumsum(self.bytes[np.frombuffer(raw, "<u4")])
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode("utf-8")) for w in some]) + np.arange(1, len(some) + 1)
            stops = (4 * (np.searchsorted(held, ends) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [[p[i > 0 :] for i, p in enumerate(_CUT.split(t))] if _ODD.search(t) else t.split(" ") for t in texts]
        heads = self.ids([c[0] for c in cut])
        tails = [c[1:] for c in cut]
        got = [list(map(self.known.get, t)) for t in tails]
        new = list({w for t, g in zip(tails, got, strict=True) if None in g for w, i in zip(t, g, strict=True) if i is None})
        if new:
            plain, rest = [w for w in new if _LETTERS.fullmatch(w)], [w for w in new if not _LETTERS.fullmatch(w)]
            found = dict(zip(plain + rest, self.words(plain) + self.words(rest), strict=True))
            for t, g in zip(tails, got, strict=True):
                if None in g:
                    g[:] = [found[w] if i is None else i for w, i in zip(t, g, strict=True)]
            room = max(0, REMEMBERED - len(self.known))
            self.known.update([(w, i) for w, i in found.items() if len(w) <= LONGEST][:room])
        return [h + b"".join(g) for h, g in zip(heads, got, strict=True)]

    def __call__(self, texts: list) -> list[bytes]:
        """For each text its ids as unsigned little-endian 32-bit numbers; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def settle() -> None:
            nonlocal held, size
            for (i, _), ids in zip(held, self._encode([t for _, t in held]), strict=True):
                out[i] += ids
            held, size = [], 0

        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                end = len(t)
                if end - at > SEGMENT:
                    stop = _CUT.search(t, at + SEGMENT)
                    end = stop.start() if stop else end
                held.append((i, t[at:end]))
                size += end - at
                at = end
                if size >= SEGMENT:
                    settle()
        if held:
            settle()
        return out


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


kept.append(encoder)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, vocabulary: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens and text_hash (one value for equal documents)."""

    names = ["start", "length", "ids_crc32", "doc_tokens", "text_hash"]
    end = np.array([END], "<u4").tobytes()

    @keeping
    def pieces(keys: list, texts: list) -> dict:
        of, rows = [], []
        for k, raw in zip(keys, encoder(vocabulary)(texts), strict=True):
            raw += end
            whole = zlib.crc32(raw)
            for s in range(0, len(raw), 4 * length):
                part = raw[s : s + 4 * length]
                of.append(k)
                rows.append((s // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, whole))
        return {key: of, **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

    return map_columns(docs, [F.col(key).cast("long"), F.col(text)], pieces, f"`{key}` long, " + ", ".join(f"{n} long" for n in names))


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each occurs; the histogram gives how many pieces have a length.

    Lengths go longest first into the shortest pack at that moment. All packs of one pattern move
    together, so the work depends on the number of bins and not on the number of pieces.
    """
    heap: list[tuple[int, int, tuple[int, ...], int]] = []
    serial = 0
    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        moved = []
        while left:
            if heap and heap[0][0] + size <= length:
                total, _, pattern, count = heapq.heappop(heap)
                n = min(left, count)
                if count > n:
                    heapq.heappush(heap, (total, serial, pattern, count - n))
                    serial += 1
            else:
                total, pattern, n = 0, (), left
                fit = length // size
                if fit > 1:  # the next packs would take these one after another
                    full, rest = divmod(left, fit)
                    if full:
                        moved.append((fit * size, (size,) * fit, full))
                    if rest:
                        moved.append((rest * size, (size,) * rest, 1))
                    left = 0
                    continue
            left -= n
            moved.append((total + size, (*pattern, size), n))
            if total + 2 * size <= length:  # this pack may be the shortest again
                t, p, c = moved.pop()
                heapq.heappush(heap, (t, serial, p, c))
                serial += 1
        for t, p, c in moved:
            heapq.heappush(heap, (t, serial, p, c))
            serial += 1
    patterns: dict[tuple[int, ...], int] = {}
    for _, _, pattern, count in heap:
        patterns[pattern] = patterns.get(pattern, 0) + count
    return sorted(patterns.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, rank ranges: rank_from, rank_to (exclusive), first_sequence, per_sequence, base and width.

    A pattern that holds a length m times in a row gives ranks m to a sequence: rank r lies in
    sequence first_sequence + (r - rank_from) // m, at base + ((r - rank_from) % m) * length.
    """
    rows, used, sequence = [], {}, 0
    for pattern, count in patterns:
        at, i = 0, 0
        while i < len(pattern):
            size, m = pattern[i], 1
            while i + m < len(pattern) and pattern[i + m] == size:
                m += 1
            start = used.get(size, 0)
            rows.append((size, start, start + m * count, sequence, m, at))
            used[size] = start + m * count
            at, i = at + m * size, i + m
        sequence += count
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "first_sequence", "per_sequence", "base"]).astype("int64")


def pack(pieces: DataFrame, length: int = LENGTH, key: str = "doc_id", group_rows: int = 50_000) -> DataFrame:
    """Give each piece a sequence_id and an offset. pieces: a table that can be read twice, as cut() makes it.

    Ranks are counted in groups of a length and a hash bucket, of about group_rows pieces at most, and
    the groups' counts are summed up; no task sees all pieces of a common length.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(1, -(-n // group_rows))
    held = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "start", "text_hash"), F.lit(buckets)))
    per = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as a sequence has tokens
    slots = places(shortest_pack_first(totals, length))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy(key, "text_hash", "start", "ids_crc32")
    ranked = held.withColumn("local", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))
    ranges = spark.createDataFrame(slots, "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, base long") if len(slots) else spark.createDataFrame([], "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, base long")
    # as many rows as patterns have runs, which the number of bins bounds
    found = ranked.join(F.broadcast(ranges), (ranked["length"] == ranges["length"]) & (ranked["rank"] >= ranges["rank_from"]) & (ranked["rank"] < ranges["rank_to"])).drop(ranges["length"])
    r = F.col("rank") - F.col("rank_from")
    return found.select(
        key,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(r / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(r, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    return pack(staged(cut(docs, vocabulary or default_vocabulary(), length), "pieces"), length)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
