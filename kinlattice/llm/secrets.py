r"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Base patterns (all leftmost and non-overlapping within their kind, matches that are too short dropped):

    assign  a name such as password or api_key, a sign, and a value of 8 or more characters
    access  AKIA and capital letters or digits, 16 or more characters
    hex     lower-case hexadecimal digits, 32 or more

The method adds, per character class, candidates: maximal runs of the class of at least WINDOW
characters. A window slides over a candidate; the sum of n log n over its character counts is updated
by the character that comes and the one that goes, which gives each window's entropy. Windows at or
above the class's threshold are joined where they overlap.

    entropy_hex  hexadecimal digits of either case, 3.0 bits a character
    entropy_b64  letters, digits, + / = _ -, 3.75 bits a character

The allow-list suppresses what is no secret: well-known placeholders and runs that count up the alphabet or
digits are cut out of a candidate, so that no window touches one and what stands beside it is still
searched; candidates without a digit or without a letter and UUIDs go. Base spans stay.

DataFrame functions only. Spans are code points, end exclusive. Defined cases: null text is empty and
has no span; the same string matched by several kinds gives a span of each, ties in start go by kind as
listed; repeated rows give repeated results; very long texts are scanned whole, in time that grows with
their length; an empty table gives no row; other columns pass through, but one named as the spans'
column, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 20
# fixed values: patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same as AKIA[A-Z0-9]+ of 16 or more: a run has one maximal match, and parts of it are shorter
HEX = r"[0-9a-f]{32,}"
CLASSES = [("entropy_hex", r"[0-9A-Fa-f]{20,}", 3.0), ("entropy_b64", r"[A-Za-z0-9+/=_-]{20,}", 3.75)]
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_b64"]
ALLOWED = [
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
]
PLACEHOLDER = r"(?i:0123456789|abcdefghij|example|placeholder|changeme|xxxxxxxx|deadbeef)"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
BLOCK = 256


def running(sizes: Column) -> Column:
    """For each element the sum of those before it. An array grows within a block only, so that no long one is copied again and again."""

    def sums(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, BLOCK))
    whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.zip_with(blocks, sums(whole, F.lit(0)), sums)))


def pieces(text: Column, pattern: str) -> Column:
    """What a pattern's matches leave and the match after each: array<struct<start, gap, match>>, match null at the end."""
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    sizes = F.transform(both, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
    return F.zip_with(both, running(sizes), lambda p, at: F.struct(at.alias("start"), p["gap"].alias("gap"), p["match"].alias("match")))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of spans of a pattern: what splitting leaves between the matches gives their places."""

    def span(p: Column) -> Column:
        start = p["start"] + F.length(p["gap"])
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["match"])).alias("end"), p["match"].alias("value"))

    found = F.transform(F.filter(pieces(text, pattern), lambda p: p["match"].isNotNull()), span)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def allowed(value: Column) -> Column:
    out = F.lit(False)
    for p in ALLOWED:
        out = out | value.rlike(p)
    return out


def entropy_spans(value: Column, threshold: float, window: int = WINDOW) -> Column:
    """Joined windows of a string with at least threshold bits a character: array<struct<start,end>>.

    The counts are kept for the string's distinct characters; sum is that of n log2 n over a window.
    """
    chars = F.split(value, "")
    kinds = F.array_distinct(chars)
    ids = F.transform(chars, lambda c: F.array_position(kinds, c))
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(
        F.transform(kinds, lambda c: F.lit(0)).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("i"),
        none.alias("out"),
        F.lit(-1).alias("start"),  # of the span that is still open, -1 if there is none
        F.lit(-1).alias("end"),
        ids.alias("ids"),
    )

    def nlog(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)

    def closed(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))

    def step(a: Column, new: Column) -> Column:
        old = F.when(a["i"] >= window, F.get(a["ids"], a["i"] - window)).otherwise(F.lit(0))
        before_new = F.get(a["n"], (new - 1).cast("int"))
        less = F.when(old > 0, F.get(a["n"], (old - 1).cast("int"))).otherwise(F.lit(0))
        # the character that goes leaves first, the one that comes enters after it
        out_of = F.when(old > 0, nlog(less - 1) - nlog(less)).otherwise(0.0)
        held = before_new - F.when(old == new, 1).otherwise(0)
        total = a["sum"] + out_of + nlog(held + 1) - nlog(held)
        n = F.transform(a["n"], lambda x, k: x + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0))
        i = a["i"] + 1
        high = (i >= window) & (math.log2(window) - total / window >= threshold - 1e-9)
        joins = (a["end"] >= 0) & (i - window <= a["end"])
        return F.struct(
            n.alias("n"),
            total.alias("sum"),
            i.alias("i"),
            F.when(high & ~joins & (a["end"] >= 0), closed(a)).otherwise(a["out"]).alias("out"),
            F.when(high & ~joins, i - window).otherwise(a["start"]).alias("start"),
            F.when(high, i).otherwise(a["end"]).alias("end"),
            a["ids"].alias("ids"),
        )

    return F.aggregate(ids, zero, step, lambda a: F.when(a["end"] >= 0, closed(a)).otherwise(a["out"]))


def _windows(text: Column, kind: str, pattern: str, threshold: float) -> Column:
    """Spans of one character class: the joined windows of its candidates, without what the allow-list takes out."""

    def searched(c: Column) -> Column:
        """The parts of a candidate between placeholders, where they are long enough for a window."""
        whole = F.array(F.struct(F.lit(0).alias("start"), c["value"].alias("gap"), F.lit(None).cast("string").alias("match")))
        parts = F.when(c["value"].rlike(PLACEHOLDER), pieces(c["value"], PLACEHOLDER)).otherwise(whole)
        kept = F.filter(parts, lambda p: (F.length(p["gap"]) >= WINDOW) & ~allowed(p["gap"]))
        return F.transform(kept, lambda p: F.struct((c["start"] + p["start"]).alias("start"), p["gap"].alias("value")))

    def placed(s: Column) -> Column:
        def span(e: Column) -> Column:
            value = F.substr(s["value"], e["start"] + 1, e["end"] - e["start"])
            return F.struct(F.lit(kind).alias("kind"), (s["start"] + e["start"]).alias("start"), (s["start"] + e["end"]).alias("end"), value.alias("value"))

        return F.transform(entropy_spans(s["value"], threshold), span)

    candidates = F.filter(matches(text, pattern, kind), lambda s: ~allowed(s["value"]))
    return F.flatten(F.transform(F.flatten(F.transform(candidates, searched)), placed))


def scan(docs: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """Add an array of spans struct(kind, start, end, value), by start and then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    base = F.concat(
        F.filter(matches(t, ASSIGN, "assign"), lambda s: F.length(value(s)) >= ASSIGN_VALUE),
        matches(t, ACCESS, "access"),
        matches(t, HEX, "hex"),
    )
    added = [_windows(t, *c) for c in CLASSES]
    return docs.withColumn(into, _ordered(F.concat(base, *added)))


def _ordered(spans: Column) -> Column:
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame, spans: str = "secret_spans") -> DataFrame:
    s = F.col(spans)
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["kind"].isin("assign", "access", "hex"))).cast("binary"), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    # the spans are put in a column of their own first, so that they are made once a row
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
