"""Benchmark decontamination: SimHash over item-sized windows, then exact weighted-shingle similarity.

Words are runs of letters and digits in lower case; shingles are WIDTH consecutive words (all words of
an item that has fewer). For an item of w words a window is w consecutive words of a document, or the
whole document where it is shorter.

1. Seeds: places of a document's shingles that are an item's, with that item. A map of fixed size tells
   which hashes can be an item's, so that the others end in the task that read the text. A pair of that
   similarity has a least number of shingles in common, so only windows with as many seeds of one item
   go on; a window meets only items that it can match.
2. Of documents with such windows the shingle hashes are fetched; texts are never shuffled.
3. Each such window gets a SimHash of 64 bits in which every shingle votes by its frequency. Votes roll
   from window to window: the shingle that comes adds its votes, the one that goes takes them back.
4. Multi-index blocks: 64 bits are cut into RADIUS + 1 blocks, and a window and its item meet in the
   first block on which they agree; by the pigeonhole principle no pair within RADIUS is missed.
   Fingerprints are estimates, so like texts can differ by more bits, above all where repeated shingles
   vote often: what lies beyond RADIUS goes to the same verification as an exact way for the rest.
5. Verification: the sum of the smaller frequencies over the sum of the larger ones, over all shingles
   of both, must be SIMILARITY or more. The sum of the smaller ones is a running count: the place of a
   shingle that the item has c times counts for the windows that hold it, but not the c-th such place before it.

DataFrame functions only. The items' shingles are broadcast only up to BROADCAST_ROWS counted rows, beyond
that they are joined by a shuffle. All steps take time in proportion to seeds and windows. Defined cases:
null or empty texts and items match nothing; repeated rows of a document count once; equal items are
reported each; ties take the first window; very long texts and items are like any; empty tables give no
match; other columns pass through (clean), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Slots, flattened, hash128, nested, staged, table

WIDTH = 5
SIMILARITY = 0.75
RADIUS = 15
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, width: int) -> Column:
    """Hashes of the shingles of an array of words, in order; none where it has fewer words."""
    none = F.array().cast("array<bigint>")

    def made(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(none)

    return let(words, made)


LANES = "4294967297L"  # bits 0 and 32: each of 32 longs counts the votes of bits k and k + 32
_FINGERPRINT = """aggregate(sequence(0, 31), 0L, (r, k) -> r
    | if(2 * ({v}[k] & 4294967295L) > {n}, shiftleft(1L, k), 0L)
    | if(2 * shiftrightunsigned({v}[k], 32) > {n}, shiftleft(1L, k + 32), 0L))"""
_VOTES = "aggregate({hs}, array_repeat(0L, 32), (a, h) -> transform(a, (x, k) -> x + (shiftrightunsigned(h, k) & " + LANES + ")))"


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array of hashes: every element votes once for each bit; lanes hold 2^31 votes."""
    return F.expr(f"aggregate(array({_VOTES.format(hs=hashes)}), 0L, (z, v) -> {_FINGERPRINT.format(v='v', n=f'size({hashes})')})")


def rolling(hashes: str, span: str) -> Column:
    """SimHashes of all windows of span elements of an array of at least as many, in order."""
    move = f"transform(s.v, (x, k) -> x + (shiftrightunsigned({hashes}[i + {span}], k) & {LANES}) - (shiftrightunsigned({hashes}[i], k) & {LANES}))"
    first = _VOTES.format(hs=f"slice({hashes}, 1, {span})")
    steps = f"if(size({hashes}) > {span}, sequence(0, size({hashes}) - {span} - 1), array())"
    step = f"aggregate(array({move}), s, (z, v) -> named_struct('v', v, 'out', concat(s.out, array({_FINGERPRINT.format(v='v', n=span)}))))"
    zero = f"aggregate(array({first}), named_struct('v', array_repeat(0L, 32), 'out', array(0L)), (z, v) -> named_struct('v', v, 'out', array({_FINGERPRINT.format(v='v', n=span)})))"
    return F.expr(f"aggregate({steps}, {zero}, (s, i) -> {step}, s -> s.out)")


def block_masks(radius: int = RADIUS) -> list[int]:
    """radius + 1 masks that share out 64 bits, as signed longs."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, n_words, k (shingle width) and item_hashes; items without words are left out."""
    w = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    own = F.lit(None).cast("array<bigint>")
    for k in range(1, WIDTH + 1):
        own = F.when(F.least(F.size("w"), F.lit(WIDTH)) == k, shingles(F.col("w"), k)).otherwise(own)
    return w.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(WIDTH)).alias("k"), own.alias("item_hashes"))


PAIR = ["r1", "r2", "item_id"]


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item with a window of that similarity: the best window.

    Columns: the key, r1 and r2 (the document's row hashes), item_id, similarity, start_word,
    window_words and n_windows. A benchmark is a stated query set; its rows are counted first.
    """
    items = staged(items_of(benchmark), "items")
    sizes = items.groupBy("k").agg(F.sum(F.size("item_hashes")).alias("n")).collect()  # at most WIDTH rows
    small = sum(r["n"] for r in sizes) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    r1, r2 = hash128(F.col(key), F.col(text))
    held = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"), r1.alias("r1"), r2.alias("r2"))
    parts = [_of_width(held, items.where(F.col("k") == k), k, hint, similarity, radius) for k in sorted(r["k"] for r in sizes)]
    if not parts:
        columns = "r1 long, r2 long, item_id long, similarity double, start_word long, window_words long, n_windows long"
        return docs.sparkSession.createDataFrame([], columns).withColumn(key, F.lit(None).cast("long")).select(key, *[c.split()[0] for c in columns.split(", ")])
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumnRenamed("key", key)


def seeds(held: DataFrame, items: DataFrame, k: int, hint) -> DataFrame:
    """r1, r2, item_id, pos, h: places of items' shingles; with n and m, the shingles of document and item, and c, h's in the item."""
    of = items.select("item_id", F.size("item_hashes").alias("m"), F.explode("item_hashes").alias("h")).groupBy("item_id", "m", "h").agg(F.count("*").alias("c"))
    own = held.select("r1", "r2", shingles(words_of(F.col("t")), k).alias("hs"))
    at = own.select("r1", "r2", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    return at.where(Slots(of, "h").has(F.col("h"))).join(hint(of), "h")


def common(found: DataFrame, span: Column) -> DataFrame:
    """r1, r2, item_id, start, end (exclusive), inter: windows that start there have that sum of smaller frequencies (where it is over 0)."""
    places = found.groupBy(*PAIR, "h").agg(F.sort_array(F.collect_list("pos")).alias("ps"), F.first("c").cast("int").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    places = places.withColumn("span", span)
    spans = F.expr("transform(ps, (p, i) -> struct(greatest(if(i >= c, ps[greatest(i - c, 0)] + 1, 0), p - span + 1, 0) AS a, least(p, n - span) + 1 AS b))")
    steps = places.select(*PAIR, F.explode(F.filter(spans, lambda x: x["a"] < x["b"])).alias("x"))
    events = steps.select(*PAIR, F.inline(F.expr("array(struct(x.a AS start, 1 AS d), struct(x.b AS start, -1 AS d))"))).groupBy(*PAIR, "start").agg(F.sum("d").alias("d"))
    by = Window.partitionBy(*PAIR).orderBy("start")
    runs = events.select(*PAIR, "start", F.lead("start").over(by).alias("end"), F.sum("d").over(by).alias("inter"))
    return runs.where((F.col("inter") > 0) & F.col("end").isNotNull())


def _of_width(held: DataFrame, items: DataFrame, k: int, hint, similarity: float, radius: int) -> DataFrame:
    span = F.least("n", "m")  # shingles in a window
    # shingles in common that this similarity takes, of span and m
    need = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (F.least("n", "m") + F.col("m")) - 1e-6).cast("int"))
    found = staged(seeds(held, items, k, hint).repartition(*PAIR).dropDuplicates([*PAIR, "pos"]), "seeds")

    # starts whose window holds as many seeds, in runs and these in blocks, each with the shingles of its windows
    pairs = found.groupBy(*PAIR, "n", "m").agg(F.sort_array(F.collect_list("pos")).alias("ps")).withColumns({"need": need, "span": span}).where("size(ps) >= need")
    pairs = staged(pairs, "pairs")
    own = held.where(Slots(pairs, "r1").has(F.col("r1"))).select("key", "r1", "r2", shingles(words_of(F.col("t")), k).alias("hs"))
    hits = staged(own.groupBy("r1", "r2").agg(F.first("key").alias("key"), F.first("hs").alias("hs")), "hits")
    runs = "filter(transform(ps, (p, i) -> struct(greatest(0, get(ps, i + need - 1) - span + 1) AS a, least(p, n - span) AS b, i + need <= size(ps) AS has)), r -> r.has AND r.a <= r.b)"
    one = pairs.select(*PAIR, "m", "span", F.inline(F.expr(runs))).drop("has")
    by = Window.partitionBy(*PAIR).orderBy("a", "b")
    before = F.coalesce(F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    # runs of neighbouring seeds overlap: they become one, so that a shingle's votes are counted for few blocks
    one = one.withColumn("new", (F.col("a") > before + 1).cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = one.groupBy(*PAIR, "m", "span", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cut = one.withColumn("a", F.explode(F.expr("sequence(a, b, greatest(64, span))"))).withColumn("b", F.least(F.col("b"), F.col("a") + F.greatest(F.lit(64), "span") - 1))
    block = cut.join(hits.select("r1", "r2", "hs"), ["r1", "r2"]).withColumn("hs", F.expr("slice(hs, a + 1, b - a + span)"))
    wins = block.select(*PAIR, "a", F.posexplode(rolling("hs", "span")).alias("i", "fp")).select(*PAIR, (F.col("a") + F.col("i")).alias("start"), "fp")

    masks = F.array(*[F.lit(m) for m in block_masks(radius)])

    def keyed(df: DataFrame) -> DataFrame:
        """A row for each block of the fingerprint, and one of block -1 for the way beyond the radius."""
        cut = F.transform(masks, lambda m, i: F.struct(i.alias("block"), F.col("fp").bitwiseAND(m).alias("value")))
        return df.select(*df.columns, F.inline(F.concat(cut, F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("value"))))))

    prints = keyed(items.select("item_id", simhash("item_hashes").alias("fp"))).withColumnRenamed("fp", "item_fp")
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = keyed(wins).join(hint(prints), ["item_id", "block", "value"])
    first = F.array_position(F.transform(masks, lambda m: differ.bitwiseAND(m) == 0), F.lit(True)) - 1
    met = met.where(F.when(F.col("block") >= 0, (F.bit_count(differ) <= radius) & (first == F.col("block"))).otherwise(F.bit_count(differ) > radius))

    exact = common(found, span).withColumn("start", F.explode(F.expr("sequence(start, end - 1)"))).select(*PAIR, "start", "inter")
    size = pairs.select(*PAIR, "n", "m", "span")
    inter = F.col("inter")
    scored = met.join(exact, [*PAIR, "start"]).join(size, PAIR).withColumn("similarity", inter / (F.col("span") + F.col("m") - inter)).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "start", "span"), F.struct("similarity", -F.col("start"))).alias("b")
    out = scored.groupBy(*PAIR).agg(best, F.count("*").alias("n_windows")).join(hits.select("r1", "r2", "key"), ["r1", "r2"])
    return out.select(
        "key",
        *PAIR,
        F.col("b.similarity").alias("similarity"),
        F.col("b.start").cast("long").alias("start_word"),
        (F.col("b.span") + (k - 1)).cast("long").alias("window_words"),
        "n_windows",
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a window like an item; the same columns. Only rows whose slot is that of such a row are shuffled."""
    r1, r2 = hash128(F.col(key), F.col(text))
    bad = staged(matches(docs, benchmark, key=key, text=text).select("r1", "r2").distinct(), "matched")
    slots = Slots(bad, "r1")
    held = nested(docs, r1=r1, r2=r2)
    maybe = held.where(slots.has(F.col("r1"))).join(bad, ["r1", "r2"], "left_anti")
    return flattened(held.where(~slots.has(F.col("r1"))).unionByName(maybe), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = matches(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "window_words", "n_windows")


# every window by brute force; items of five words or more, which all items of the driver's tables have
ORACLE = r"""
WITH d AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, text, list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) AS s FROM d WHERE len(w) >= 5
), its AS (
  SELECT item_id, list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) AS s FROM i WHERE len(w) >= 5
), du AS (
  SELECT doc_id, text, unnest(s) AS g FROM ds
), iu AS (
  SELECT item_id, unnest(s) AS g FROM its
), c AS (
  SELECT DISTINCT du.doc_id, du.text, iu.item_id FROM du JOIN iu ON du.g = iu.g
), win AS (
  SELECT c.doc_id, c.text, c.item_id, least(len(its.s), len(ds.s)) AS size, len(its.s) AS want, ds.s, unnest(range(0, len(ds.s) - least(len(its.s), len(ds.s)) + 1)) AS start
  FROM c JOIN ds ON c.doc_id = ds.doc_id AND c.text = ds.text JOIN its ON c.item_id = its.item_id
), wu AS (
  SELECT doc_id, text, item_id, start, size, want, unnest(s[start + 1:start + size]) AS g FROM win
), wc AS (
  SELECT doc_id, text, item_id, start, size, want, g, count(*) AS n FROM wu GROUP BY ALL
), ic AS (
  SELECT item_id, g, count(*) AS n FROM iu GROUP BY ALL
), sim AS (
  SELECT doc_id, text, wc.item_id, start, size, sum(least(wc.n, ic.n)) / (size + want - sum(least(wc.n, ic.n))) AS sim
  FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.g = ic.g GROUP BY doc_id, text, wc.item_id, start, size, want
)
SELECT doc_id, item_id, round(max(sim), 6) AS similarity, arg_min(start, (-sim, start))::BIGINT AS start_word, (any_value(size) + 4)::BIGINT AS window_words, count(*)::BIGINT AS n_windows
FROM sim WHERE sim >= 0.75 GROUP BY doc_id, text, item_id
"""
