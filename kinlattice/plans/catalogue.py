"""Named queries over the driver's tables, and the same queries in DuckDB SQL.

Each applies one operator of this package to a driver table that stands for its domain: order lines are
hits, return flags are paralogs, documents are sequences, events are intervals.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, text
from ..functions.patterns import build_patterns, nickname
from ..operators import alignment, ancestors, budgets, dedup, intervals, models, posterior, search, taxonomy, trees, validate

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


NAMES = ["A", "N", "R"]
_COMBOS = [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
_SCORED = ", ".join("{'p': " + " + ".join(f"post_{NAMES[i]}" for i in c) + f", 'i': {k}}}" for k, c in enumerate(_COMBOS))
_TITLES = ", ".join("'" + "/".join(NAMES[i] for i in c) + "'" for c in _COMBOS)


def _posts(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return posterior.shares(lines, "l_orderkey", "l_quantity", {n: F.col("l_returnflag") == n for n in NAMES})


_POSTS = """SELECT l_orderkey, """ + ", ".join(f"sum(CASE WHEN l_returnflag = '{n}' THEN pow(2, l_quantity) ELSE 0 END) / sum(pow(2, l_quantity)) AS post_{n}" for n in NAMES) + " FROM lineitem GROUP BY 1"
_WALK = f"""
WITH p AS ({_POSTS}), s AS (
  SELECT *, list_reverse_sort([{_SCORED}]) AS scored FROM p
), b AS (
  SELECT *, list_reduce(scored, lambda a, x: CASE WHEN abs(a.p) > 1e-8 AND x.p / a.p > 0.9 THEN x ELSE a END) AS best FROM s
)"""


@query(f"""{_WALK}
SELECT l_orderkey, round(post_A, 6) AS post_A, round(post_N, 6) AS post_N, round(post_R, 6) AS post_R,
  CASE WHEN best.p > 0.95 THEN ([{_TITLES}])[best.i + 1] END AS paralog, best.p > 0.95 AS found FROM b""")
def paralog_posterior(spark, d):
    called = posterior.call(_posts(spark, d), NAMES)
    return called.select("l_orderkey", *[r6(F.col(f"post_{n}")).alias(f"post_{n}") for n in NAMES], "paralog", "found")


@query(f"""{_WALK}
SELECT coalesce(CASE WHEN best.p > 0.95 THEN ([{_TITLES}])[best.i + 1] END, 'rejected') AS paralog, count(*)::BIGINT AS n, round(sum(best.p), 4) AS total FROM b GROUP BY 1""")
def posterior_accept(spark, d):
    called = posterior.call(_posts(spark, d), NAMES)
    return called.groupBy(F.coalesce("paralog", F.lit("rejected")).alias("paralog")).agg(F.count("*").alias("n"), F.round(F.sum("prob"), 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + floor(value * 1000000)::BIGINT AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(s) AS first_us, max(e) AS last_us, count(*)::BIGINT AS n, string_agg(event_id::VARCHAR, ';' ORDER BY event_id) AS members FROM i GROUP BY user_id, island""")
def interval_merge(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("user_id", "event_id", us.alias("s"), (us + F.floor(F.col("value") * 1000000).cast("long")).alias("e"))
    found = intervals.islands(rows, ["user_id"], "s", "e").groupBy("user_id", "island")
    return found.agg(F.min("s").alias("first_us"), F.max("e").alias("last_us"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("event_id")), ";").alias("members")).drop("island")


@query("""
WITH m AS (SELECT l_partkey, l_orderkey AS s, l_orderkey + floor(l_quantity * 20)::BIGINT AS e,
  max(l_orderkey + floor(l_quantity * 20)::BIGINT) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_orderkey + floor(l_quantity * 20)::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_partkey, min(s)::BIGINT AS first_key, max(e)::BIGINT AS last_key, count(*)::BIGINT AS n FROM i GROUP BY l_partkey, island""")
def interval_merge_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.floor(F.col("l_quantity") * 20)).cast("long").alias("e"))
    return intervals.islands(rows, ["l_partkey"], "s", "e").groupBy("l_partkey", "island").agg(F.min("s").alias("first_key"), F.max("e").alias("last_key"), F.count("*").alias("n")).drop("island")


@query("""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events)
SELECT user_id, event_type AS value, min(place)::BIGINT AS start, count(*)::BIGINT AS length FROM w GROUP BY user_id, event_type, g""")
def rle_runs(spark, d):
    runs = alignment.run_lengths(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.select("user_id", "value", F.col("start").cast("long").alias("start"), "length")


@query(r"""
SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS stripped_md5, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS stripped_chars,
  count(*) OVER (PARTITION BY text) > 1 AS repeated, CASE WHEN regexp_matches(lang, '(?i)[1yt]') AND NOT regexp_matches(lang, '(?i)[0nf]') THEN true
  WHEN regexp_matches(lang, '(?i)[0nf]') AND NOT regexp_matches(lang, '(?i)[1yt]') THEN false END AS lang_flag
FROM documents WHERE coalesce(nullif(trim(text), ''), nullif(trim(lang), ''), nullif(trim(source), '')) IS NOT NULL""")
def validate_core(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.where(~validate.blank(docs.drop("doc_id")))
    often = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    stripped = F.regexp_replace("text", r"[\t\n\f\r ]+", "")
    out = docs.withColumn("h", F.xxhash64("text")).join(often, "h").withColumn("lang_flag", validate.to_bool(docs, "lang"))
    return out.select("doc_id", F.md5(stripped).alias("stripped_md5"), F.length(stripped).cast("long").alias("stripped_chars"), (F.col("n") > 1).alias("repeated"), "lang_flag")


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_exact(spark, d):
    return dedup.distinct_rows(table(spark, d, "documents"), [F.md5("text").alias("text_md5")], "doc_id")


@query(r"""
WITH h AS (SELECT p_partkey, '>db|' || p_partkey || '|XP_' || (p_partkey * 7) || '.1| ' || p_name || ' ' || lower(p_type) || ' [' || p_brand || ']' AS line FROM part),
p AS (SELECT *, string_split(substr(line, 2), '|') AS f, regexp_extract_all(line, '\[([^\[\]]*)\]', 1) AS sp FROM h)
SELECT p_partkey, regexp_extract(f[len(f) - 1], '^([^.]*)', 1) AS accession, sp[len(sp)] AS species, replace(trim(string_split(f[len(f)], '[')[1]), '  ', ' ') AS name FROM p""")
def header_parse(spark, d):
    part = table(spark, d, "part")
    line = F.concat(F.lit(">db|"), F.col("p_partkey").cast("string"), F.lit("|XP_"), (F.col("p_partkey") * 7).cast("string"), F.lit(".1| "), "p_name", F.lit(" "), F.lower("p_type"), F.lit(" ["), "p_brand", F.lit("]"))
    out = part.select("p_partkey", line.alias("line")).withColumn("h", text.parse_header(F.col("line")))
    return out.select("p_partkey", "h.accession", "h.species", "h.name")


_FLAGGED = "replace(replace(replace(replace(p_type, 'SMALL', 'PARTIAL'), 'LARGE', 'low-quality'), 'ECONOMY', 'Isoform'), 'PROMO', 'crystal structure')"


@query(f"SELECT p_partkey, " + ", ".join(f"regexp_matches({_FLAGGED} || ' ' || p_name, '(?i){p}') AS {f}" for f, p in text.FLAGS.items()) + " FROM part")
def meta_flags(spark, d):
    line = F.col("p_type")
    for a, b in (("SMALL", "PARTIAL"), ("LARGE", "low-quality"), ("ECONOMY", "Isoform"), ("PROMO", "crystal structure")):
        line = F.replace(line, F.lit(a), F.lit(b))
    line = F.concat_ws(" ", line, "p_name")
    return table(spark, d, "part").select("p_partkey", *text.flags(line))


ALIASES = {"widgets": ["widget", "wdgt"], "gears": ["gear", "cog wheel"], "small": ["small widget", "small"], "bolts": ["bolt", "bolt2"]}
_PATTERNS = build_patterns({k: v for k, v in ALIASES.items() if k != "small"} | {"tiny": ["small"]})


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '(?i)' || '{p.positive}')" + (f" AND NOT regexp_matches(p_name, '(?i)' || '{p.negative}')" if p.negative else "") + f" THEN '{p.name}'" for p in _PATTERNS) + " ELSE 'unassigned' END AS nickname FROM part")
def alias_nickname(spark, d):
    return table(spark, d, "part").select("p_partkey", nickname(F.col("p_name"), _PATTERNS).alias("nickname"))


# whole names of parts, filled up with gaps to the longest one's width
_ALI = "SELECT p_partkey AS doc_id, p_brand AS lang, rpad(replace(p_name, ' ', '-'), (SELECT max(length(p_name)) FROM part)::INT, '-') AS ali FROM part"
_LONG = f"a AS ({_ALI}), l AS (SELECT doc_id, lang, unnest(string_split(ali, '')) AS aa, generate_subscripts(string_split(ali, ''), 1) - 1 AS pos FROM a)"


def _ali(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    width = part.agg(F.max(F.length("p_name"))).first()[0] or 1
    return part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("lang"), F.rpad(F.replace("p_name", F.lit(" "), F.lit("-")), width, "-").alias("ali"))


@query(f"""WITH {_LONG}
SELECT pos::INT AS pos, count(*)::BIGINT AS n, sum((aa = '-')::INT)::BIGINT AS gaps, round(avg((aa = '-')::INT), 6) AS fx_gap, avg((aa = '-')::INT) >= 0.15 AS sparse FROM l GROUP BY pos HAVING min((aa = '-')::INT) = 0""")
def sparse_columns(spark, d):
    out = alignment.sparse_columns(alignment.columns_of(_ali(spark, d), ["doc_id"], "ali"), 0.15)
    return out.withColumn("fx_gap", r6(F.col("fx_gap")))


_SCORES = f"""a AS ({_ALI}),
w AS (SELECT round_even(max(length(ali)) * 0.1, 0)::BIGINT AS f, round_even(max(length(ali)) * 0.9, 0)::BIGINT AS t FROM a),
c AS (SELECT doc_id, lang, regexp_replace(substr(translate(ali, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), w.f + 1, w.t - w.f), '[^ACDEFGHIKLMNPQRSTVWY-]', '-', 'g') AS cut FROM a, w),
l AS (SELECT doc_id, lang, unnest(string_split(cut, '')) AS aa, generate_subscripts(string_split(cut, ''), 1) - 1 AS pos FROM c),
p AS (SELECT lang, pos, avg((aa = '-')::INT) >= 0.5 AS sparse FROM l GROUP BY lang, pos HAVING min((aa = '-')::INT) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - row_number() OVER (PARTITION BY lang, sparse ORDER BY pos) AS run FROM p),
j AS (SELECT l.lang, doc_id, sparse, run, count(*) AS cols, sum((aa <> '-')::INT) AS res FROM l JOIN r ON l.lang = r.lang AND l.pos = r.pos GROUP BY ALL),
sc AS (SELECT lang, doc_id, sum(CASE WHEN sparse THEN res ELSE 0 END) / sum(cols) AS fx_in_sparse,
  CASE WHEN sum(CASE WHEN sparse THEN 0 ELSE cols END) = 0 THEN 'nan'::DOUBLE ELSE sum(CASE WHEN sparse THEN 0 ELSE cols - res END) / sum(CASE WHEN sparse THEN 0 ELSE cols END) END AS fx_missing_dense,
  max(CASE WHEN sparse THEN res ELSE 0 END)::BIGINT AS sparse_run_length FROM j GROUP BY lang, doc_id)"""


def _scores(spark, d) -> DataFrame:
    ali = _ali(spark, d).withColumn("ali", F.translate("ali", string.ascii_lowercase, string.ascii_uppercase))
    return alignment.score(ali, "doc_id", "ali", cutoff=0.5, trim=(0.1, 0.9), by=["lang"])


@query(f"WITH {_SCORES} SELECT lang, doc_id, round(fx_in_sparse, 6) AS fx_in_sparse, round(fx_missing_dense, 6) AS fx_missing_dense, sparse_run_length FROM sc")
def alignment_scores(spark, d):
    return _scores(spark, d).select("lang", "doc_id", r6(F.col("fx_in_sparse")).alias("fx_in_sparse"), r6(F.col("fx_missing_dense")).alias("fx_missing_dense"), "sparse_run_length")


@query(f"""WITH {_SCORES},
pk AS (SELECT least(round_even(count(*) * 0.9, 0), count(*) - 1)::BIGINT AS k FROM sc),
pc AS (SELECT (SELECT list_sort(list(fx_in_sparse))[pk.k + 1] FROM sc) AS c1, (SELECT list_sort(list(sparse_run_length))[pk.k + 1] FROM sc) AS c2, (SELECT list_sort(list(fx_missing_dense))[pk.k + 1] FROM sc) AS c3 FROM pk)
SELECT doc_id, (fx_in_sparse >= c1 AND c2 > 0 AND sparse_run_length >= c2) OR (fx_missing_dense >= c3 AND doc_id % 2 = 0) AS drop FROM sc, pc""")
def polish_filter(spark, d):
    rows = _scores(spark, d).withColumn("partial", F.col("doc_id") % 2 == 0)
    return alignment.polish_rule(rows).select("doc_id", "drop")


@query("""SELECT o_orderpriority, list_sort(list(o_totalprice))[least(round_even(count(*) * 0.975, 0), count(*) - 1)::BIGINT + 1] AS cutoff, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def order_stat_cutoff(spark, d):
    return numbers.rank_cutoff(table(spark, d, "orders"), "o_totalprice", 0.975, ["o_orderpriority"])


@query("""
WITH s AS (SELECT lang, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, count(*) AS n, greatest(round_even(2 * sqrt(count(*)), 0), 1) AS bins FROM documents GROUP BY lang),
b AS (SELECT d.lang, lo, n, (hi - lo) / bins AS w, CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / bins)), bins - 1) END AS b FROM documents d JOIN s ON d.lang = s.lang WHERE n_chars IS NOT NULL),
c AS (SELECT lang, b, lo, w, n, count(*) AS k FROM b GROUP BY ALL)
SELECT lang, round(lo + b * w, 6) AS left_edge, k::BIGINT AS in_bin, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, b) = 1""")
def hist_mode_length(spark, d):
    return numbers.modal_bin(table(spark, d, "documents"), "n_chars", ["lang"]).withColumn("left_edge", r6(F.col("left_edge")))


@query("""SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, -c_acctbal, c_custkey) = 1""")
def quality_rank(spark, d):
    return dedup.best_of(table(spark, d, "customer").withColumn("m", -F.col("c_acctbal")), ["c_nationkey"], [F.col("c_mktsegment").alias("k1"), F.col("m").alias("k2")], ["c_custkey", "c_mktsegment"])


_LCS = """
WITH RECURSIVE n AS (SELECT DISTINCT p_brand, p_size, p_name FROM part),
pr AS (SELECT a.p_brand, a.p_size, a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name < b.p_name),
u AS (SELECT DISTINCT x, y FROM pr),
l AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda k: 0) AS row FROM u
  UNION ALL
  SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN row[j] + 1 ELSE greatest(acc[len(acc)], row[j + 1]) END), [0::BIGINT]) FROM l WHERE i < length(x))
SELECT p_brand, p_size, pr.x AS name_a, pr.y AS name_b, row[len(row)]::BIGINT AS lcs, round(row[len(row)]::DOUBLE / least(length(pr.x), length(pr.y)), 6) AS similarity FROM pr JOIN l ON pr.x = l.x AND pr.y = l.y AND l.i = length(l.x)"""


@query(_LCS)
def pair_similarity(spark, d):
    names = table(spark, d, "part").select("p_brand", "p_size", "p_name").distinct().withColumn("seq", F.col("p_name"))
    out = dedup.pair_similarity(names, ["p_brand", "p_size"], "p_name", "seq")
    return out.select("p_brand", "p_size", F.col("a").alias("name_a"), F.col("b").alias("name_b"), "lcs", r6(F.col("similarity")).alias("similarity"))


@query()
def greedy_dedup(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name", (-F.col("p_retailprice")).alias("rank"))
    out = dedup.greedy_blocks(part, ["p_brand", "p_size"], "p_name", ["rank", "p_partkey"], ["p_partkey"], 0.8)
    return out.select("p_partkey", "stays")


@query()
def in_group_dedup(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text", F.col("n_chars").alias("rank"))
    return dedup.greedy_blocks(docs, ["source"], "text", ["rank", "doc_id"], ["doc_id"], 0.9).select("doc_id", "stays")


@query("""
WITH k AS (SELECT *, l_returnflag = 'R' AND l_linestatus = 'O' OR l_discount = 0 AS key FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, key ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS rank, sum(key::INT) OVER (PARTITION BY l_suppkey) AS nk FROM k)
SELECT l_suppkey, l_orderkey, l_linenumber, key FROM r WHERE key OR rank <= 40 - nk""")
def topk_budget(spark, d):
    rows = table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    key = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")) | (F.col("l_discount") == 0)
    out = budgets.top_of_blocks(rows.withColumn("key", key), "l_suppkey", F.col("l_extendedprice"), F.lit(40), F.col("key"), "row")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "key")


@query("""
WITH c AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1),
t0 AS (SELECT *, round_even(sum(n) OVER () * 0.9, 0) AS total, count(*) OVER () AS names, min(name) OVER () AS first FROM c),
t AS (SELECT name, n, round_even(total / names, 0) + CASE WHEN name = first AND round_even(total / names, 0) * names < total THEN 1 ELSE 0 END AS b0 FROM t0),
a AS (SELECT *, least(b0, n) AS f1, b0 >= n AS done, sum(CASE WHEN b0 >= n THEN b0 - n ELSE 0 END) OVER () AS pool, sum(CASE WHEN b0 >= n THEN 0 ELSE b0 END) OVER () AS rest FROM t),
a2 AS (SELECT *, CASE WHEN done OR pool = 0 THEN f1 ELSE round_even(b0 / rest * (rest + pool), 0) END AS b1 FROM a),
b AS (SELECT *, NOT done AND b1 >= n AS done2, sum(CASE WHEN NOT done AND b1 >= n THEN b1 - n ELSE 0 END) OVER () AS pool2, sum(CASE WHEN done OR b1 >= n THEN 0 ELSE b1 END) OVER () AS rest2 FROM a2),
b2 AS (SELECT *, CASE WHEN done THEN f1 WHEN done2 THEN n WHEN pool2 = 0 THEN b1 ELSE round_even(b1 / rest2 * (rest2 + pool2), 0) END AS b2 FROM b),
e AS (SELECT *, NOT done AND NOT done2 AND b2 >= n AS done3, sum(CASE WHEN NOT done AND NOT done2 AND b2 >= n THEN b2 - n ELSE 0 END) OVER () AS pool3, sum(CASE WHEN done OR done2 OR b2 >= n THEN 0 ELSE b2 END) OVER () AS rest3 FROM b2),
e2 AS (SELECT *, CASE WHEN done OR done2 THEN b2 WHEN done3 THEN n WHEN pool3 = 0 THEN b2 ELSE round_even(b2 / rest3 * (rest3 + pool3), 0) END AS b3 FROM e)
SELECT name, n::BIGINT AS n, least(b3, n)::BIGINT AS budget FROM e2""")
def even_budget(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")).collect()
    n = {r["name"]: r["n"] for r in counts}  # one row for each status
    got = budgets.capped(budgets.even_budget(list(n), round(sum(n.values()) * 0.9)), n) if n else {}
    return spark.createDataFrame([(k, n[k], int(got[k])) for k in n], "name string, n long, budget long")


@query(r"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_concat(['root'], list_filter(string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda x: x <> '')) AS path FROM pages),
n AS (SELECT host, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT host, unnest(path) AS v, generate_subscripts(path, 1) - 1 AS pos FROM p),
g AS (SELECT l.host, pos, min(v) AS v, min(v) = max(v) AND count(*) = any_value(n) AS same FROM l JOIN n ON l.host = n.host GROUP BY l.host, pos),
s AS (SELECT *, min(same::INT) OVER (PARTITION BY host ORDER BY pos) AS run FROM g)
SELECT n.host, any_value(n)::BIGINT AS n, coalesce(string_agg(CASE WHEN run = 1 THEN v END, '/' ORDER BY pos), '') AS prefix FROM n LEFT JOIN s ON n.host = s.host GROUP BY n.host""")
def taxon_mrca(spark, d):
    path = F.concat(F.array(F.lit("root")), F.filter(F.split(F.regexp_replace("url", r"^https?://[^/]+", ""), "/"), lambda x: x != ""))
    pages = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), path.alias("path"))
    return taxonomy.common_prefix(pages, ["host"], "path").select("host", "n", F.array_join("prefix", "/").alias("prefix"))


_EDGES = """e AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL)"""


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT node, node AS ancestor, 0 AS distance FROM e UNION ALL SELECT p.node, e.parent, distance + 1 FROM p JOIN e ON p.ancestor = e.node WHERE e.parent IS NOT NULL)
SELECT ancestor AS node, sum((node[1] = 'c')::INT)::BIGINT AS leaves, max(distance)::BIGINT AS height FROM p GROUP BY 1""")
def tree_paths(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, d, "customer").select(s("c", "c_custkey").alias("node"), s("n", "c_nationkey").alias("parent"))
    edges = edges.unionByName(table(spark, d, "nation").select(s("n", "n_nationkey").alias("node"), s("r", "n_regionkey").alias("parent")))
    edges = edges.unionByName(table(spark, d, "region").select(s("r", "r_regionkey").alias("node"), F.lit("root").alias("parent")))
    edges = edges.unionByName(spark.createDataFrame([("root", None)], "node string, parent string"))
    paths = taxonomy.tree_paths(edges)
    return paths.groupBy(F.col("ancestor").alias("node")).agg(F.sum(F.col("node").startswith("c").cast("long")).alias("leaves"), F.max("distance").alias("height"))


@query("""SELECT c_custkey, n_name, row_number() OVER (ORDER BY c_mktsegment, n_regionkey, n_nationkey, c_custkey)::BIGINT AS place FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def sort_taxa(spark, d):
    nations = table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").select("n_nationkey", "n_name").collect()
    names = spark.createDataFrame([(r[0], r[1]) for r in nations], "c_nationkey int, n_name string")
    rows = table(spark, d, "customer").join(F.broadcast(names), "c_nationkey")
    placed = taxonomy.placed_by_taxa(rows, [r[1] for r in nations], ["c_mktsegment"], "n_name", "c_custkey")
    return placed.select("c_custkey", "n_name", F.col("place").cast("long").alias("place"))


@query("""SELECT concat_ws('+', a.n_name, nullif(b.r, ''), nullif(c.f, '')) AS model FROM nation a, (SELECT r_name AS r FROM region UNION ALL SELECT '') b, (VALUES (''), ('FC'), ('FO')) c(f)""")
def model_grid(spark, d):
    region = table(spark, d, "region").select("r_name").unionByName(spark.createDataFrame([("",)], "r_name string"))
    return models.model_grid([table(spark, d, "nation").select("n_name"), region, spark.createDataFrame([("",), ("FC",), ("FO",)], "f string")])


@query("""
WITH m AS (SELECT o_orderpriority, o_orderkey, 1000 + (o_totalprice - floor(o_totalprice / 50) * 50) AS aicc FROM orders),
e AS (SELECT *, exp((min(aicc) OVER (PARTITION BY o_orderpriority) - aicc) / 2) AS e FROM m)
SELECT o_orderpriority, o_orderkey, round(e / sum(e) OVER (PARTITION BY o_orderpriority), 6) AS p FROM e""")
def model_weights(spark, d):
    price = F.col("o_totalprice")
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", (1000 + (price - F.floor(price / 50) * 50)).alias("AICc"))
    return models.model_weights(rows, by=["o_orderpriority"]).select("o_orderpriority", "o_orderkey", r6(F.col("p")).alias("p"))


_STATES = ancestors.STATES
_SITE = f"""
WITH q AS (SELECT label, vec_id, list_transform(embedding[1:20], lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings),
p AS (SELECT label, vec_id, list_transform(q, lambda x: x / list_sum(q)) AS p FROM q),
t AS (SELECT *, list_max(p) AS ml_pp, list_position(p, list_max(p)) AS a FROM p),
u AS (SELECT *, list_transform(p, lambda x, i: CASE WHEN i = a THEN 0 ELSE x END) AS rest FROM t),
v AS (SELECT *, list_max(rest) AS alt_pp, list_position(rest, list_max(rest)) AS b, {_STATES}[a] AS ml_state, {_STATES}[list_position(rest, list_max(rest))] AS alt_state,
  -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) AS entropy FROM u),
s AS (SELECT *, CASE WHEN alt_pp >= 0.25 THEN CASE WHEN {" OR ".join(f"(contains('{g}', ml_state) AND contains('{g}', alt_state))" for g in ancestors.SIMILAR)} THEN 'ambig_similar' ELSE 'ambig_dissimilar' END ELSE 'good' END AS site_type FROM v)"""


def _sites(spark, d) -> DataFrame:
    """Squares of the first 20 components of a vector as a site's probabilities; the label is the ancestor."""
    sq = F.transform(F.slice("embedding", 1, 20), lambda x: x.cast("double") * x.cast("double"))
    held = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("anc"), F.col("vec_id").alias("site"), sq.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    p = held.withColumn("s", total).select("anc", "site", F.transform("q", lambda x: x / F.col("s")).alias("p"))
    return ancestors.site_table(p, None)


@query(f"{_SITE} SELECT label::VARCHAR AS anc, vec_id AS site, ml_state, round(ml_pp, 6) AS ml_pp, alt_state, round(alt_pp, 6) AS alt_pp, site_type, round(entropy, 6) AS entropy FROM s")
def site_argmax(spark, d):
    return _sites(spark, d).select("anc", "site", "ml_state", r6(F.col("ml_pp")).alias("ml_pp"), "alt_state", r6(F.col("alt_pp")).alias("alt_pp"), "site_type", r6(F.col("entropy")).alias("entropy"))


@query(f"""{_SITE} SELECT label::VARCHAR AS anc, round(avg(ml_pp), 6) AS avg_pp, round(sum(ln(ml_pp)), 6) AS ln_pp, round(avg(CASE WHEN alt_pp >= 0.25 THEN alt_pp ELSE ml_pp END), 6) AS alt_avg_pp,
  round(sum(ln(CASE WHEN alt_pp >= 0.25 THEN alt_pp ELSE ml_pp END)), 6) AS alt_ln_pp, sum((site_type LIKE 'ambig%')::INT)::BIGINT AS num_ambig, 0::BIGINT AS num_ambig_gaps FROM s GROUP BY 1""")
def ancestor_summary(spark, d):
    out = ancestors.summary(_sites(spark, d))
    return out.select("anc", *[r6(F.col(c)).alias(c) for c in ("avg_pp", "ln_pp", "alt_avg_pp", "alt_ln_pp")], "num_ambig", "num_ambig_gaps")


@query("""
WITH k AS (SELECT l_orderkey % 1000 AS replicate, l_orderkey, string_agg(DISTINCT (l_suppkey % 7)::VARCHAR, ',' ORDER BY (l_suppkey % 7)::VARCHAR) AS split FROM lineitem GROUP BY 1, 2),
d AS (SELECT DISTINCT replicate, split FROM k), n AS (SELECT count(DISTINCT replicate) AS n FROM d)
SELECT split, count(*)::BIGINT AS n, round(count(*) * 100.0 / any_value(n.n), 6) AS support FROM d, n GROUP BY split""")
def split_support(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set((F.col("l_suppkey") % 7).cast("string"))), ",").alias("split"))
    out = trees.split_support(lines.withColumn("replicate", F.col("l_orderkey") % 1000), "replicate", "split")
    return out.select("split", "n", r6(F.col("support")).alias("support"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '|' || p_partkey ELSE p_name END AS label FROM part")
def name_disambiguate(spark, d):
    return text.disambiguated(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"), "p_partkey").select("p_partkey", "label")


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag AS m, count(*) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey) AS n FROM c)
SELECT l_suppkey, any_value(n)::BIGINT AS n, coalesce(string_agg(CASE WHEN c / n > 0.1 THEN m END, '|' ORDER BY c DESC, m DESC), '') AS call FROM s GROUP BY 1""")
def composition_call(spark, d):
    return trees.composition(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")


@query("""
SELECT o_orderkey AS key, 'seed' AS kind, o_orderstatus AS status, true AS always_keep, false AS partial FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT l_orderkey, 'hit', NULL, false, l_quantity < 3 FROM lineitem WHERE l_discount > 0.09""")
def union_seed_hits(spark, d):
    seed = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("key"), F.lit("seed").alias("kind"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("always_keep"))
    hits = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("key"), F.lit("hit").alias("kind"), (F.col("l_quantity") < 3).alias("partial"))
    return intervals.seed_and_hits(seed, hits)


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS keep, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def anti_missing(spark, d):
    from ..sources import fasta

    file = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("|label")).alias("header"), F.col("quality").cast("string").alias("sequence"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), F.lit(True).alias("keep"))
    out = fasta.read_into(rows, file)
    return out.select(F.col("uid").cast("long").alias("doc_id"), "keep", F.coalesce(F.col("alignment").cast("int"), F.lit(-1)).alias("quality"))


TREE = "(((a0,a1)n1,(a2,a3)n2)n5,((a4,a5)n3,(a6,a7)n4)n6)n7;"


@query()
def parsimony_gaps(spark, d):
    """Sites are hours; leaf i has a gap in an hour without events of users that leave i modulo 8."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    seen = table(spark, d, "events").groupBy(hour.alias("site")).agg(F.collect_set(F.col("user_id") % 8).alias("have"))
    gaps = F.map_from_entries(F.array(*[F.struct(F.lit(f"a{i}"), ~F.array_contains("have", F.lit(i).cast("long"))) for i in range(8)]))
    return ancestors.ancestral_gaps(seen.select("site", gaps.alias("gaps")), TREE)


@query("""SELECT p_partkey, r.range AS replicate, md5(array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: p_name[1 + (i * 31 + r.range * 17 + 7) % length(p_name)]), '')) AS sample FROM part, range(3) r""")
def bootstrap_sample(spark, d):
    """Places by modular arithmetic in place of the seeded hash, so that SQL can draw the same ones."""
    draw = lambda i, replicate, n: F.pmod(i * 31 + replicate * 17 + 7, n)
    out = models.resampled(table(spark, d, "part").select("p_partkey", "p_name"), 3, "p_partkey", "p_name", draw=draw)
    return out.select("p_partkey", "replicate", F.md5("p_name").alias("sample"))


@query(r"""
WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM v)
SELECT item_id, doc_id, count(*)::BIGINT AS shared FROM g JOIN h ON g.g = h.g GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) <= 10""")
def kmer_search(spark, d):
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z]+", " "), " "), lambda x: x != "")
    items = table(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return search.shared_grams(items, docs, "item_id", "doc_id", "w", 5, top=10)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
