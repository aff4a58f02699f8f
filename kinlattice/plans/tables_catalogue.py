"""More named queries, with DuckDB SQL: checks, ids, calls, budgets and records of sequence tables.

As in catalogue, a driver table stands for the domain's: parts are sequences, brands are species, order
lines are hits of parts, priorities are paralogs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import alignment, dedup, intervals, models, posterior, taxonomy, trees, validate
from ..schema import ROW
from ..sources import fasta, phylip
from .catalogue import query, r6, table


@query("""
WITH d AS (SELECT p_brand AS species, p_name || ' ' || p_partkey AS name, p_name || ' x ' AS sequence, ['yes', 'No', 't'][p_size % 3 + 1] AS k, p_size % 2 AS always_keep,
  CASE p_size % 4 WHEN 0 THEN 'ott' || p_partkey WHEN 1 THEN ' ' WHEN 2 THEN 'None' ELSE ' ott5 ' END AS o, lpad(p_partkey::VARCHAR, 10, '-') || '--' AS ali FROM part),
w AS (SELECT max(length(trim(ali, '-'))) AS w FROM d WHERE k <> 'No')
SELECT species, name, regexp_replace(sequence, '\\s+', '', 'g') AS sequence, k <> 'No' AS keep, always_keep = 1 AS always_keep, CASE WHEN lower(trim(o)) IN ('', 'none') THEN NULL ELSE trim(o) END AS ott,
  substr(ali, 11 - w.w::INT, w.w::INT) AS alignment, true AS has_uid FROM d, w""")
def check_table(spark, d):
    """Every row stands twice; flags are texts and numbers; all kept rows have gaps on both sides."""
    part = table(spark, d, "part")
    keep = F.get(F.array(F.lit("yes"), F.lit("No"), F.lit("t")), (F.col("p_size") % 3).cast("int"))
    size = F.col("p_size") % 4
    ott = F.when(size == 0, F.concat(F.lit("ott"), F.col("p_partkey").cast("string"))).when(size == 1, " ").when(size == 2, "None").otherwise(" ott5 ")
    rows = part.select(
        F.col("p_brand").alias("species"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.concat("p_name", F.lit(" x ")).alias("sequence"),
        keep.alias("keep"),
        (F.col("p_size") % 2).alias("always_keep"),
        ott.alias("ott"),
        F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, "-"), F.lit("--")).alias("alignment"),
        F.lit("bad uid").alias("uid"),
    )
    out = validate.check_table(rows.unionByName(rows))
    once = out.groupBy("uid").agg(F.count("*").alias("n"))
    out = out.join(once, "uid").withColumn("has_uid", F.col("uid").rlike("^[A-Za-z]{10}$") & (F.col("n") == 1))
    return out.select("species", "name", "sequence", "keep", "always_keep", "ott", "alignment", "has_uid")


_HITS = """h AS (SELECT user_id AS accession, event_id AS s, event_id + floor(value * 30)::BIGINT AS e, value AS e_value, event_type AS query, props AS line, event_id AS row_id FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY accession ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY accession ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


def _hits(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("accession"),
        F.col("event_id").alias("subject_start"),
        (F.col("event_id") + F.floor(F.col("value") * 30)).cast("long").alias("subject_end"),
        F.col("value").alias("e_value"),
        F.col("event_type").alias("query"),
        F.col("props").alias("line"),
        F.col("event_id").alias(ROW),
    )


@query(f"""WITH {_HITS}
SELECT accession, min(s)::BIGINT AS subject_start, max(e)::BIGINT AS subject_end, min(e_value) AS e_value,
  CASE WHEN count(*) = 1 THEN any_value(query) ELSE string_agg(query || '|' || s || '-' || e, ';' ORDER BY row_id) END AS query, arg_max(line, (e - s, -row_id)) AS line, arg_max(row_id, (e - s, -row_id)) AS row_id
FROM i GROUP BY accession, island""")
def merge_hits(spark, d):
    return intervals.merge_hits(_hits(spark, d), "longest")


@query(r"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS not_always, CASE WHEN p_brand = 'Brand#2' THEN 0 ELSE 1 END AS not_key, CASE WHEN abs(length(p_name) - 12.0) / 12 >= 0.25 THEN 1 ELSE 0 END AS odd_length,
  (p_type = 'SMALL')::INT AS partial, (p_type = 'ECONOMY')::INT AS isoform, round(1.0 / length(p_name), 6) AS short FROM part""")
def quality_scores(spark, d):
    part = table(spark, d, "part").withColumn("sequence", F.col("p_name"))
    part = part.withColumns({f: F.lit(False) for f in dedup.ORDER} | {"partial": F.col("p_type") == "SMALL", "isoform": F.col("p_type") == "ECONOMY", "always_keep": F.col("p_size") % 5 == 0, "key_species": F.col("p_brand") == "Brand#2"})
    out = part.select("p_partkey", dedup.quality(F.lit(12.0)).alias("q"))
    return out.select("p_partkey", "q.not_always", "q.not_key", "q.odd_length", "q.partial", "q.isoform", r6(F.col("q.short")).alias("short"))


@query("SELECT o_orderpriority AS recip_paralog, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def paralog_counts(spark, d):
    return posterior.paralog_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("recip_paralog"), (F.col("o_orderstatus") != "P").alias("keep")))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) > 30 AS found FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1),
j AS (SELECT o_orderkey, o_orderstatus, o_orderstatus <> 'P' AS k, o_totalprice > 300000 AS always, n, found FROM orders LEFT JOIN c ON o_orderkey = l_orderkey AND o_orderstatus <> 'P')
SELECT o_orderkey, (k AND coalesce(found, false)) OR always AS keep, CASE WHEN k THEN coalesce(found, false) END AS recip_found_paralog,
  CASE WHEN found THEN 'many' WHEN always THEN o_orderstatus END AS recip_paralog FROM j""")
def apply_calls(spark, d):
    calls = table(spark, d, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("query")).agg((F.max("l_quantity") > 30).alias("recip_found_paralog"))
    calls = calls.withColumn("recip_paralog", F.when(F.col("recip_found_paralog"), "many"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("name"), (F.col("o_orderstatus") != "P").alias("keep"), (F.col("o_totalprice") > 300000).alias("always_keep"))
    return posterior.apply_calls(rows, calls).select(F.col("uid").alias("o_orderkey"), "keep", "recip_found_paralog", "recip_paralog")


_NAMES = """n AS (SELECT DISTINCT lower('NATION_' || (c_nationkey % 20)) AS query, 'ott' || (c_custkey % 3 + c_nationkey * 10) AS ott, 'Nation ' || c_nationkey AS canonical, c_custkey % 3 = 0 AS exact, c_custkey % 3 = 2 OR c_nationkey < 20 AS synonym FROM customer WHERE c_nationkey % 20 >= 4),
g AS (SELECT query, count(*) AS n, sum((exact AND NOT synonym)::INT) AS firm, sum((NOT exact AND NOT synonym)::INT) AS loose,
  arg_min(ott, (ott, canonical)) FILTER (exact AND NOT synonym) AS fo, arg_min(canonical, (ott, canonical)) FILTER (exact AND NOT synonym) AS fc, arg_min(ott, (ott, canonical)) AS oo, arg_min(canonical, (ott, canonical)) AS oc FROM n GROUP BY 1)"""


def _names(spark, d) -> DataFrame:
    c = table(spark, d, "customer").where("c_nationkey % 20 >= 4")
    return c.select(
        F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 20).cast("string")).alias("query"),
        F.concat(F.lit("ott"), (F.col("c_custkey") % 3 + F.col("c_nationkey") * 10).cast("string")).alias("ott"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("canonical"),
        (F.col("c_custkey") % 3 == 0).alias("is_exact"),
        ((F.col("c_custkey") % 3 == 2) | (F.col("c_nationkey") < 20)).alias("is_synonym"),
    )


@query(f"""WITH {_NAMES}, s AS (SELECT DISTINCT n_name || ' strain K' AS species, lower(n_name) AS query FROM nation)
SELECT species, coalesce(n = 1 OR (firm = 1 AND loose = 0), false) AS matched, CASE WHEN n = 1 THEN oo WHEN firm = 1 AND loose = 0 THEN fo END AS ott, CASE WHEN n = 1 THEN oc WHEN firm = 1 AND loose = 0 THEN fc END AS canonical FROM s LEFT JOIN g ON s.query = g.query""")
def species_ids(spark, d):
    rows = table(spark, d, "nation").select(F.concat("n_name", F.lit(" strain K")).alias("species"))
    return taxonomy.species_ids(rows, _names(spark, d))


@query(f"""WITH {_NAMES}, m AS (SELECT query, CASE WHEN n = 1 THEN oo WHEN firm = 1 AND loose = 0 THEN fo END AS ott, CASE WHEN n = 1 THEN oc WHEN firm = 1 AND loose = 0 THEN fc END AS canonical FROM g)
SELECT c_custkey AS row_id, coalesce(canonical, n_name) AS species, n_name AS orig_species, ott, ott IS NOT NULL AS resolvable, c_acctbal > 0 AND ott IS NOT NULL AS keep
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON lower(n_name) = m.query""")
def add_species_ids(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    out = taxonomy.add_species_ids(rows.select(F.col("c_custkey").alias(ROW), F.col("n_name").alias("species"), (F.col("c_acctbal") > 0).alias("keep")), _names(spark, d))
    return out.select(ROW, "species", "orig_species", "ott", "resolvable", "keep")


@query(r"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_concat(['life', 'cellular organisms', CASE WHEN page_id % 2 = 0 THEN 'Bacteria' ELSE 'Eukaryota' END], list_filter(string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda x: x <> '')) AS path, page_id % 7 AS g FROM pages),
k AS (SELECT host || '-' || g AS grp, path FROM p), n AS (SELECT grp, count(*) AS n FROM k GROUP BY 1),
l AS (SELECT grp, unnest(path) AS v, generate_subscripts(path, 1) - 1 AS pos FROM k),
a AS (SELECT l.grp, pos, min(v) AS v, min(v) = max(v) AND count(*) = any_value(n) AS same FROM l JOIN n ON l.grp = n.grp GROUP BY l.grp, pos),
s AS (SELECT *, min(same::INT) OVER (PARTITION BY grp ORDER BY pos) AS run FROM a),
f AS (SELECT grp, coalesce(list(v ORDER BY pos) FILTER (run = 1 AND v NOT IN ('life', 'cellular organisms')), []) AS u FROM s GROUP BY grp),
r AS (SELECT grp, CASE WHEN list_contains(u, 'Bacteria') THEN u[1:list_position(u, 'Bacteria')] ELSE u END AS lin, list_contains(u, 'Bacteria') AS is_microbial FROM f)
SELECT grp, CASE WHEN len(lin) > 0 THEN lin[len(lin)] ELSE 'life' END AS taxon, array_to_string(lin, '/') AS lineage, is_microbial FROM r""")
def ott_mrca(spark, d):
    path = F.filter(F.split(F.regexp_replace("url", r"^https?://[^/]+", ""), "/"), lambda x: x != "")
    top = F.array(F.lit("life"), F.lit("cellular organisms"), F.when(F.col("page_id") % 2 == 0, "Bacteria").otherwise("Eukaryota"))
    rows = table(spark, d, "pages").select(F.concat_ws("-", F.regexp_extract("url", r"^https?://([^/]+)", 1), (F.col("page_id") % 7).cast("string")).alias("grp"), F.concat(top, path).alias("path"))
    out = taxonomy.common_prefix(rows, ["grp"], "path").select("grp", taxonomy.mrca(F.col("prefix")).alias("m"))
    return out.select("grp", "m.taxon", F.array_join("m.lineage", "/").alias("lineage"), "m.is_microbial")


@query("""
SELECT (SELECT greatest(count(DISTINCT w) - 1, 0) FROM (SELECT unnest(string_split(replace(p_name, ' ', '|'), '|')) AS w FROM part) WHERE w <> '')::BIGINT AS expected,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::BIGINT AS observed,
  greatest((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') - (SELECT greatest(count(DISTINCT w) - 1, 0) FROM (SELECT unnest(string_split(replace(p_name, ' ', '|'), '|')) AS w FROM part) WHERE w <> ''), 0)::BIGINT AS excess""")
def duplications(spark, d):
    nodes = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "D").otherwise("S").alias("event"))
    leaves = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("|")).alias("paralog"))
    return trees.duplications(nodes, leaves)


@query("""SELECT o_orderkey::VARCHAR AS model, o_totalprice AS p FROM orders ORDER BY p DESC, model LIMIT 10""")
def best_models(spark, d):
    return models.best_models(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("model"), F.col("o_totalprice").alias("p")), 10)


@query(r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(n, '(?i)strain.*', '', 'g'), '(?i)str\..*', '', 'g')) AS species, '''' || replace(n, ' ', '%20') || '''' AS held, n AS again, regexp_replace(upper(n), '[^ACDEFGHIKLMNPQRSTVWY-]', '-', 'g') AS cleaned
FROM (SELECT p_partkey, p_name || [' strain K12', ' Str. B', ' 7'][p_size % 3 + 1] AS n FROM part)""")
def names_and_strains(spark, d):
    n = F.concat("p_name", F.get(F.array(F.lit(" strain K12"), F.lit(" Str. B"), F.lit(" 7")), (F.col("p_size") % 3).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", n.alias("n"))
    return rows.select("p_partkey", text.without_strain(F.col("n")).alias("species"), text.protect_name(F.col("n")).alias("held"), text.unprotect_name(text.protect_name(F.col("n"))).alias("again"), text.clean_sequence(F.upper("n")).alias("cleaned"))


@query("""
WITH l AS (SELECT p_partkey, p_brand || '|' || CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '...' ELSE p_name END AS l FROM part)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY l) > 1 THEN l || '|' || p_partkey ELSE l END AS label FROM l""")
def pretty_labels(spark, d):
    return text.labels(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("species"), F.col("p_name").alias("name")), key="p_partkey")


@query("""SELECT p_partkey AS row_id, '>u' || p_partkey || '|' || p_brand || '|' || p_type || chr(10) || upper(replace(p_name, ' ', '-')) AS value FROM part WHERE p_size % 4 > 0""")
def fasta_records(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias(ROW), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("uid"), F.col("p_brand").alias("species"), F.col("p_type").alias("name"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("sequence"), (F.col("p_size") % 4 > 0).alias("keep"))
    return fasta.to_fasta(rows)


@query("""SELECT -1 AS ord, count(*) || ' 18' || chr(10) AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'c' || c_custkey || chr(10) || c_name FROM customer WHERE c_acctbal > 0""")
def phylip_records(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias(ROW), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.col("c_name").alias("alignment"), (F.col("c_acctbal") > 0).alias("keep"))
    return phylip.to_phylip(rows)


@query("""
SELECT p_partkey, (p_size > 5 AND NOT starts_with(p_brand, 'Brand#2')) OR p_retailprice > 1500 AS keep FROM part""")
def synthetic_and_rescued(spark, d):
    species = F.when(F.col("p_brand").startswith("Brand#2"), F.concat(F.lit("synthetic "), "p_brand")).otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", species.alias("species"), (F.col("p_size") > 5).alias("keep"), (F.col("p_retailprice") > 1500).alias("always_keep"))
    return validate.rescued(validate.without_synthetic(rows)).select("p_partkey", "keep")


@query("""
WITH p AS (SELECT p_partkey, p_name AS s, length(p_name) AS n, p_size - 10 AS a, p_size // 2 - 8 AS b FROM part),
q AS (SELECT p_partkey, s, greatest(CASE WHEN a < 0 THEN n + a ELSE a END, 0) AS a, least(CASE WHEN b < 0 THEN n + b ELSE b END, n) AS b FROM p)
SELECT p_partkey, CASE WHEN b > a THEN substr(s, a::INT + 1, (b - a)::INT) ELSE '' END AS cut FROM q""")
def sliced(spark, d):
    a, b = F.col("p_size").cast("int") - 10, F.floor(F.col("p_size") / 2).cast("int") - 8
    return table(spark, d, "part").select("p_partkey", validate.sliced(F.col("p_name"), a, b).alias("cut"))


@query("SELECT doc_id AS uid, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id % 11 = 0 AS keep FROM documents")
def kept_only(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), (F.col("doc_id") % 11 == 0).alias("always_keep"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("uid"))
    return validate.kept_only(docs, good).select("uid", "keep")


@query("""
WITH a AS (SELECT c_custkey, replace(replace(c_name, '0', '-'), 'u', 'X') AS ali FROM customer), l AS (SELECT unnest(string_split(ali, '')) AS aa, generate_subscripts(string_split(ali, ''), 1) - 1 AS pos FROM a)
SELECT pos::INT AS pos FROM l GROUP BY pos HAVING min((aa IN ('-', 'X'))::INT) = 1""")
def bad_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.translate("c_name", "0u", "-X").alias("ali"))
    return alignment.bad_columns(alignment.columns_of(rows, ["c_custkey"], "ali"))


@query("SELECT l_orderkey, l_linenumber, round(2 + least(greatest((l_quantity - 10) / 30, 0), 1) * 6, 6) AS size FROM lineitem")
def scaled_sizes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(numbers.scaled(F.col("l_quantity"), 10, 40, 2.0, 8.0)).alias("size"))


@query("SELECT c_nationkey || ':' || string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey::VARCHAR) AS value FROM customer GROUP BY c_nationkey")
def link_table(spark, d):
    return models.link_table(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_nationkey").cast("string").alias("ott")))
