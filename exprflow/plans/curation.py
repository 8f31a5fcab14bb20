"""Queries of label memory and curation over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as me
from ..registry import query
from ..session import read_table
from .catalog import rounded


@query("""WITH n AS (SELECT event_type, user_id, (props->>'k')::BIGINT // 20 AS canonical, count(*) AS n, round(avg(value), 6) AS avg_confidence, max(ts) AS last_at FROM events GROUP BY 1, 2, 3)
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY n DESC, avg_confidence DESC, canonical))::INT AS rank FROM n) WHERE rank <= 3""")
def episodic_recall(spark, d):
    e = read_table(spark, d, "events").select("event_type", "user_id", "value", "ts", F.expr("get_json_object(props, '$.k')").cast("long").alias("k"))
    return me.recall(e.withColumn("canonical", F.expr("k div 20")), ["event_type", "user_id"], "canonical", "value", "ts", 3)


@query("SELECT p_type, count(*) AS n_rows, count(DISTINCT p_brand) AS n_clusters FROM part GROUP BY 1")
def memory_stats(spark, d):
    return me.table_stats(read_table(spark, d, "part"), "p_type", "p_brand")


@query("""SELECT p_brand AS cluster, coalesce(string_agg(DISTINCT p_name, '; ' ORDER BY p_name), '') AS members FROM part GROUP BY 1""")
def cluster_export(spark, d):
    return me.clusters(read_table(spark, d, "part"), "p_name", "p_brand")


@query("""SELECT l_partkey, l_returnflag, count(DISTINCT l_orderkey) AS n_studies, sum(l_quantity) AS n_uses, min(l_linestatus) AS canonical FROM lineitem
  GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 3 AND count(DISTINCT l_linestatus) = 1""")
def promotion_candidates(spark, d):
    return me.promotion_candidates(read_table(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus", "l_orderkey", "l_quantity", 3)


@query("""WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT l_orderkey, first(l_returnflag ORDER BY n DESC, l_returnflag) AS l_returnflag, max(n) AS n_votes FROM n GROUP BY 1""")
def judge_votes(spark, d):
    return me.best_vote(read_table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", 2)


@query("""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT source, size, 50 * size // sum(size) OVER () AS quota, row_number() OVER (ORDER BY size, source NULLS FIRST) = 1 AS f FROM s),
  t AS (SELECT source, quota + CASE WHEN f THEN 50 - sum(quota) OVER () ELSE 0 END AS quota FROM q),
  r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, r.source FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE k <= quota""")
def stratified_draw(spark, d):
    return me.stratified_sample(read_table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("SELECT source, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def rater_agreement(spark, d):
    rated = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    a = rated.select("doc_id", "source", F.col("quality").alias("verdict"))
    return rounded(me.rater_agreement(a, rated.select("doc_id", F.col("toxic").alias("verdict")), ["doc_id"], ["source"]))


@query("""WITH m AS (SELECT raw, min(cluster) AS cluster FROM (SELECT lower(n_name) AS raw, n_name AS cluster FROM nation UNION ALL SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), p_brand FROM part) GROUP BY 1),
  a AS (SELECT DISTINCT label FROM (SELECT upper(n_name) AS label FROM nation UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT r_name FROM region)),
  f AS (SELECT label, unnest([label, lower(label), trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), regexp_replace(lower(label), '[^a-z0-9]', '', 'g')]) AS raw, unnest([0, 1, 2, 3]) AS form FROM a),
  b AS (SELECT label, min({'form': form, 'cluster': cluster}) AS b FROM f JOIN m USING (raw) GROUP BY 1) SELECT label, b.cluster, b.form FROM a LEFT JOIN b USING (label)""")
def cluster_lookup(spark, d):
    nation, part, region = (read_table(spark, d, t) for t in ("nation", "part", "region"))
    mapping = nation.select(F.lower("n_name").alias("raw"), F.col("n_name").alias("cluster")).union(part.select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", ""), "p_brand"))
    labels = nation.select(F.upper("n_name").alias("label")).union(part.select(F.upper("p_name"))).union(region.select("r_name"))
    return me.cluster_lookup(labels, mapping)


@query("""WITH n AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2), w AS (SELECT p_type, p_name, n, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM n),
  z AS (SELECT p_type, p_name, count(*) AS size FROM w GROUP BY 1, 2),
  o AS (SELECT a.p_type, a.p_name, b.p_name AS sib, b.n AS uses, count(*) AS common FROM w a JOIN w b ON a.p_type = b.p_type AND a.w = b.w GROUP BY 1, 2, 3, 4)
  SELECT n.p_type, n.p_name, any_value(n.n) AS n, first(sib ORDER BY uses DESC, sib) AS snapped FROM n JOIN z USING (p_type, p_name) JOIN o USING (p_type, p_name) WHERE common >= 0.5 * size GROUP BY 1, 2""")
def snapped_labels(spark, d):
    return me.sibling_snap(read_table(spark, d, "part"), ["p_type"], "p_name", 0.5)


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min({'o_orderdate': o_orderdate, 'o_orderkey': o_orderkey}) AS o FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, o_orderpriority, o.o_orderdate, o.o_orderkey FROM f)
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderpriority))::INT AS rank FROM r) WHERE rank <= 3""")
def diverse_examples(spark, d):
    return me.diverse_examples(read_table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"], 3)


@query("""WITH c AS (SELECT event_type, greatest(quantile_cont(value, 0.7), 30) AS cut FROM events GROUP BY 1)
  SELECT * FROM (SELECT event_type, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id))::INT AS rank FROM events JOIN c USING (event_type) WHERE value > cut) WHERE rank <= 25""")
def flagged_scores(spark, d):
    return me.flag_high(read_table(spark, d, "events"), ["event_type"], "event_id", "value", 0.7, 30.0, 25)


@query("""SELECT count(*) AS n_synonyms, count(*) FILTER (c_name IS NULL) AS n_orphans, count(*) FILTER (c_name <> o_orderpriority) AS n_mismatched
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey""")
def vocabulary_audit(spark, d):
    terms = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return me.audit(terms, read_table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label")))


@query("""WITH r AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r, count(*) OVER () AS m FROM part GROUP BY 1)
  SELECT p_partkey, CASE WHEN m <= 8 OR r < 8 THEN p_name ELSE 'Other' END AS binned FROM part JOIN r USING (p_name)""")
def binned_labels(spark, d):
    return me.top_or_other(read_table(spark, d, "part"), "p_name", 8).select("p_partkey", "binned")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, least(floor((o_totalprice - lo) * 12 / (hi - lo)), 11)::INT AS bin FROM orders, e""")
def binned_numbers(spark, d):
    return me.equal_width(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bin")


@query("""SELECT unnest([{'column': 'text', 'n_rows': n, 'n_present': t, 'pct_present': 100 * t / n}, {'column': 'lang', 'n_rows': n, 'n_present': l, 'pct_present': 100 * l / n}], recursive := true)
  FROM (SELECT count(*) AS n, count(text) AS t, count(lang) AS l FROM documents)""")
def data_report(spark, d):
    return me.data_report(read_table(spark, d, "documents"), ["text", "lang"])


@query("""SELECT doc_id, quality::VARCHAR AS verdict FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def priority_verdicts(spark, d):
    judged = read_table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("verdict"))
    return me.priority_union([judged, read_table(spark, d, "documents").select("doc_id", F.col("lang").alias("verdict"))], ["doc_id"])
