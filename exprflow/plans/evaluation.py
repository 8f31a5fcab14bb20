"""Queries of attached and corrected labels, evaluation items, memory tiers, masked neighbours, group distances and content hashes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as de
from ..operators import evaluation as ev
from ..operators import neighbours as nb
from ..operators import recollection as rc
from ..operators import siblings as sb
from ..registry import query
from ..session import read_table
from ..sources import platform, views
from .catalog import X, rounded


@query("""WITH m AS (SELECT c_nationkey, min((c_mktsegment, c_name)) AS m FROM customer GROUP BY 1)
  SELECT s_suppkey, s_nationkey, s_acctbal, m[1] AS series_id, m[2] AS "Classified_name" FROM supplier LEFT JOIN m ON s_nationkey = c_nationkey AND s_nationkey % 5 <> 0""")
def attached_labels(spark, d):
    """Suppliers with what the first customer of their nation says, met by ids of other spelling; every fifth nation has none."""
    rows = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.concat(F.lit(" gsm"), "s_nationkey").alias("GSM"))
    meta = read_table(spark, d, "customer").where("c_nationkey % 5 <> 0").select(F.concat(F.lit("GSM"), "c_nationkey", F.lit(" ")).alias("GSM"), F.col("c_mktsegment").alias("series_id"), F.col("c_name").alias("Classified_name"))
    return ev.attach(rows, meta, ["GSM"]).drop("GSM")


@query("""WITH v AS (SELECT o_orderkey AS gsm, 'status' AS field, o_orderstatus AS value FROM orders), c AS (SELECT l_orderkey AS gsm, CASE WHEN l_linenumber = 7 THEN 'flag' ELSE 'status' END AS field, l_returnflag || l_linestatus AS suggest,
    l_linenumber AS ln FROM lineitem WHERE l_quantity > 45), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY gsm, field ORDER BY ln DESC, suggest) = 1)
  SELECT coalesce(v.gsm, k.gsm) AS gsm, coalesce(v.field, k.field) AS field, CASE WHEN k.gsm IS NOT NULL THEN suggest ELSE value END AS value, CASE WHEN k.gsm IS NOT NULL THEN coalesce(value, '') END AS was, 'r' || ln AS reason, NULL::VARCHAR AS quote
  FROM v FULL JOIN (SELECT * FROM k WHERE gsm IN (SELECT gsm FROM v)) k ON v.gsm = k.gsm AND v.field = k.field""")
def corrected_labels(spark, d):
    values = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("gsm"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    fixes = read_table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_orderkey").alias("gsm"), F.when(F.col("l_linenumber") == 7, "flag").otherwise("status").alias("field"), F.concat("l_returnflag", "l_linestatus").alias("suggest"),
        F.concat(F.lit("r"), "l_linenumber").alias("reason"), F.lit(None).cast("string").alias("quote"), F.col("l_linenumber").alias("at"),
    )
    return ev.apply_corrections(values, fixes)


PHASES = """a AS (SELECT p_partkey AS gsm, CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE p_name END AS Tissue, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_type END AS Condition FROM part),
  b AS (SELECT p_partkey AS gsm, CASE WHEN p_size % 8 = 0 THEN 'unknown' ELSE split_part(p_name, ' ', 2) END AS Tissue, lower(p_type) AS Condition FROM part)"""


def phases(spark, d):
    part = read_table(spark, d, "part")
    first = part.selectExpr("p_partkey AS gsm", "CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE p_name END AS Tissue", "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_type END AS Condition")
    return first, part.selectExpr("p_partkey AS gsm", "CASE WHEN p_size % 8 = 0 THEN 'unknown' ELSE split_part(p_name, ' ', 2) END AS Tissue", "lower(p_type) AS Condition")


LONG = """x AS (SELECT a.gsm::VARCHAR AS gsm, 'Tissue' AS field, coalesce(a.Tissue, '') AS was, coalesce(b.Tissue, '') AS value FROM a JOIN b USING (gsm)
  UNION ALL SELECT a.gsm::VARCHAR, 'Condition', coalesce(a.Condition, ''), coalesce(b.Condition, '') FROM a JOIN b USING (gsm))"""
SAYS = "lower({}) NOT IN ('not specified', 'n/a', 'na', 'none', 'unknown', 'null', '', '-')"


@query(f"WITH {PHASES}, {LONG} SELECT gsm, field, was, value, 'correction' AS kind FROM x WHERE NOT {SAYS.format('was')} AND {SAYS.format('value')} UNION ALL SELECT gsm, field, was, value, 'normalization' FROM x WHERE {SAYS.format('was')} AND was <> value UNION ALL SELECT gsm, field, was, was, 'prediction' FROM x WHERE {SAYS.format('was')}")
def evaluation_items(spark, d):
    a, b = phases(spark, d)
    fields = ["Tissue", "Condition"]
    told = ev.prediction_items(a, "gsm", fields).select("gsm", "field", F.col("value").alias("was"), "value", F.lit("prediction").alias("kind"))
    fixed = ev.correction_items(a, b, "gsm", fields).withColumn("kind", F.lit("correction"))
    return told.unionByName(fixed).unionByName(ev.normalization_items(a, b, "gsm", fields).withColumn("kind", F.lit("normalization")))


@query(f"""WITH {PHASES}, n AS (SELECT 'Tissue' AS field, (SELECT count(DISTINCT Tissue) FROM a) AS n_before, (SELECT count(DISTINCT Tissue) FROM b) AS n_after, (SELECT count(*) FROM a JOIN b USING (gsm) WHERE a.Tissue IS DISTINCT FROM b.Tissue) AS n_changed
  UNION ALL SELECT 'Condition', (SELECT count(DISTINCT Condition) FROM a), (SELECT count(DISTINCT Condition) FROM b), (SELECT count(*) FROM a JOIN b USING (gsm) WHERE a.Condition IS DISTINCT FROM b.Condition))
  SELECT field, n_before, n_after, n_before - n_after AS merged, round(100 * (n_before - n_after) / greatest(n_before, 1), 6) AS pct_merged, n_changed FROM n""")
def label_diversity(spark, d):
    return rounded(ev.label_diversity(*phases(spark, d), "gsm", ["Tissue", "Condition"]))


CLUSTERS = """c AS (SELECT p_brand AS col, p_type AS cluster, CASE p_size % 3 WHEN 0 THEN 'Tissue: ' || p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS raw FROM part)"""


def clusters(spark, d):
    return read_table(spark, d, "part").selectExpr("p_brand AS col", "p_type AS cluster", "CASE p_size % 3 WHEN 0 THEN 'Tissue: ' || p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS raw")


FORMS = """o AS (SELECT DISTINCT col, cluster, unnest([cluster, raw]) AS t FROM c), w AS (SELECT *, CASE WHEN lower(t) LIKE 'tissue:%' THEN trim(substr(t, 8)) ELSE t END AS b FROM o),
  f AS (SELECT col, cluster, t, unnest([t, lower(t), trim(regexp_replace(regexp_replace(lower(t), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g')), b, lower(b), trim(regexp_replace(regexp_replace(lower(b), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g'))]) AS raw FROM w),
  g AS (SELECT col, raw, min((CASE WHEN raw IN (t, lower(t)) THEN 0 ELSE 1 END, cluster)) AS m FROM f GROUP BY 1, 2), mp AS (SELECT col, raw, m[2] AS cluster FROM g)"""


@query(f"WITH {CLUSTERS}, {FORMS} SELECT col, raw, cluster FROM mp")
def remembered_forms(spark, d):
    return rc.cluster_map(clusters(spark, d))


@query(f"""WITH {CLUSTERS}, {FORMS}, t AS (SELECT DISTINCT col, raw AS subject, cluster AS object FROM c), ask AS (SELECT DISTINCT p_brand AS col, 'tissue: ' || upper(p_name) AS label FROM part UNION SELECT DISTINCT col, raw FROM c),
  k AS (SELECT col, label, lower(label) AS f FROM ask UNION SELECT col, label, label FROM ask UNION SELECT col, label, CASE WHEN lower(label) LIKE 'tissue:%' THEN trim(substr(label, 8)) ELSE label END FROM ask),
  e AS (SELECT col, label, [label, lower(label), trim(regexp_replace(regexp_replace(lower(label), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g')), b, lower(b), trim(regexp_replace(regexp_replace(lower(b), '[-_/]', ' ', 'g'), '\\s+', ' ', 'g'))] AS fs
    FROM (SELECT *, CASE WHEN lower(label) LIKE 'tissue:%' THEN trim(substr(label, 8)) ELSE label END AS b FROM ask)),
  h AS (SELECT e.col, label, arg_min(cluster, i) AS answer FROM e, unnest(range(1, 7)) AS u(i) JOIN mp ON mp.col = e.col AND mp.raw = fs[i] GROUP BY 1, 2),
  lg AS (SELECT p_brand AS col, p_name AS label, p_type AS canonical, count(*) AS n, round(avg(p_size / 50), 6) AS conf FROM part GROUP BY 1, 2, 3),
  ep AS (SELECT col, label, canonical, conf, (row_number() OVER (PARTITION BY col, label ORDER BY n DESC, conf DESC, canonical))::INT AS rank FROM lg),
  r AS (SELECT ask.col, label, object, (row_number() OVER (PARTITION BY ask.col, label ORDER BY object))::INT AS rank FROM ask JOIN t ON t.col = ask.col AND subject = label)
  SELECT col, label, 'cluster' AS tier, 1 AS rank, answer, 1.0::DOUBLE AS score FROM h UNION ALL SELECT col, label, 'episodic', rank, canonical, conf FROM ep JOIN ask USING (col, label) WHERE rank <= 5
  UNION ALL SELECT col, label, 'relation', rank, object, 1.0 FROM r WHERE rank <= 5""")
def remembered_answers(spark, d):
    """What three tiers know of labels: spellings that no table holds, and the raw labels themselves."""
    known, part = clusters(spark, d), read_table(spark, d, "part")
    log = part.select(F.col("p_brand").alias("col"), F.col("p_name").alias("raw"), F.col("p_type").alias("canonical"), (F.col("p_size") / 50).alias("confidence"), F.col("p_partkey").alias("at"))
    asked = part.select(F.col("p_brand").alias("col"), F.concat(F.lit("tissue: "), F.upper("p_name")).alias("label")).union(known.select("col", "raw")).distinct()
    return rounded(rc.search(asked, rc.cluster_map(known), log, rc.relations(known)))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.l * b.l) AS similarity FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label),
  r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id))::INT AS rank, id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0) SELECT * FROM r WHERE rank <= 5""")
def nearest_in_category(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rounded(nb.nearest_vectors(e.where("id % 20 = 0"), e, 5, 0.0, "label"))


@query(f"""{X}, v AS (SELECT gene, platform AS g, value AS v FROM expr WHERE value IS NOT NULL), k AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM v) a JOIN (SELECT DISTINCT g FROM v) b ON a.g < b.g),
  j AS (SELECT gene, a, b, v, count(*) FILTER (g = a) AS c1, count(*) FILTER (g = b) AS c0 FROM v JOIN k ON g IN (a, b) GROUP BY ALL),
  n AS (SELECT *, sum(c1) OVER p AS n1, sum(c0) OVER p AS n0, sum(c1) OVER w AS s1, sum(c0) OVER w AS s0, lead(v) OVER w - v AS step, min(v) OVER p AS lo, max(v) OVER p AS hi FROM j WINDOW p AS (PARTITION BY gene, a, b), w AS (PARTITION BY gene, a, b ORDER BY v)),
  m AS (SELECT gene, a, b, sum(abs(s1 / n1 - s0 / n0) * coalesce(step, 0)) AS wasserstein, abs(sum(c1 * v) / any_value(n1) - sum(c0 * v) / any_value(n0)) AS delta_mean FROM n GROUP BY 1, 2, 3),
  h AS (SELECT gene, a, b, least(floor((v - lo) * 49 / (hi - lo)), 48) AS bin, sum(c1) / any_value(n1) AS p, sum(c0) / any_value(n0) AS q FROM n GROUP BY ALL),
  s AS (SELECT gene, a, b, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM h GROUP BY 1, 2, 3)
  SELECT gene, a, b, round(wasserstein, 6) AS wasserstein, round(delta_mean, 6) AS delta_mean, round(js, 6) AS js FROM m JOIN s USING (gene, a, b)""")
def group_distances(spark, d):
    return rounded(de.group_distances(views.expression(spark, d), "platform"))


SIBLINGS = """s AS (SELECT p_brand AS g, p_partkey AS k, CASE p_size % 6 WHEN 0 THEN ' Not Specified ' WHEN 1 THEN p_type || '; ' || p_name WHEN 2 THEN NULL ELSE p_type || ' ' END AS v, p_name AS o, p_size FROM part),
  t AS (SELECT *, CASE WHEN trim(v) <> '' AND lower(trim(v)) <> 'not specified' THEN trim(v) END AS w FROM s)"""


def siblings(spark, d):
    value = "CASE p_size % 6 WHEN 0 THEN ' Not Specified ' WHEN 1 THEN p_type || '; ' || p_name WHEN 2 THEN NULL ELSE p_type || ' ' END AS v"
    return read_table(spark, d, "part").selectExpr("p_brand AS g", "p_partkey AS k", value, "p_name AS o", "p_size")


@query(f"""WITH {SIBLINGS}, n AS (SELECT g, w, count(*) AS n FROM t WHERE w IS NOT NULL AND p_size % 4 <> 0 GROUP BY 1, 2), m AS (SELECT g, arg_min(w, (-n, w)) AS mode FROM n GROUP BY 1)
  SELECT g, k, CASE WHEN p_size % 5 = 0 THEN 'sib' ELSE coalesce(mode, '') END AS near, list_filter(['parser', CASE WHEN w IS NOT NULL AND NOT contains(v, ';') AND p_size / 50 < 0.5 AND p_size % 3 / 4 > 0.25 THEN 'fieldname' END,
    CASE WHEN w IS NULL AND mode IS NOT NULL THEN 'ns' END, CASE WHEN contains(coalesce(v, ''), ';') THEN 'composite' END], lambda x: x IS NOT NULL) AS specialists FROM t LEFT JOIN m USING (g) WHERE p_size % 4 = 0""")
def specialist_rows(spark, d):
    rows = siblings(spark, d)
    flags = rows.where("p_size % 4 = 0").selectExpr("g", "k", "v AS value", "p_size / 50 AS punct_z", "p_size % 3 / 4 AS evidence", "CASE WHEN p_size % 5 = 0 THEN 'sib' WHEN p_size % 7 = 0 THEN '' END AS nearest_sibling")
    return sb.specialist_gates(flags, sb.sibling_mode(rows, ["g"], "v", F.expr("p_size % 4 = 0")), ["g"]).select("g", "k", "near", "specialists")


@query(f"""WITH {SIBLINGS}, n AS (SELECT g, w, count(*) AS n, min((k::VARCHAR, o)) AS f FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w IS NULL, n DESC, w) AS i, row_number() OVER (PARTITION BY g ORDER BY w IS NULL, f) AS j FROM n),
  a AS (SELECT g, sum(n) AS total, coalesce(sum(n) FILTER (w IS NOT NULL), 0) AS named, string_agg('"' || w || '" (n=' || n || ')', '; ' ORDER BY i) FILTER (i <= 5 AND w IS NOT NULL) AS line,
    string_agg(printf('  [%4d]  %s', n, w), chr(10) ORDER BY i) FILTER (w IS NOT NULL) AS lab, string_agg('  ' || f[1] || '    v: ' || w || '  |  o: ' || f[2], chr(10) ORDER BY j) FILTER (w IS NOT NULL AND j <= 5) AS ex FROM r GROUP BY 1)
  SELECT g, coalesce(line, '(none)') AS line, 'Experiment title  : ' || g || chr(10) || printf('Total samples    : %d  |  Labeled v: %d  |  Still NS     : %d', total::BIGINT, named::BIGINT, (total - named)::BIGINT) || chr(10)
    || CASE WHEN lab IS NULL THEN chr(10) || 'No v labels assigned yet in this experiment.' ELSE chr(10) || 'Known v labels in this experiment:' || chr(10) || lab || chr(10) || chr(10) || 'Example labeled samples:' || chr(10) || ex END AS block FROM a""")
def sibling_context(spark, d):
    rows = siblings(spark, d)
    meta = rows.select("g", F.col("g").alias("title"), F.lit(" ").alias("summary"), F.lit(None).cast("string").alias("design"))
    return sb.sibling_line(rows, ["g"], "v").join(sb.context_blocks(rows, "g", "k", "v", "o", meta), "g")


REGIONS = [("low A", "GPL_A", "g1", -9.0, -0.05), ("high B", "GPL_B", "G2", 0.05, 9.0), ("mid A", "GPL_A", "g1", -0.1, 0.1)]


@query(f"""{X}, r(region, platform, gene, low, high) AS (VALUES {", ".join(str(r) for r in REGIONS)}), p AS (SELECT e.sample_id, e.value, r.region, e.platform, e.gene FROM expr e JOIN r ON e.platform = r.platform AND upper(e.gene) = upper(r.gene) AND value BETWEEN low AND high)
  SELECT p.sample_id::VARCHAR AS sample_id, round(value, 6) AS value, region, platform, gene, source AS series_id, lang AS "Classified_lang" FROM p LEFT JOIN documents ON doc_id = sample_id""")
def compared_regions(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("series_id"), F.col("lang").alias("Classified_lang"))
    regions = spark.createDataFrame(REGIONS, "region string, platform string, gene string, low double, high double")
    return rounded(sb.region_comparison(views.expression(spark, d), regions, docs.select("sample_id", "series_id"), docs.select("sample_id", "Classified_lang")))


TECHNOLOGIES = ["high-throughput sequencing", "in situ oligonucleotide", "SAGE", "mixed set", "", "Oligonucleotide Beads"]
TITLES = ["Illumina HiSeq 2000 (Homo sapiens)", "10x Genomics Chromium", "Infinium 450K", "ATAC-seq library", "Affymetrix U133", "total  RNA panel", "CUT&RUN kit"]


def _class_sql(tech: str, title: str) -> str:
    both = f"(lower({tech}) || ' ' || lower({title}))"
    any_ = lambda patterns: f"regexp_matches({both}, '{'|'.join(patterns)}')"
    seq = f"(contains(lower({tech}), 'sequencing') OR lower({tech}) IN ('sage', 'mpss'))"
    return f"""CASE WHEN {any_(platform.SINGLE_CELL)} THEN 'single-cell' WHEN {any_(platform.METHYLATION)} THEN 'methylation' WHEN {seq} AND {any_(platform.OTHER_SEQUENCING)} THEN 'sequencing-other'
      WHEN {seq} AND {any_(platform.BULK_RNA)} THEN 'bulk-rna-seq' WHEN {seq} THEN 'sequencing-other' WHEN regexp_matches(lower({tech}), 'oligonucleotide|spotted|cdna|array|bead') THEN 'microarray'
      WHEN {any_(platform.BULK_RNA)} THEN 'bulk-rna-seq' WHEN {any_(platform.OTHER_SEQUENCING)} THEN 'sequencing-other' ELSE 'other' END"""


@query(f"""WITH p AS (SELECT p_partkey, ({TECHNOLOGIES})[(p_partkey % 6 + 1)::INT] AS tech, ({TITLES})[(p_partkey % 7 + 1)::INT] || ' ' || p_name AS title FROM part) SELECT p_partkey, {_class_sql("tech", "title")} AS technology FROM p""")
def platform_technologies(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    return read_table(spark, d, "part").select("p_partkey", platform.technology(pick(TECHNOLOGIES, 6), F.concat(pick(TITLES, 7), F.lit(" "), "p_name")).alias("technology"))


@query("""WITH n AS (SELECT n_name AS name FROM nation), a AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'nation_' || c_nationkey WHEN 2 THEN '_' || c_nationkey ELSE NULL END AS asked FROM customer)
  SELECT asked, arg_min(name, (CASE WHEN name = coalesce(asked, '') THEN 0 WHEN lower(name) = lower(coalesce(asked, '')) THEN 1 WHEN coalesce(asked, '') <> '' AND (contains(lower(name), lower(asked)) OR contains(lower(asked), lower(name))) THEN 2 ELSE 3 END, name)) AS name
  FROM a, n GROUP BY 1""")
def matched_platforms(spark, d):
    asked = read_table(spark, d, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'nation_' || c_nationkey WHEN 2 THEN '_' || c_nationkey ELSE NULL END AS asked")
    return platform.match_platform(read_table(spark, d, "nation").selectExpr("n_name AS name"), asked)
