"""Queries of planted distribution classes, label vectors, cohorts of labels and anomalous values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as an
from ..operators import distributions as ds
from ..operators import labelvectors as lv
from ..registry import query
from ..session import materialize, read_table
from .catalog import rounded


@query("""WITH g AS (SELECT l_suppkey, l_suppkey % 6 AS kind, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT 'S' || l_suppkey AS gene, CASE WHEN kind = 4 THEN 10 ELSE n END::BIGINT AS n, CASE WHEN kind = 4 OR n < 20 THEN 'Not Enough Data' WHEN kind = 0 THEN 'Effectively Constant'
  WHEN kind = 1 THEN 'Bimodal' WHEN kind = 2 THEN 'Multimodal' WHEN kind = 3 THEN 'Uniform' ELSE 'Normal' END AS distribution FROM g WHERE kind <> 4 OR n >= 10""")
def planted_distribution_classes(spark, d):
    """Line items of a supplier, spread evenly by rank over a shape that its key names: so SQL knows the class."""
    items = read_table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    one = items.withColumn("k", F.expr("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate)"))
    one = one.withColumn("n", F.expr("count(*) OVER (PARTITION BY l_suppkey)")).withColumn("u", F.expr("(k - 0.5D) / n"))
    near = lambda u: F.when(u < 0.5, F.sqrt(2 * u)).otherwise(2 - F.sqrt(2 - 2 * u))  # noqa: E731  a triangle from 0 to 2
    half, third = F.expr("u * 2 % 1"), F.expr("u * 3 % 1")
    odds = F.log(F.col("u") / (1 - F.col("u")))  # the logistic quantile, bent towards the normal one by its cube
    normal = 0.6037 * odds - 0.00433 * odds * odds * odds
    value = (
        F.when(F.expr("l_suppkey % 6 = 0"), 1.0)
        .when(F.expr("l_suppkey % 6 = 1"), near(half) + 9 * F.floor(F.col("u") * 2))
        .when(F.expr("l_suppkey % 6 = 2"), near(third) + 9 * F.floor(F.col("u") * 3))
        .when(F.expr("l_suppkey % 6 = 4"), F.when(F.col("k") <= 10, F.col("u")))
        .when(F.expr("l_suppkey % 6 = 3"), F.col("u"))
        .otherwise(normal)
    )
    planted = materialize(one.select(F.concat(F.lit("S"), "l_suppkey").alias("gene"), value.alias("value")), "planted-values")  # read twice, sorted once
    return ds.distribution_classes(planted)


def _terms(source: str, text: str) -> str:
    """DuckDB SQL of (``*``, term) for each n-gram within the words of ``text``, repeated ones too."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')"
    return f"""SELECT s.*, substr(w, i::INT, k::INT) AS term FROM {source} s, unnest(list_transform({words}, lambda w: ' ' || w || ' ')) AS a(w),
      unnest(range(3, least(5, length(w)) + 1)) AS b(k), unnest(range(1, length(w) - k + 2)) AS c(i)"""


LABELS = """l AS (SELECT p_name || CASE WHEN p_size % 5 = 0 THEN ' (' || lower(p_type) || ')' WHEN p_size % 11 = 0 THEN ' -- ' || p_type ELSE '' END AS label, count(*) AS n FROM part GROUP BY 1)"""


def labels(spark, d):
    name = F.when(F.expr("p_size % 5 = 0"), F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")"))).when(F.expr("p_size % 11 = 0"), F.concat("p_name", F.lit(" -- "), "p_type"))
    return read_table(spark, d, "part").withColumn("value", F.coalesce(name, "p_name"))


VECTORS = f"""t AS (SELECT label, n, term, count(*) AS tf FROM ({_terms("l", "label")}) GROUP BY ALL), f AS (SELECT term, sum(n) AS df FROM t GROUP BY 1),
  r AS (SELECT label, n, term, tf * (ln((1 + (SELECT sum(n) FROM l)) / (1 + df)) + 1) AS w FROM t JOIN f USING (term)),
  vec AS (SELECT label, n, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM r)"""


@query(f"WITH {LABELS}, {VECTORS} SELECT label, n AS n_samples, term, round(w, 6) AS weight FROM vec")
def label_term_weights(spark, d):
    return rounded(lv.label_vectors(labels(spark, d), "value"))


#: Three kinds of samples, told apart by their labels alone.
KINDS = ("MCF7 tamoxifen 24h", "MCF7 DMSO control 24h", "A549 cisplatin 48h")


@query("""WITH r AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey % 3) AS first FROM part)
  SELECT p_partkey, first, 3 AS k, true AS stable FROM r""")
def label_cohort_members(spark, d):
    """Each sample, the smallest key of its cohort, and whether the cohort reaches a bootstrap Jaccard of 0.8."""
    text = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = read_table(spark, d, "part").select("p_partkey", F.concat(text, F.lit(" rep"), F.col("p_size") % 8).alias("text"))
    cohorts = lv.label_cohorts(rows, "p_partkey", "text", range(2, 6))
    stable = lv.cohort_stability(cohorts, "p_partkey", replicates=10)
    first = cohorts.groupBy("cluster").agg(F.min("p_partkey").alias("first"))
    return cohorts.join(first, "cluster").join(stable, "cluster").select("p_partkey", "first", "k", (F.col("bootstrap_jaccard") >= 0.8).alias("stable"))


SAMPLES = f"""s AS (SELECT p_brand, p_partkey, p_name || CASE WHEN p_size % 5 = 0 THEN ' (' || lower(p_type) || ')' WHEN p_size % 11 = 0 THEN ' -- ' || p_type ELSE '' END AS value,
    CASE WHEN p_size = 7 THEN '' ELSE 'name: ' || p_name || '; type: ' || p_type || ', size ' || p_size END AS text FROM part),
  {LABELS}, {VECTORS}, v AS (SELECT p_brand, value, count(*) AS n FROM s GROUP BY 1, 2), size AS (SELECT p_brand, sum(n) AS size FROM v GROUP BY 1),
  gv AS (SELECT p_brand, value, v.n, term, w FROM v JOIN vec ON value = label), cent AS (SELECT p_brand, term, sum(n * w) AS s FROM gv GROUP BY 1, 2),
  cl AS (SELECT p_brand, sqrt(sum(s * s)) AS len FROM cent GROUP BY 1), dot AS (SELECT p_brand, value, sum(w * s) AS d FROM gv JOIN cent USING (p_brand, term) GROUP BY 1, 2),
  pair AS (SELECT a.p_brand, a.value, b.value AS other, coalesce(sum(x.w * y.w), 0) AS sim, any_value(b.n) AS n FROM v a JOIN v b ON a.p_brand = b.p_brand
    JOIN vec x ON x.label = a.value LEFT JOIN vec y ON y.label = b.value AND y.term = x.term GROUP BY ALL),
  cop AS (SELECT p_brand, value, other, sim, i FROM pair, unnest(range(n - (other = value)::INT)) AS u(i)),
  knn AS (SELECT p_brand, value, avg(sim) AS m FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, value ORDER BY sim DESC) AS k FROM cop) WHERE k <= 5 GROUP BY 1, 2),
  g0 AS (SELECT p_brand, value, n, substr('^' || value || '$', i::INT, 3) AS g FROM v, unnest(range(1, length(value) + 1)) AS u(i)),
  g1 AS (SELECT p_brand, value, n, g, count(*) AS c FROM g0 GROUP BY ALL), pool AS (SELECT p_brand, g, sum(n * c) AS pc FROM g1 GROUP BY 1, 2), pt AS (SELECT p_brand, sum(pc) AS pt FROM pool GROUP BY 1),
  jj AS (SELECT p_brand, value, pool.g, coalesce(g1.c, 0) AS c, pc - coalesce(g1.c, 0) AS o, sum(coalesce(g1.c, 0)) OVER w AS ct, sum(pc - coalesce(g1.c, 0)) OVER w AS ot
    FROM v JOIN pool USING (p_brand) LEFT JOIN g1 USING (p_brand, value, g) WINDOW w AS (PARTITION BY p_brand, value)),
  js AS (SELECT p_brand, value, sum(CASE WHEN c > 0 THEN c / ct * log2(2 * (c / ct) / (c / ct + o / greatest(ot, 1))) / 2 ELSE 0 END
    + CASE WHEN o > 0 THEN o / ot * log2(2 * (o / ot) / (c / ct + o / ot)) / 2 ELSE 0 END) AS js FROM jj GROUP BY 1, 2),
  jm AS (SELECT p_brand, max(js) AS m FROM js GROUP BY 1),
  sp AS (SELECT DISTINCT value, text, unnest(list_distinct(list_filter(list_concat(list_transform(string_split(text, chr(10)), lambda p: trim(p)), list_transform(regexp_split_to_array(text, '[;\\n]'), lambda p: trim(p)),
    list_transform(regexp_split_to_array(text, '[;\\n]'), lambda p: trim(regexp_extract(trim(p), '^([A-Za-z_][A-Za-z0-9_ ]{{0,30}})\\s*:\\s*(.+)', 2))), list_transform(string_split(text, ','), lambda p: trim(p))),
    lambda p: length(p) >= 3))) AS span FROM s WHERE text <> ''),
  st AS (SELECT value, text, span, term, count(*) AS tf FROM ({_terms("sp", "span")}) GROUP BY ALL),
  sw AS (SELECT st.*, tf * (ln((1 + (SELECT sum(n) FROM l)) / (1 + coalesce(df, 0))) + 1) AS q FROM st LEFT JOIN f USING (term)),
  ss AS (SELECT value, text, span, sum(q * coalesce(w, 0)) / sqrt(sum(q * q)) AS sim FROM sw LEFT JOIN vec ON label = value AND vec.term = sw.term GROUP BY 1, 2, 3), ev AS (SELECT value, text, max(sim) AS sim FROM ss GROUP BY 1, 2),
  m AS (SELECT p_brand, p_partkey, value, text, length(value) AS len, length(regexp_replace(value, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(value), 1) AS pu FROM s),
  z AS (SELECT *, least(1, abs(len - avg(len) OVER w) / (stddev_pop(len) OVER w + 1e-9) / 3) AS lz, least(1, abs(pu - avg(pu) OVER w) / (stddev_pop(pu) OVER w + 1e-9) / 3) AS pz FROM m WINDOW w AS (PARTITION BY p_brand)),
  sig AS (SELECT p_brand, p_partkey, value, CASE WHEN size < 2 THEN 0 ELSE greatest(0, least(1, 1 - d / (len2 + 1e-9 * size))) END::DOUBLE AS consensus,
    CASE WHEN text = '' THEN 1 ELSE greatest(0, least(1, 1 - ev.sim)) END::DOUBLE AS evidence, CASE WHEN size < 2 THEN 0 ELSE greatest(0, least(1, 1 - knn.m)) END::DOUBLE AS knn_ood, lz AS length_z, pz AS punct_z,
    CASE WHEN jm.m > 1e-9 THEN js / jm.m ELSE js END AS ngram_div
    FROM z JOIN size USING (p_brand) JOIN (SELECT p_brand, len AS len2 FROM cl) USING (p_brand) JOIN dot USING (p_brand, value) LEFT JOIN knn USING (p_brand, value) JOIN js USING (p_brand, value) JOIN jm USING (p_brand)
    LEFT JOIN ev USING (value, text)), susp AS (SELECT *, greatest(consensus, evidence, knn_ood, length_z, punct_z, ngram_div) AS suspicion FROM sig)"""


def screened(spark, d):
    text = F.when(F.col("p_size") == 7, F.lit("")).otherwise(F.concat(F.lit("name: "), "p_name", F.lit("; type: "), "p_type", F.lit(", size "), F.col("p_size").cast("string")))
    return an.anomaly_signals(labels(spark, d).withColumn("text", text), ["p_brand"], "p_partkey", "value", "text")


@query(f"WITH {SAMPLES} SELECT p_brand, p_partkey, value, round(consensus, 6) AS consensus, round(evidence, 6) AS evidence, round(knn_ood, 6) AS knn_ood, round(length_z, 6) AS length_z, round(punct_z, 6) AS punct_z, round(ngram_div, 6) AS ngram_div, round(suspicion, 6) AS suspicion FROM susp")
def label_anomaly_signals(spark, d):
    return rounded(screened(spark, d))


@query(f"""WITH {SAMPLES}, rounded AS (SELECT p_brand, p_partkey, value, round(consensus, 9) AS consensus, round(evidence, 9) AS evidence, round(knn_ood, 9) AS knn_ood, round(length_z, 9) AS length_z, round(punct_z, 9) AS punct_z,
    round(ngram_div, 9) AS ngram_div, round(suspicion, 9) AS suspicion FROM susp), cut AS (SELECT p_brand, greatest(0.3, quantile_cont(suspicion, 0.7)) AS cut FROM rounded GROUP BY 1),
  fl AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY suspicion DESC, p_partkey))::INT AS rank FROM rounded JOIN cut USING (p_brand) WHERE suspicion > cut QUALIFY rank <= 25),
  clean AS (SELECT p_brand, value, count(*) AS n FROM rounded ANTI JOIN fl USING (p_partkey) GROUP BY 1, 2),
  sib AS (SELECT p_brand, value, max(round(sim, 6)) AS sim FROM pair WHERE (p_brand, other) IN (SELECT (p_brand, value) FROM clean) GROUP BY 1, 2), big AS (SELECT p_brand, value, sum(n) FILTER (sim > 0.85) AS c FROM pair GROUP BY 1, 2)
  SELECT p_brand, p_partkey, value, round(suspicion, 6) AS suspicion, rank, coalesce(sim, 0)::DOUBLE AS nearest_sim, coalesce(sim >= 0.35, false) AS has_sibling, coalesce(c, 0)::BIGINT AS cluster_size,
    list_transform(list_sort([{{'v': -consensus, 'i': 0, 'x': 'consensus'}}, {{'v': -evidence, 'i': 1, 'x': 'evidence'}}, {{'v': -knn_ood, 'i': 2, 'x': 'knn_ood'}}, {{'v': -length_z, 'i': 3, 'x': 'length_z'}}, {{'v': -punct_z, 'i': 4, 'x': 'punct_z'}},
      {{'v': -ngram_div, 'i': 5, 'x': 'ngram_div'}}])[1:3], lambda e: e.x) AS top_signals FROM fl LEFT JOIN sib USING (p_brand, value) LEFT JOIN big USING (p_brand, value)""")
def flagged_labels(spark, d):
    found = an.flag_anomalies(rounded(screened(spark, d), 9), ["p_brand"], "p_partkey")
    return rounded(found.withColumn("has_sibling", F.col("nearest_sibling").isNotNull()).drop("nearest_sibling"))
