"""Queries over the driver's tables, one or more for each family of operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cohorts as co
from ..operators import labels as lb
from ..operators import normalize as nm
from ..operators import search as se
from ..operators import statistics as st
from ..operators import summarize as su
from ..registry import query
from ..session import read_table
from ..sources import views
from ..sources.views import CELLS_SQL, COUNTS_SQL, EXPRESSION_SQL
from ..streaming import bus

X, C, E = f"WITH {EXPRESSION_SQL}", f"WITH {COUNTS_SQL}", f"WITH {CELLS_SQL}"
PAIR = f"{X}, p AS (SELECT gene, value, label = 0 AS is_case FROM expr WHERE label IN (0, 1) AND value IS NOT NULL)"
MOMENTS = f"""{PAIR}, m AS (SELECT gene, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n0, avg(value) FILTER (is_case) AS m1,
  avg(value) FILTER (NOT is_case) AS m0, var_samp(value) FILTER (is_case) AS v1, var_samp(value) FILTER (NOT is_case) AS v0 FROM p GROUP BY 1)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, and -0.0 as 0.0, so both engines agree whatever order they add in."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pair(spark, d):
    return st.two_groups(views.expression(spark, d), F.col("label") == 0, F.col("label") == 1)


@query(f"""{C} SELECT sample_id, sum(count) AS library_size, count(*) FILTER (count > 0) AS n_genes_detected,
  round(coalesce(100 * sum(CASE WHEN gene LIKE 'Brand#1%' THEN count ELSE 0 END) / nullif(sum(count), 0), 0), 6) AS pct_mito FROM counts GROUP BY 1""")
def gene_qc(spark, d):
    return rounded(nm.qc_metrics(views.counts(spark, d), F.col("gene").startswith("Brand#1")))


@query(f"""{C} SELECT sample_id, gene, round(count * 1e6 / s, 6) AS cpm, round(log2(count * 1e6 / s + 1), 6) AS log_cpm
  FROM counts JOIN (SELECT sample_id, sum(count) AS s FROM counts GROUP BY 1) USING (sample_id)""")
def counts_cpm(spark, d):
    return rounded(nm.cpm(views.counts(spark, d)))


@query(f"""{X}, r AS (SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY value, gene) AS k, value FROM expr),
  m AS (SELECT k, avg(value) AS v FROM r GROUP BY 1) SELECT sample_id, gene, round(v, 6) AS value FROM r JOIN m USING (k)""")
def quantile_normalized(spark, d):
    return rounded(nm.quantile_normalize(views.expression(spark, d)))


@query(f"""{C}, g AS (SELECT gene, avg(ln(count)) AS lm FROM counts GROUP BY 1 HAVING min(count) > 0 AND count(*) = (SELECT count(DISTINCT sample_id) FROM counts)),
  r AS (SELECT sample_id, exp(median(ln(count) - lm)) AS f FROM counts JOIN g USING (gene) GROUP BY 1),
  l AS (SELECT sample_id, sum(count) AS s FROM counts GROUP BY 1)
  SELECT sample_id, round(coalesce(f, s / (SELECT avg(s) FROM l)), 6) AS size_factor FROM l LEFT JOIN r USING (sample_id)""")
def deseq_size_factors(spark, d):
    return rounded(nm.size_factors(views.counts(spark, d)))


@query(f"""{C} SELECT sample_id, gene, count FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING sum(count) >= 5000)""")
def expressed_gene_filter(spark, d):
    return nm.expressed_genes(views.counts(spark, d), 5000)


@query(f"{X} SELECT gene, round(var_pop(value), 6) AS variance FROM expr GROUP BY 1 ORDER BY var_pop(value) DESC, gene LIMIT 10")
def most_variable_genes(spark, d):
    return rounded(nm.most_variable(views.expression(spark, d), 10))


@query(f"""{X} SELECT platform, sample_id, gene, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS value FROM expr
  JOIN (SELECT platform, gene, avg(value) AS m, stddev_samp(value) AS sd FROM expr GROUP BY 1, 2) USING (platform, gene)""")
def harmonized_zscore(spark, d):
    return rounded(nm.harmonize(views.expression(spark, d)))


@query(f"""{X} SELECT platform, sample_id, gene, round((row_number() OVER (PARTITION BY platform, gene ORDER BY value, sample_id) - 1)
  / greatest(count(value) OVER (PARTITION BY platform, gene) - 1, 1), 6) AS value FROM expr""")
def harmonized_rank(spark, d):
    return rounded(nm.harmonize(views.expression(spark, d), "rank"))


@query("""SELECT p_brand AS gene, l_suppkey AS sample_id, round(avg(l_extendedprice), 8) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def probe_to_gene(spark, d):
    values = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("probe_id"), F.col("l_suppkey").alias("sample_id"), F.col("l_extendedprice").alias("value"))
    return rounded(nm.map_probes(values, read_table(spark, d, "part").select(F.col("p_partkey").alias("probe_id"), F.col("p_brand").alias("gene"))), 8)


@query("""WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS v, 0 AS k FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT l_suppkey, l_partkey, max(l_extendedprice), 1 FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2), o AS (SELECT s, min(k) AS k FROM a GROUP BY 1)
  SELECT s AS sample_id, p AS probe_id, v AS value FROM a JOIN o USING (s, k)""")
def combined_matrices(spark, d):
    items = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("probe_id"), "l_quantity", "l_extendedprice")
    one = items.where("sample_id % 2 = 0").groupBy("sample_id", "probe_id").agg(F.max("l_quantity").alias("value"))
    return nm.combine_matrices([one, items.where("sample_id % 3 = 0").groupBy("sample_id", "probe_id").agg(F.max("l_extendedprice").alias("value"))])


@query("""WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS v, 0 AS k FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT l_suppkey, l_partkey, max(l_extendedprice), 1 FROM lineitem GROUP BY 1, 2), o AS (SELECT s, min(k) AS k FROM a GROUP BY 1)
  SELECT s AS sample_id, p AS probe_id, v AS value FROM a JOIN o USING (s, k)""")
def combined_matrices_whole(spark, d):
    """As combined_matrices, with the whole table as second part, so every supplier takes part."""
    items = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("probe_id"), "l_quantity", "l_extendedprice")
    one = items.where("sample_id % 2 = 0").groupBy("sample_id", "probe_id").agg(F.max("l_quantity").alias("value"))
    return nm.combine_matrices([one, items.groupBy("sample_id", "probe_id").agg(F.max("l_extendedprice").alias("value"))])


@query(f"""{X}, s AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM expr GROUP BY 1)
  SELECT gene, count(*) FILTER (sd > 0 AND abs(value - m) > 2 * sd) AS n_zscore,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_iqr FROM expr JOIN s USING (gene) GROUP BY 1""")
def expression_outliers(spark, d):
    return nm.outliers(views.expression(spark, d), z=2.0)


@query(f"""{X} SELECT platform, gene, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_samp(value) / nullif(avg(value), 0), 4) AS cv FROM expr GROUP BY 1, 2""")
def gene_descriptives(spark, d):
    s = su.gene_stats(views.expression(spark, d), ["platform", "gene"])
    return rounded(s.withColumn("cv", F.round("cv", 4)))


@query(f"""{E} SELECT cell_type, count(value) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM cells GROUP BY 1""")
def cell_qc(spark, d):
    return rounded(su.quartiles(views.cells(spark, d), ["cell_type"]))


@query(f"{E} SELECT donor_id, cell_type, count(*) AS n_cells, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM cells GROUP BY 1, 2 HAVING count(*) >= 10")
def pseudobulk_by_donor(spark, d):
    return rounded(su.pseudobulk(views.cells(spark, d), ["donor_id", "cell_type"], 10), 4)


@query(f"""{E}, g AS (SELECT count(*) AS n FROM cells GROUP BY donor_id, cell_type) SELECT count(*) AS n_groups, count(*) FILTER (n >= 10) AS n_kept,
  count(*) FILTER (n < 10) AS n_dropped, max(n) AS largest, median(n) AS median_size, min(n) FILTER (n >= 10) AS smallest_kept FROM g""")
def pseudobulk_sizes(spark, d):
    return su.pseudobulk_preview(views.cells(spark, d), ["donor_id", "cell_type"], 10)


@query(f"""{E}, t AS (SELECT cell_type, row_number() OVER (ORDER BY count(*) DESC, cell_type) AS r FROM cells GROUP BY 1)
  SELECT donor_id, CASE WHEN r <= 3 THEN cell_type ELSE 'other' END AS stack, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY donor_id), 6) AS share
  FROM cells JOIN t USING (cell_type) GROUP BY 1, 2""")
def cell_composition(spark, d):
    return rounded(su.composition(views.cells(spark, d), "donor_id", "cell_type", 3))


@query("""SELECT lang, source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS row_pct FROM documents GROUP BY 1, 2""")
def label_crosstab(spark, d):
    return rounded(su.crosstab(read_table(spark, d, "documents"), "lang", "source"))


@query(f"{X} SELECT label, gene, round(avg(value), 6) AS mean, round(avg((value > 0)::INT), 6) AS fraction FROM expr GROUP BY 1, 2")
def dot_plot_matrix(spark, d):
    return rounded(su.dot_plot(views.expression(spark, d), "label"))


@query("""WITH n AS (SELECT o_orderstatus AS s, p_type AS v, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT s AS status, lower(v) AS folded, sum(c)::BIGINT AS n, arg_max(v, c) AS spelling FROM n GROUP BY 1, 2""")
def label_histogram(spark, d):
    rows = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return su.value_histogram(rows.select(F.col("o_orderstatus").alias("status"), "p_type"), ["status"], "p_type")


@query("""SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source, lang) - 1 AS same, count(*) OVER (PARTITION BY source) - 1 AS others FROM documents""")
def sibling_votes(spark, d):
    return su.others_histogram(read_table(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], "lang")


@query("""WITH m AS (SELECT source, quality = 1 AS t, toxic = 1 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT source,
  count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM m GROUP BY ROLLUP (source))
  SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c""")
def verdict_metrics(spark, d):
    m = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rounded(su.confusion(m, "quality", "toxic", ["source"]))


@query("""SELECT l_partkey AS part, l_suppkey, count(DISTINCT l_orderkey) AS n_studies, min(l_returnflag) AS target FROM lineitem
  GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2 AND min(l_returnflag) = max(l_returnflag)""")
def unanimous_promotion(spark, d):
    return su.promotable(read_table(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), ["part", "l_suppkey"], "l_returnflag", "l_orderkey", 2)


@query("""WITH t AS (SELECT count(*) FILTER (n_chars > 2000) AS ns, count(*) AS nt FROM documents)
  SELECT lang, count(*) FILTER (n_chars > 2000) AS selected, count(*) FILTER (n_chars <= 2000) AS rest, count(*) AS total,
  round(100 * count(*) FILTER (n_chars > 2000) / any_value(ns), 6) AS sel_pct, round(100 * count(*) / any_value(nt), 6) AS plat_pct,
  round((100 * count(*) FILTER (n_chars > 2000) / any_value(ns)) / (100 * count(*) / any_value(nt)), 6) AS ratio FROM documents, t GROUP BY 1""")
def region_label_frequency(spark, d):
    return rounded(su.label_frequency(read_table(spark, d, "documents"), F.col("n_chars") > 2000, "lang"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def upsert_latest(spark, d):
    return su.latest(read_table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) <= greatest(3, (SELECT count(*) FROM part) // 10)")
def rare_labels(spark, d):
    return su.rare_values(read_table(spark, d, "part"), "p_name")


@query("""SELECT user_id, event_id, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id))::INT AS rank FROM events) WHERE rank <= 3""")
def top_events(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", "value")
    return su.top_per_group(e, ["user_id"], [F.desc("value"), "event_id"], 3)


@query(f"""{MOMENTS} SELECT gene, n1, n0, round(m1 - m0, 6) AS log_fc, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t_stat,
  round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS df FROM m WHERE n1 >= 2 AND n0 >= 2""")
def welch_ranking(spark, d):
    return rounded(st.welch(pair(spark, d)))


@query()
def ranked_genes(spark, d):
    return rounded(st.rank_genes(pair(spark, d)))


@query("""WITH p AS (SELECT event_id, value / 600 AS p_value FROM events), r AS (SELECT *, rank() OVER (ORDER BY p_value DESC) AS down, count(*) OVER () AS m FROM p)
  SELECT event_id, p_value, round(least(1, min(p_value * m / (m - down + 1)) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value
  FROM (SELECT event_id, p_value, m, down FROM r)""")
def benjamini_hochberg(spark, d):
    p = read_table(spark, d, "events").select("event_id", (F.col("value") / 600).alias("p_value"))
    return st.benjamini_hochberg(p, "p_value").withColumn("q_value", F.round("q_value", 9))


@query(f"""{MOMENTS} SELECT gene, round(log2((v1 + 1e-12) / (v0 + 1e-12)), 6) AS log_ratio,
  round(ln((v1 + 1e-12) / (v0 + 1e-12)) / sqrt(2 / (n1 - 1) + 2 / (n0 - 1)), 6) AS z FROM m WHERE n1 >= 3 AND n0 >= 3""")
def variance_ranking(spark, d):
    return rounded(st.variability(pair(spark, d)))


@query(f"""{PAIR}, c AS (SELECT gene, is_case, median(value) AS c FROM p GROUP BY 1, 2), v AS (SELECT gene, is_case, abs(value - c) AS d FROM p JOIN c USING (gene, is_case)),
  g AS (SELECT gene, is_case, count(*) AS n, avg(d) AS m, coalesce(var_samp(d), 0) AS s FROM v GROUP BY 1, 2),
  a AS (SELECT gene, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS s2, sum((n - 1) * s) AS w, count(*) AS k FROM g GROUP BY 1)
  SELECT gene, round((n - 2) * (s2 - n * gm * gm) / w, 5) AS w_stat, n - 2 AS df FROM a WHERE k = 2""")
def brown_forsythe(spark, d):
    return rounded(st.levene(pair(spark, d)), 5)


@query(f"""{PAIR}, n AS (SELECT gene, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n0 FROM p GROUP BY 1),
  s AS (SELECT gene, value, count(*) FILTER (is_case) AS c1, count(*) FILTER (NOT is_case) AS c0 FROM p GROUP BY 1, 2),
  f AS (SELECT gene, n1, n0, abs(sum(c1) OVER w / n1 - sum(c0) OVER w / n0) AS gap, coalesce(lead(value) OVER w - value, 0) AS step FROM s JOIN n USING (gene)
    WINDOW w AS (PARTITION BY gene ORDER BY value))
  SELECT gene, n1, n0, round(max(gap), 6) AS ks, round(sum(gap * step), 6) AS wasserstein FROM f GROUP BY 1, 2, 3""")
def ks_wasserstein(spark, d):
    return rounded(st.distribution_distance(pair(spark, d)))


@query(f"""{MOMENTS}, r AS (SELECT gene, is_case, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS r FROM p),
  s AS (SELECT gene, sum(r) FILTER (is_case) AS r1 FROM r GROUP BY 1)
  SELECT gene, round((r1 - n1 * (n1 + n0 + 1) / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS z, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS cliff,
  round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen FROM m JOIN s USING (gene)""")
def rank_sum_effects(spark, d):
    return rounded(st.rank_sum(pair(spark, d)))


@query(f"""{PAIR}, e AS (SELECT gene, min(value) AS lo, max(value) AS hi, count(*) FILTER (is_case) AS n1, count(*) FILTER (NOT is_case) AS n0 FROM p GROUP BY 1),
  h AS (SELECT gene, least(floor((value - lo) * 49 / (hi - lo)), 48) AS b, count(*) FILTER (is_case) / any_value(n1) AS p, count(*) FILTER (NOT is_case) / any_value(n0) AS q
    FROM p JOIN e USING (gene) GROUP BY 1, 2)
  SELECT gene, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS js FROM h GROUP BY 1""")
def jensen_shannon_distance(spark, d):
    return rounded(st.jensen_shannon(pair(spark, d)))


@query(f"""{X}, x AS (SELECT platform, sample_id, value AS x FROM expr WHERE gene = 'g0')
  SELECT platform, gene, count(*) AS n, round(corr(x, value), 6) AS r FROM expr JOIN x USING (platform, sample_id) WHERE gene <> 'g0' GROUP BY 1, 2""")
def coexpression_pearson(spark, d):
    return rounded(st.coexpression(views.expression(spark, d), "g0"))


@query(f"""{X}, k AS (SELECT platform, sample_id, gene, rank() OVER (PARTITION BY platform, gene ORDER BY value) + (count(*) OVER (PARTITION BY platform, gene, value) - 1) / 2 AS value FROM expr),
  x AS (SELECT platform, sample_id, value AS x FROM k WHERE gene = 'g0')
  SELECT platform, gene, count(*) AS n, round(corr(x, value), 6) AS r FROM k JOIN x USING (platform, sample_id) WHERE gene <> 'g0' GROUP BY 1, 2""")
def coexpression_spearman(spark, d):
    return rounded(st.coexpression(views.expression(spark, d), "g0", "spearman"))


@query(f"""{X}, x AS (SELECT platform, sample_id, value AS x FROM expr WHERE gene = 'g0')
  SELECT platform, gene, count(*) AS n, round(1 - var_samp(value - x) / (var_samp(x) + var_samp(value)), 6) AS r FROM expr JOIN x USING (platform, sample_id) WHERE gene <> 'g0' GROUP BY 1, 2""")
def coexpression_rho(spark, d):
    return rounded(st.coexpression(views.expression(spark, d), "g0", "rho"))


@query(f"""{X}, x AS (SELECT platform, sample_id, value AS x FROM expr WHERE gene = 'g0'),
  c AS (SELECT platform, gene, corr(x, value) AS r FROM expr JOIN x USING (platform, sample_id) WHERE gene <> 'g0' GROUP BY 1, 2)
  SELECT gene, count(*) AS n_sources, round(avg(r), 6) AS mean_r FROM c WHERE abs(r) >= 0.05 GROUP BY 1 HAVING count(*) >= 2 AND min(sign(r)) = max(sign(r))""")
def coexpression_consensus(spark, d):
    return rounded(st.consensus(st.coexpression(views.expression(spark, d), "g0"), 0.05))


EFFECTS = f"""{X}, m AS (SELECT platform, gene, avg(value) FILTER (label = 0) - avg(value) FILTER (label = 1) AS fc,
  sqrt(var_samp(value) FILTER (label = 0) / count(*) FILTER (label = 0) + var_samp(value) FILTER (label = 1) / count(*) FILTER (label = 1)) AS se FROM expr WHERE label IN (0, 1) GROUP BY 1, 2),
  e AS (SELECT platform, gene, fc, fc / se AS t FROM m)"""


def effects(spark, d):
    return st.welch(pair(spark, d), ("platform", "gene")).select("platform", "gene", "log_fc", "t_stat")


@query(f"{EFFECTS} SELECT gene, count(*) AS n_platforms, round(sum(t) / sqrt(count(*)), 6) AS z FROM e WHERE t IS NOT NULL GROUP BY 1")
def meta_stouffer(spark, d):
    return rounded(st.stouffer(effects(spark, d).withColumnRenamed("t_stat", "z")))


@query(f"""{EFFECTS}, r AS (SELECT gene, 2 * (rank() OVER (PARTITION BY platform ORDER BY t) + (count(*) OVER (PARTITION BY platform, t) - 1) / 2) / count(*) OVER (PARTITION BY platform) - 1 AS f
  FROM e WHERE t IS NOT NULL) SELECT gene, count(*) AS n_platforms, round(exp(avg(ln(abs(f) + 1e-6))) * sign(avg(f)), 6) AS score FROM r WHERE f <> 0 GROUP BY 1""")
def meta_rank_product(spark, d):
    return rounded(st.rank_product(effects(spark, d).select("platform", "gene", F.col("t_stat").alias("value"))))


@query(f"""{EFFECTS}, w AS (SELECT gene, fc, (t / fc) ** 2 AS w FROM e WHERE t <> 0), a AS (SELECT gene, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * fc) AS swx,
  sum(w * fc * fc) AS swxx FROM w GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT *, greatest(0, swxx - swx * swx / sw) AS q FROM a),
  c AS (SELECT gene, k, q, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2, coalesce(greatest(0, q - (k - 1)) * 100 / nullif(q, 0), 0) AS i2 FROM b),
  p AS (SELECT gene, k, q, tau2, i2, sum(1 / (1 / w + tau2)) AS ws, sum(fc / (1 / w + tau2)) AS wx FROM w JOIN c USING (gene) GROUP BY ALL)
  SELECT gene, k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(i2, 4) AS i2, round(wx / ws, 6) AS pooled, round(sqrt(1 / ws), 6) AS se, round(wx / sqrt(ws), 6) AS z FROM p""")
def meta_random_effects(spark, d):
    return rounded(st.random_effects(effects(spark, d)).withColumn("i2", F.round("i2", 4)))


ENRICH = """WITH t AS (SELECT count(*) FILTER (n_chars > 3000) AS n, count(*) AS n_all FROM documents)
  SELECT source, count(*) FILTER (n_chars > 3000) AS k, count(*) AS k_all, any_value(n) AS n, any_value(n_all) AS n_all,
  round(count(*) FILTER (n_chars > 3000) * any_value(n_all) / (any_value(n) * count(*)), 6) AS fold FROM documents, t GROUP BY 1 HAVING count(*) >= 3"""


@query(ENRICH)
def label_overrepresentation(spark, d):
    return rounded(st.label_enrichment(read_table(spark, d, "documents"), F.col("n_chars") > 3000, "source"))


@query()
def label_enrichment_tests(spark, d):
    tested = st.enrichment_tests(st.label_enrichment(read_table(spark, d, "documents"), F.col("n_chars") > 3000, "source"))
    return rounded(tested.withColumn("class", st.volcano_class(F.col("q_value"), F.col("fold"))))


@query(f"""{EFFECTS}, g AS (SELECT upper(gene) AS gene, max(t) AS v FROM e GROUP BY 1), o AS (SELECT gene, v, row_number() OVER (ORDER BY v DESC, gene) AS pos, count(*) OVER () AS n FROM g),
  h AS (SELECT 'SET' || (substr(gene, 2)::INT % 8) AS term, * FROM o), s AS (SELECT term, count(*) AS size, sum(abs(v)) AS mass FROM h GROUP BY 1),
  w AS (SELECT term, size, sum(abs(v)) OVER x / mass AS hit, abs(v) / mass AS own, (pos - row_number() OVER x) / greatest(n - size, 1) AS miss FROM h JOIN s USING (term)
    WINDOW x AS (PARTITION BY term ORDER BY pos)), ms AS (SELECT term, size, max(hit - miss) AS hi, min(hit - own - miss) AS lo FROM w GROUP BY 1, 2)
  SELECT term, size, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es FROM ms""")
def gene_set_scores(spark, d):
    ranked = effects(spark, d).select("gene", F.col("t_stat").alias("value"))
    genes = views.expression(spark, d).select("gene").distinct()
    sets = genes.select(F.concat(F.lit("SET"), F.expr("cast(substr(gene, 2) as int) % 8")).alias("term"), "gene")
    return rounded(st.enrichment_score(ranked, sets))


@query(f"""{X}, net AS (SELECT DISTINCT gene, 'TF' || (substr(gene, 2)::INT % 4) AS source, CASE WHEN substr(gene, 2)::INT % 3 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS weight FROM expr),
  t AS (SELECT sample_id, count(*) AS n, sum(value) AS sy, sum(value * value) AS syy FROM expr GROUP BY 1),
  h AS (SELECT sample_id, source, sum(weight) AS sx, sum(weight * weight) AS sxx, sum(weight * value) AS sxy FROM expr JOIN net USING (gene) GROUP BY 1, 2),
  r AS (SELECT sample_id, source, n, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM h JOIN t USING (sample_id))
  SELECT sample_id, source, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS score FROM r""")
def regulator_activity(spark, d):
    expr = views.expression(spark, d)
    i = F.expr("cast(substr(gene, 2) as int)")
    net = expr.select("gene").distinct().select("gene", F.concat(F.lit("TF"), i % 4).alias("source"), F.when(i % 3 == 0, -1.0).otherwise(1.0).alias("weight"))
    return rounded(st.activity(expr, net))


@query(f"""{X}, m AS (SELECT platform, gene, avg(value) AS a, stddev_pop(value) AS sd, count(value) AS n FROM expr GROUP BY 1, 2),
  s AS (SELECT platform, gene, any_value(n) AS n, any_value(sd) AS sd, avg(((value - a) / sd) ** 3) AS skew, avg(((value - a) / sd) ** 4) - 3 AS kurt FROM expr JOIN m USING (platform, gene) GROUP BY 1, 2)
  SELECT platform, gene, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, CASE WHEN n < 10 THEN 'Not Enough Data' WHEN sd < 1e-6 THEN 'Effectively Constant'
  WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'Normal' WHEN abs(skew) < 0.5 AND kurt <= -1 THEN 'Uniform' WHEN abs(skew) < 0.5 THEN 'Heavy-tailed'
  WHEN skew >= 0.5 THEN 'Right-skewed' ELSE 'Left-skewed' END AS shape FROM s""")
def distribution_shapes(spark, d):
    return rounded(st.shape_class(views.expression(spark, d), ["platform", "gene"]))


META = """WITH gpl AS (SELECT 'GPL' || n_nationkey AS gpl, n_name AS title FROM nation), gse AS (SELECT 'GSE' || c_custkey AS gse, c_name AS title, c_mktsegment AS summary, 'GPL' || c_nationkey AS gpl FROM customer),
  gsm AS (SELECT 'GSE' || o_custkey AS gse, 'GSM' || o_orderkey AS gsm, o_orderpriority AS title FROM orders)"""


@query(f"""{META}, b AS (SELECT DISTINCT gse, gsm, gpl, lower(concat_ws(' ', gse.title, summary, gsm.title)) AS b FROM gse JOIN gsm USING (gse))
  SELECT gse, gsm, gpl, array_to_string(list_filter(['building', 'urgent'], lambda w: contains(b, w)), '|') AS matched FROM b WHERE contains(b, 'building') OR contains(b, 'urgent')""")
def metadata_search(spark, d):
    return se.keyword_samples(views.metadata(spark, d), ["BUILDING", "urgent"])


@query(f"""{META}, b AS (SELECT DISTINCT gse, gsm, lower(concat_ws(' ', gse.title, summary, gsm.title)) AS b FROM gse JOIN gsm USING (gse))
  SELECT gse, count(DISTINCT gsm) AS n_samples, array_to_string(list_sort(list_distinct(list(array_to_string(list_filter(['building', 'urgent'], lambda w: contains(b, w)), '|')))), '|') AS matched
  FROM b WHERE contains(b, 'building') OR contains(b, 'urgent') GROUP BY 1""")
def series_discovery(spark, d):
    return se.series_of_samples(se.keyword_samples(views.metadata(spark, d), ["BUILDING", "urgent"]))


@query(f"""{META} SELECT gpl.gpl, gpl.title, count(gsm) AS n_samples FROM gpl LEFT JOIN gse ON gse.gpl = gpl.gpl LEFT JOIN gsm USING (gse) WHERE lower(gpl.title) LIKE '%1%' GROUP BY 1, 2
  ORDER BY n_samples DESC, gpl.gpl LIMIT 5""")
def platform_lookup(spark, d):
    return se.platform_search(views.metadata(spark, d), "1", 5)


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.id AS query_id, b.id, list_cosine_similarity(q.v, b.v) AS s FROM v q JOIN v b ON q.id % 100 = 0 AND q.id <> b.id)
  SELECT query_id, rank::INT AS rank, id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s >= 0) WHERE rank <= 5""")
def nearest_labels(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(se.nearest(v.where("id % 100 = 0"), v, 5))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.id AS query_id, b.id, list_cosine_similarity(q.v, b.v) AS s FROM v q JOIN v b ON q.id % 20 = 0 AND q.id <> b.id)
  SELECT query_id, rank::INT AS rank, id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s >= 0) WHERE rank <= 5""")
def nearest_labels_twentieth(spark, d):
    """As nearest_labels, for every id divisible by 20."""
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(se.nearest(v.where("id % 20 = 0"), v, 5))


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT lower(n_name) AS key, n_nationkey AS id, 0 AS tier FROM nation UNION ALL SELECT lower(r_name), r_regionkey, 1 FROM region),
  b AS (SELECT key, min({'tier': tier, 'id': id}) AS b FROM k GROUP BY 1)
  SELECT label, b.id, b.tier FROM (SELECT upper(n_name) AS label FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT p_brand FROM part) LEFT JOIN b ON key = lower(label)""")
def vocabulary_lookup(spark, d):
    nation, region, part = (read_table(spark, d, t) for t in ("nation", "region", "part"))
    asked = nation.select(F.upper("n_name").alias("label")).union(region.select("r_name")).union(part.select("p_brand").distinct())
    names = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return se.lookup(asked, names, region.select(F.col("r_name").alias("synonym"), F.col("r_regionkey").alias("id")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1), r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS steps FROM customer
  UNION ALL SELECT start, parent, steps + 1 FROM r JOIN e ON node = child WHERE steps < 3) SELECT start, node, min(steps)::INT AS steps FROM r WHERE node <> start GROUP BY 1, 2""")
def ontology_walk(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey")
    edges = c.where("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return se.walk(edges, c.select(F.col("c_custkey").alias("start")), 3)


@query("""SELECT event_id, user_id, (props->>'k')::BIGINT AS k FROM events""")
def json_properties(spark, d):
    return se.json_facets(read_table(spark, d, "events").select("event_id", "user_id", "props"), "props", "k long")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def resume_pending(spark, d):
    done = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return se.resume(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_custkey"])


@query("""WITH p AS (SELECT p_partkey, p_name || '; ' || p_type || ';  none; ' || p_name AS a FROM part) SELECT p_partkey, p_name || '; ' || p_type AS label FROM part""")
def parsed_answers(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", lb.parse_values(F.concat_ws("; ", "p_name", "p_type", F.lit(" none"), "p_name")).alias("label"))


@query("""SELECT p_partkey, unnest([{'key': 'brand', 'value': p_brand}, {'key': 'size', 'value': p_size::VARCHAR}], recursive := true) FROM part""")
def sample_characteristics(spark, d):
    text = F.concat(F.lit("Brand: "), "p_brand", F.lit("; junk; SIZE :"), "p_size")
    return read_table(spark, d, "part").select("p_partkey", F.inline(lb.characteristics(text)))


@query("""SELECT event_id, sha256(event_type || chr(31) || user_id || chr(31) || props) AS memo FROM events""")
def memo_keys(spark, d):
    return read_table(spark, d, "events").select("event_id", lb.memo_key(F.col("event_type"), F.col("user_id"), F.col("props")).alias("memo"))


@query("""WITH n AS (SELECT p_type, p_name AS label, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, label, n, label AS canonical FROM n""")
def collapsed_labels(spark, d):
    return lb.collapse(read_table(spark, d, "part").select("p_type", F.col("p_name").alias("label")), ["p_type"], "label")


@query("""WITH n AS (SELECT source, lower(lang) AS v, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, first(v ORDER BY n DESC, v) AS top, max(n) AS nt, sum(n) AS nn FROM n GROUP BY 1)
  SELECT doc_id, d.source, lang, top, CASE WHEN nn >= 3 AND nt >= 0.6 * nn AND lower(lang) <> top THEN 'demote' ELSE 'keep' END AS verdict FROM documents d JOIN t USING (source)""")
def consensus_verdicts(spark, d):
    return lb.consensus_verdict(read_table(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], "lang", share=0.6)


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS label FROM part WHERE lower(p_name) NOT IN ('red widget')) SELECT label, printf('ART-C-%05d', 7 + row_number() OVER (ORDER BY label)) AS id FROM n""")
def minted_ids(spark, d):
    known = spark.createDataFrame([("red widget", "ART-C-00007")], "label string, id string")
    return lb.mint(read_table(spark, d, "part").select(F.col("p_name").alias("label")), known, "ART-C")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def windowed_activity(spark, d):
    return rounded(bus.windowed_activity(read_table(spark, d, "events")))


@query(f"{X} SELECT gene, count(DISTINCT platform) AS n_platforms FROM expr WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT platform) = 3")
def shared_genes(spark, d):
    n = views.expression(spark, d).where("value is not null").groupBy("gene").agg(F.countDistinct("platform").alias("n_platforms"))
    return n.where("n_platforms = 3")


@query(f"{X} SELECT platform, sample_id, gene, round(count(*) OVER w / count(*) OVER (PARTITION BY platform, gene), 6) AS ecdf FROM expr WINDOW w AS (PARTITION BY platform, gene ORDER BY value)")
def gene_ecdf(spark, d):
    g = Window.partitionBy("platform", "gene")
    e = views.expression(spark, d).where("value is not null")
    return rounded(e.select("platform", "sample_id", "gene", (F.count("*").over(g.orderBy("value")) / F.count("*").over(g)).alias("ecdf")))


@query("""WITH n AS (SELECT c_nationkey AS cluster, c_mktsegment AS label, count(*) AS c FROM customer GROUP BY 1, 2),
  s AS (SELECT cluster, sum(c)::BIGINT AS n_samples, list(label ORDER BY c DESC, label) FILTER (label IS NOT NULL) AS by_n, list(label ORDER BY label) FILTER (label IS NOT NULL) AS by_name FROM n GROUP BY 1)
  SELECT cluster, n_samples, coalesce(by_n[1], '')[:100] AS representative_label, coalesce(array_to_string(by_name[1:3], '; '), '')[:200] AS sample_labels,
  n_regionkey * 0.25::DOUBLE AS bootstrap_jaccard, coalesce(n_regionkey * 0.25::DOUBLE >= 0.6, false) AS stable FROM s LEFT JOIN nation ON cluster = n_nationkey""")
def cohort_summaries(spark, d):
    stability = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_regionkey") * 0.25).alias("bootstrap_jaccard"))
    return co.cohort_summary(read_table(spark, d, "customer"), "c_nationkey", "c_mktsegment", stability, 0.6)


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT 'o_orderpriority' AS facet, o_orderpriority::VARCHAR AS value, count(*) AS n_rows FROM o GROUP BY 2
  UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM o GROUP BY 2), r AS (SELECT *, (row_number() OVER (PARTITION BY facet ORDER BY n_rows DESC, value NULLS LAST))::INT AS rank,
  count(value) OVER (PARTITION BY facet) AS n_unique FROM n) SELECT * FROM r WHERE rank <= 10""")
def facet_counts(spark, d):
    chosen = read_table(spark, d, "orders").where(co.match_all(o_orderstatus=["O", "F", None], o_orderpriority=None))
    return co.facet_preview(chosen, ["o_orderpriority", "o_custkey"])


@query()
def pseudo_cohort_clusters(spark, d):
    return co.pseudo_cohorts(read_table(spark, d, "embeddings"), "vec_id", "embedding", range(2, 6), seed=7)
