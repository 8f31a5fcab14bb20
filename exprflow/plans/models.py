"""Queries of fitted models, descriptions and comparisons over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as co
from ..operators import describe as de
from ..operators import models as mo
from ..operators import normalize as nm
from ..operators import statistics as st
from ..registry import query
from ..session import read_table
from ..sources import views
from .catalog import PAIR, C, E, X, effects, pair, rounded


@query()
def moderated_ranking(spark, d):
    return rounded(mo.moderated_t(pair(spark, d)))


@query()
def bootstrap_intervals(spark, d):
    return rounded(mo.bootstrap_mean(views.cells(spark, d), ["cell_type"], "cell_id", 1000))


@query()
def gene_set_prerank(spark, d):
    genes = views.expression(spark, d).select("gene").distinct()
    sets = genes.select(F.concat(F.lit("SET"), F.expr("cast(substr(gene, 2) as int) % 8")).alias("term"), "gene")
    return rounded(st.prerank(effects(spark, d).select("gene", F.col("t_stat").alias("value")), sets, 1000))


@query(f"""{C}, fg AS (SELECT gene, avg(ln(count)) AS lm FROM counts GROUP BY 1 HAVING min(count) > 0 AND count(*) = (SELECT count(DISTINCT sample_id) FROM counts)),
  fr AS (SELECT sample_id, exp(median(ln(count) - lm)) AS f FROM counts JOIN fg USING (gene) GROUP BY 1), fl AS (SELECT sample_id, sum(count) AS s FROM counts GROUP BY 1),
  sf AS (SELECT sample_id, coalesce(f, s / (SELECT avg(s) FROM fl)) AS s FROM fl LEFT JOIN fr USING (sample_id)),
  r AS (SELECT gene, count AS y, s, sample_id % 2 = 0 AS c FROM counts JOIN sf USING (sample_id)),
  g AS (SELECT gene, c, count(*) AS n, sum(y) / sum(s) AS rate, avg(y / s) AS m, var_samp(y / s) AS v, avg(1 / s) AS inv, sum(y) AS total FROM r GROUP BY 1, 2),
  b AS (SELECT gene, sum((n - 1) * v) / sum(n - 1) AS var, sum(n * m) / sum(n) AS bm, sum(n * inv) / sum(n) AS inv FROM g GROUP BY 1 HAVING count(*) = 2 AND min(n) >= 2 AND sum(total) >= 10),
  a AS (SELECT gene, bm, greatest(1e-8, (var - bm * inv) / (bm * bm)) AS alpha FROM b),
  w AS (SELECT gene, c, rate, y, s * rate AS mu, s * rate / (1 + alpha * s * rate) AS w FROM r JOIN g USING (gene, c) JOIN a USING (gene) WHERE rate > 0),
  f AS (SELECT gene, c, ln(rate) + sum(w * (y / mu - 1)) / sum(w) AS eta, sum(w) AS info FROM w GROUP BY gene, c, rate),
  o AS (SELECT gene, max(eta) FILTER (c) - max(eta) FILTER (NOT c) AS fc, sum(1 / info) AS v FROM f GROUP BY 1 HAVING count(*) = 2)
  SELECT gene, round(bm, 6) AS base_mean, round(fc / ln(2), 6) AS log2_fc, round(alpha, 6) AS alpha, round(fc / sqrt(v), 6) AS z FROM a LEFT JOIN o USING (gene)""")
def count_differences(spark, d):
    counts = views.counts(spark, d)
    tested = mo.count_wald(counts.withColumn("is_case", F.col("sample_id") % 2 == 0), nm.size_factors(counts))
    return rounded(tested.select("gene", "base_mean", "log2_fc", "alpha", "z"))


@query(f"""{X.replace("WITH", "WITH RECURSIVE", 1)}, c AS (SELECT platform, gene, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM expr WHERE value IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT gene, sum(n * m) / sum(n) AS grand, sqrt(sum(n * v) / sum(n)) AS sd FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT platform) FROM expr)),
  h AS (SELECT platform, gene, n, (m - grand) / sd AS g_hat, v / (sd * sd) AS zv, v / (sd * sd) * n / (n - 1) AS d_hat FROM c JOIN g USING (gene) WHERE n > 1 AND sd > 0),
  q AS (SELECT platform, avg(g_hat) AS g_bar, var_samp(g_hat) AS t2, avg(d_hat) AS dm, var_samp(d_hat) AS dv FROM h GROUP BY 1),
  p AS (SELECT platform, g_bar, t2, (2 * dv + dm * dm) / dv AS a, (dm * dv + dm ** 3) / dv AS b FROM q),
  it AS (SELECT platform, gene, g_hat AS g, d_hat AS d, 0 AS k FROM h UNION ALL
    SELECT platform, gene, s, (0.5::DOUBLE * (n * zv + n * (g_hat - s) * (g_hat - s)) + b) / (n / 2 + a - 1), k + 1
    FROM (SELECT it.platform, it.gene, (t2 * n * g_hat + d * g_bar) / (t2 * n + d) AS s, n, zv, g_hat, a, b, k FROM it JOIN h USING (platform, gene) JOIN p USING (platform) WHERE k < 30))
  SELECT platform, sample_id, gene, round(sd * ((value - grand) / sd - g) / sqrt(d) + grand, 6) AS value FROM expr JOIN g USING (gene) JOIN it USING (platform, gene) WHERE k = 30 AND value IS NOT NULL""")
def batch_corrected(spark, d):
    return rounded(mo.combat(views.expression(spark, d)))


@query(f"""{E}, m AS (SELECT donor_id, count(value) AS n, avg(value) AS a, stddev_pop(value) AS sd, min(value) AS low FROM cells GROUP BY 1),
  s AS (SELECT donor_id, any_value(n) AS n, any_value(low) AS low, avg(((value - a) / sd) ** 3) AS skew FROM cells JOIN m USING (donor_id) WHERE value IS NOT NULL GROUP BY 1)
  SELECT donor_id, n, round(skew, 6) AS skew, CASE WHEN n < 10 THEN 'None' WHEN abs(skew) < 0.5 THEN 'None (already approximately normal)' WHEN skew > 1 AND low > 0 THEN 'Log transformation'
  WHEN skew > 1 AND low >= 0 THEN 'Log(x+1) transformation' WHEN skew > 0.5 AND low >= 0 THEN 'Square root transformation' WHEN skew > 0.5 THEN 'Yeo-Johnson transformation (handles negatives)'
  WHEN skew < -1 THEN 'Reflect and log transformation' WHEN skew < -0.5 THEN 'Square transformation or Yeo-Johnson' WHEN low > 0 THEN 'Box-Cox transformation' ELSE 'Yeo-Johnson transformation' END AS advice FROM s""")
def transformation_advice(spark, d):
    return rounded(de.transformation(views.cells(spark, d), ["donor_id"]))


@query(f"""{E}, m AS (SELECT cell_type, count(value) AS n, stddev_pop(value) AS sd, max(value) - min(value) AS r, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM cells GROUP BY 1),
  b AS (SELECT cell_type, ceil(log2(n) + 1) AS s, CASE WHEN sd > 0 THEN ceil(r / (3.5::DOUBLE * sd / cbrt(n))) ELSE 30 END AS c, CASE WHEN iqr > 0 THEN ceil(r / (2 * iqr / cbrt(n))) ELSE 30 END AS f, floor(sqrt(n)) AS a FROM m)
  SELECT cell_type, greatest(10, least(100, s))::INT AS sturges, greatest(10, least(100, c))::INT AS scott, greatest(10, least(100, f))::INT AS fd, greatest(10, least(100, a))::INT AS auto FROM b""")
def histogram_bins(spark, d):
    return de.bin_counts(views.cells(spark, d), ["cell_type"])


@query(f"""{E}, m AS (SELECT cell_type, count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1),
  h AS (SELECT cell_type, n, sd * n ** (-0.2::DOUBLE) AS h, (hi - lo) * 1.2::DOUBLE / 31 AS gap, lo - 0.1::DOUBLE * (hi - lo) AS x0 FROM m WHERE sd > 0)
  SELECT cell_type, k::INT AS k, round(x0 + k * gap, 6) AS x, round(sum(exp(-0.5::DOUBLE * ((x0 + k * gap - value) / h) ** 2)) / (n * h * sqrt(2 * pi())), 9) AS density
  FROM cells JOIN h USING (cell_type), range(0, 32) AS t(k) GROUP BY cell_type, n, h, gap, x0, k""")
def cell_density(spark, d):
    g = de.density(views.cells(spark, d), ["cell_type"], 32)
    return g.select("cell_type", "k", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE - embedding[2]::DOUBLE AS d FROM embeddings), m AS (SELECT label, count(d) AS n, avg(d) AS bias, 1.96::DOUBLE * stddev_samp(d) AS half FROM p GROUP BY 1)
  SELECT label, any_value(n) AS n, round(any_value(bias), 6) AS bias, round(any_value(bias - half), 6) AS lower, round(any_value(bias + half), 6) AS upper, count(*) FILTER (abs(d - bias) > half) AS n_outside
  FROM p JOIN m USING (label) GROUP BY 1""")
def gene_agreement(spark, d):
    pairs = read_table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return rounded(de.agreement(pairs, ["label"]))


@query(f"""{E}, m AS (SELECT donor_id, cell_type AS t, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM cells GROUP BY 1, 2 HAVING count(value) >= 3),
  p AS (SELECT donor_id, x.t AS a, y.t AS b, x.m - y.m AS delta, x.n + y.n - 2 AS df, 1 / x.n + 1 / y.n AS inv, ((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) AS s2 FROM m x JOIN m y USING (donor_id) WHERE x.t < y.t)
  SELECT donor_id, a, b, round(delta, 6) AS delta, round(delta / sqrt(s2), 6) AS cohen, round(delta / sqrt(s2 * inv), 6) AS t_stat, df::DOUBLE AS df FROM p""")
def cell_group_pairs(spark, d):
    return rounded(de.group_pairs(views.cells(spark, d), "cell_type", ["donor_id"]).drop("p_value", "mark"))


TAIL = "list_sum(list_transform(range({k}, least({n}, {ka}) + 1), lambda i: exp(lgamma({ka} + 1) - lgamma(i + 1) - lgamma({ka} - i + 1) + lgamma({na} - {ka} + 1) - lgamma({n} - i + 1) - lgamma({na} - {ka} - {n} + i + 1) - lgamma({na} + 1) + lgamma({n} + 1) + lgamma({na} - {n} + 1))))"


@query(f"""WITH c AS (SELECT source, lang, count(*) AS k FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT *, sum(k) OVER (PARTITION BY source)::BIGINT AS n, sum(k) OVER (PARTITION BY lang)::BIGINT AS k_all, sum(k) OVER ()::BIGINT AS n_all FROM c),
  p AS (SELECT *, least(1, {TAIL.format(k="greatest(k, n + k_all - n_all)", n="n", ka="k_all", na="n_all")}) AS p FROM j WHERE k_all >= 3),
  r AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY p) AS r, count(*) OVER (PARTITION BY source) AS m FROM p)
  SELECT source, lang, k, k_all, n, n_all, round(k * n_all / (n * k_all), 6) AS fold, round(p, 6) AS p_value, round(least(1, min(p * m / r) OVER (PARTITION BY source ORDER BY p DESC)), 6) AS q_value FROM r""")
def source_language_enrichment(spark, d):
    counts = de.group_enrichment(read_table(spark, d, "documents"), "source", "lang")
    return rounded(de.group_enrichment_tests(counts, "source"))


@query(f"""WITH c AS (SELECT source, count(*) FILTER (n_chars > 3000) AS k, count(*) FILTER (n_chars <= 3000 OR n_chars IS NULL) AS r FROM documents WHERE source IS NOT NULL AND lower(source) NOT IN ('none', '') GROUP BY 1),
  t AS (SELECT source, k, r, sum(k) OVER ()::BIGINT AS ns, sum(r) OVER ()::BIGINT AS nr FROM c), j AS (SELECT *, k + r AS ka, ns + nr AS na FROM t WHERE k > 0)
  SELECT source, k AS selected, r AS rest, round(k * nr / nullif(r * ns, 0), 6) AS fold, round(least(1, {TAIL.format(k="greatest(k, ns + ka - na)", n="ns", ka="ka", na="na")}), 6) AS p_value FROM j""")
def long_document_sources(spark, d):
    return rounded(de.region_enrichment(read_table(spark, d, "documents"), F.col("n_chars") > 3000, "source", ["none", ""]))


@query(f"""{X}, z AS (SELECT platform, gene, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM expr WINDOW w AS (PARTITION BY platform, gene)),
  pr AS (SELECT 'GPL_A' AS a, 'GPL_B' AS b UNION ALL SELECT 'GPL_A', 'GPL_C' UNION ALL SELECT 'GPL_B', 'GPL_C'),
  v AS (SELECT gene, a, b, value, (platform = a)::INT AS c1, (platform = b)::INT AS c0 FROM z JOIN pr ON platform IN (a, b) WHERE value IS NOT NULL),
  n AS (SELECT gene, a, b, sum(c1)::BIGINT AS n1, sum(c0)::BIGINT AS n0 FROM v GROUP BY 1, 2, 3),
  s AS (SELECT gene, a, b, n1, n0, abs(sum(c1) OVER w / n1 - sum(c0) OVER w / n0) AS gap FROM v JOIN n USING (gene, a, b) WINDOW w AS (PARTITION BY gene, a, b ORDER BY value))
  SELECT gene, a, b, n1, n0, round(max(gap), 6) AS ks FROM s GROUP BY ALL""")
def platform_distances(spark, d):
    return rounded(de.modality_distances(nm.harmonize(views.expression(spark, d))))


@query("""SELECT DISTINCT source, CASE WHEN lower(source) LIKE 'gpl%' OR contains(lower(source), 'array') THEN 'microarray' WHEN regexp_matches(lower(source), 'scrna|single|cellxgene|census|_sc|sc_') THEN 'single-cell'
  WHEN regexp_matches(lower(source), 'ngs|rnaseq|rna-seq|rna_seq|counts|deseq|cpm|salmon|star|kallisto') THEN 'rna-seq' ELSE 'expression' END AS modality
  FROM (SELECT source FROM documents UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'GPL' || n_nationkey FROM nation)""")
def source_modalities(spark, d):
    nation = read_table(spark, d, "nation")
    names = read_table(spark, d, "documents").select("source").union(nation.select("n_name")).union(nation.select(F.concat(F.lit("GPL"), "n_nationkey")))
    return names.distinct().select("source", de.modality(F.col("source")).alias("modality"))


@query("""WITH s AS (SELECT c_nationkey AS c, count(*) AS n, n_regionkey * 0.25::DOUBLE AS j FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, n_regionkey HAVING count(*) >= 2)
  SELECT x.c AS a, x.n AS n_a, y.c AS b, y.n AS n_b FROM s x JOIN s y ON x.c < y.c WHERE x.j >= 0.6 AND y.j >= 0.6""")
def cohort_pairs(spark, d):
    stable = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), (F.col("n_regionkey") * 0.25).alias("bootstrap_jaccard"))
    return co.cohort_pairs(co.cohort_summary(read_table(spark, d, "customer"), "c_nationkey", "c_mktsegment", stable), 2, 0.6)


@query()
def cohort_stability(spark, d):
    vectors = read_table(spark, d, "embeddings")
    return rounded(co.stability(vectors, vectors.select("vec_id", F.col("label").alias("cluster")), "vec_id", "embedding", 50))


@query()
def sample_components(spark, d):
    scores = co.principal_components(read_table(spark, d, "embeddings"), "vec_id", "embedding", 2)
    return scores.select("vec_id", F.abs(F.col("scores")[0]).alias("pc1"), F.abs(F.col("scores")[1]).alias("pc2"))
