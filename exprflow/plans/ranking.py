"""Queries of rankings, distribution classes and platform values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as ds
from ..operators import normalize as nm
from ..operators import statistics as st
from ..registry import query
from ..session import read_table
from ..sources import views
from .catalog import EFFECTS, MOMENTS, C, effects, pair, rounded

# Coefficients of the published fit of erfc, lowest power first, as in functions.tails.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_p_sql(z: str) -> str:
    """DuckDB SQL of the two-sided normal p-value of ``z``."""
    x, poly = f"(abs({z}) / sqrt(2))", str(ERFC[-1])
    t = f"(1 / (1 + 0.5 * {x}))"
    for a in reversed(ERFC[:-1]):
        poly = f"({poly} * {t} + ({a}))"
    return f"least(1.0, {t} * exp(-{x} * {x} + {poly}))"


@query(f"""{MOMENTS}, z AS (SELECT *, ln((v1 + 1e-12) / (v0 + 1e-12)) / sqrt(2 / (n1 - 1) + 2 / (n0 - 1)) AS z FROM m WHERE n1 >= 3 AND n0 >= 3)
  SELECT gene, round(v1, 6) AS var_case, round(v0, 6) AS var_control, round(m1, 6) AS mean_case, round(m0, 6) AS mean_control, round(v1 - v0, 6) AS delta_var,
  round(z, 6) AS stat, round({normal_p_sql("z")}, 6) AS p_value, round(z, 6) AS rank FROM z""")
def variability_ranked(spark, d):
    return rounded(st.rank_by_variability(pair(spark, d), "logvar_z"))


@query(f"""{EFFECTS}, w AS (SELECT gene, fc, (t / fc) ** 2 AS w FROM e WHERE t <> 0), a AS (SELECT gene, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * fc) AS swx,
  sum(w * fc * fc) AS swxx FROM w GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT *, greatest(0, swxx - swx * swx / sw) AS q FROM a),
  c AS (SELECT gene, k, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM b),
  p AS (SELECT gene, k, sum(fc / (1 / w + tau2)) / sqrt(sum(1 / (1 / w + tau2))) AS z FROM w JOIN c USING (gene) GROUP BY ALL),
  t AS (SELECT gene, k, z, {normal_p_sql("z")} AS p FROM p), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM t)
  SELECT gene, k, round(z, 6) AS z, round(p, 6) AS p_value, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 6) AS q_value FROM r""")
def meta_effect_tests(spark, d):
    return rounded(st.combine_ranks(effects(spark, d)).select("gene", "k", "z", "p_value", "q_value"))


@query(f"""{C}, v AS (SELECT sample_id, gene, CASE WHEN count > 50 THEN log2(count) ELSE greatest(count, 0) END AS value FROM counts),
  r AS (SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY value, gene) AS k, value FROM v), m AS (SELECT k, avg(value) AS v FROM r GROUP BY 1)
  SELECT sample_id, gene, round(greatest(v, 0), 6) AS value FROM r JOIN m USING (k)""")
def platform_normalized(spark, d):
    return rounded(nm.platform_normalize(views.counts(spark, d).withColumnRenamed("count", "value")))


@query("""SELECT p_brand AS gene, l_suppkey AS sample_id, round(avg(l_quantity), 6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def probes_mapped_after_repair(spark, d):
    """Ids like ``12.0`` on one side and ``00000012`` on the other meet only after repair."""
    items, parts = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    values = items.select(F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("probe_id"), F.col("l_suppkey").alias("sample_id"), F.col("l_quantity").alias("value"))
    probe_map = parts.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("probe_id"), F.col("p_brand").alias("gene"))
    return rounded(nm.map_probes_repaired(values, probe_map))


@query()
def distribution_class_of_genes(spark, d):
    return ds.distribution_classes(views.expression(spark, d))


@query()
def distribution_class_counts(spark, d):
    counts = views.counts(spark, d).withColumnRenamed("count", "value")
    return rounded(ds.distribution_summary(ds.distribution_classes(counts.unionByName(views.expression(spark, d).select("sample_id", "gene", "value")))))
