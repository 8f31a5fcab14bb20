"""Logical views of expression data over the tables at hand, and their SQL.

The long format (sample_id, gene, value) is the only stored form; wide matrices exist for small exports alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform, sample_id, label, gene, value): embeddings as samples by genes; NaN is null."""
    e = read_table(spark, sf_dir, "embeddings")
    platform = F.element_at(F.array(F.lit("GPL_A"), F.lit("GPL_B"), F.lit("GPL_C")), (F.col("vec_id") % 3 + 1).cast("int"))
    x = e.select(platform.alias("platform"), F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return x.select("platform", "sample_id", "label", F.concat(F.lit("g"), "i").alias("gene"), F.when(~F.isnan(v), v).alias("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, gene, count): quantity of each brand by supplier."""
    items = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    genes = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(genes, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, donor_id, cell_type, value): events as single cells."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("user_id").alias("donor_id"), F.col("event_type").alias("cell_type"), "value")


def metadata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Platforms, series, samples and their links, in the shape of a sample catalogue."""
    nation, customer, orders = (read_table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return {
        "gpl": nation.select(F.concat(F.lit("GPL"), "n_nationkey").alias("gpl"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias("organism")),
        "gse": customer.select(F.concat(F.lit("GSE"), "c_custkey").alias("gse"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary")),
        "gse_gpl": customer.select(F.concat(F.lit("GSE"), "c_custkey").alias("gse"), F.concat(F.lit("GPL"), "c_nationkey").alias("gpl")),
        "gse_gsm": orders.select(F.concat(F.lit("GSE"), "o_custkey").alias("gse"), F.concat(F.lit("GSM"), "o_orderkey").alias("gsm")),
        "gsm": orders.select(F.concat(F.lit("GSM"), "o_orderkey").alias("gsm"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source_name")),
    }


EXPRESSION_SQL = """expr AS (SELECT ['GPL_A', 'GPL_B', 'GPL_C'][(vec_id % 3 + 1)::INT] AS platform, vec_id AS sample_id, label,
  'g' || (i - 1) AS gene, embedding[i]::DOUBLE AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""
COUNTS_SQL = """counts AS (SELECT l_suppkey AS sample_id, p_brand AS gene, sum(l_quantity) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
CELLS_SQL = "cells AS (SELECT event_id AS cell_id, user_id AS donor_id, event_type AS cell_type, value FROM events)"
