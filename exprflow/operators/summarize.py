"""Aggregations over samples, cells and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def gene_stats(expr: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, median, sd, min, max and coefficient of variation of each group."""
    m, sd = F.avg("value"), F.stddev_samp("value")
    return expr.groupBy(*by).agg(
        F.count("value").alias("n"), m.alias("mean"), F.median("value").alias("median"), sd.alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.try_divide(sd, m).alias("cv"),
    )


def quartiles(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, q25, median, q75 and interquartile range of each group."""
    return exact_quantiles(rows, by, "value", [0.25, 0.5, 0.75]).select(
        *by, "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")
    )


def pseudobulk(cells: DataFrame, by: list[str], min_cells: int = 10, n_cells: DataFrame | None = None) -> DataFrame:
    """Sum, mean and cell count of each group; groups with fewer than ``min_cells`` are left out.

    ``cells`` may be sparse: with ``n_cells`` (by, n_cells) the mean is over all cells of a group, missing rows as 0.
    """
    sums = cells.groupBy(*by).agg(F.sum("value").alias("total"), F.count("*").alias("n_rows"))
    if n_cells is not None:
        sums = sums.join(n_cells, [c for c in by if c in n_cells.columns])
    else:
        sums = sums.withColumn("n_cells", F.col("n_rows"))
    return sums.where(F.col("n_cells") >= min_cells).select(*by, "n_cells", "total", (F.col("total") / F.col("n_cells")).alias("mean"))


def pseudobulk_preview(cells: DataFrame, by: list[str], min_cells: int = 10) -> DataFrame:
    """Groups in all, kept and dropped, and the largest, median and smallest kept size."""
    sizes = cells.groupBy(*by).agg(F.count("*").alias("n"))
    kept = F.when(F.col("n") >= min_cells, F.col("n"))
    return sizes.agg(
        F.count("*").alias("n_groups"), F.count(kept).alias("n_kept"), (F.count("*") - F.count(kept)).alias("n_dropped"),
        F.max("n").alias("largest"), F.median("n").alias("median_size"), F.min(kept).alias("smallest_kept"),
    )


def composition(rows: DataFrame, group: str, stack: str, top: int) -> DataFrame:
    """Share of each stack in each group; stacks beyond the ``top`` most frequent are ``other``."""
    pairs = rows.groupBy(group, stack).agg(F.count("*").alias("n"))
    ranks = pairs.groupBy(stack).agg(F.sum("n").alias("of_stack")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("of_stack"), stack)))
    named = pairs.join(ranks, stack).select(group, F.when(F.col("r") <= top, F.col(stack)).otherwise("other").alias("stack"), "n")
    summed = named.groupBy(group, "stack").agg(F.sum("n").alias("n"))
    return summed.select(group, "stack", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("share"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs of values and their share of the first value's rows."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.select(a, b, "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy(a))).alias("row_pct"))


def dot_plot(expr: DataFrame, group: str) -> DataFrame:
    """Mean expression and fraction of samples above zero, per group and gene."""
    return expr.groupBy(group, "gene").agg(F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("fraction"))


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def value_histogram(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Values of each group with case folded: count, and the most common spelling (ties: the smaller)."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    return n.groupBy(*group, F.lower(value).alias("folded")).agg(
        F.sum("c").alias("n"), F.min_by(value, F.struct((-F.col("c")).alias("c"), F.col(value))).alias("spelling")
    )


def others_histogram(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """For each row: how many other rows of its group have its value, and how many others there are."""
    n = rows.groupBy(*group, value).agg(F.count("*").alias("same"))
    total = n.groupBy(*group).agg(F.sum("same").alias("all"))
    return rows.join(n, [*group, value]).join(total, group).withColumn("same", F.col("same") - 1).withColumn("others", F.col("all") - 1).drop("all")


def confusion(rows: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of each group and overall (null group), in one pass over grouping sets."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    out = rows.rollup(*by).agg(
        F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn")
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select(
        *by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def promotable(rows: DataFrame, key: list[str], target: str, study: str, least: int) -> DataFrame:
    """Keys seen with one target only, in at least ``least`` studies."""
    seen = rows.groupBy(*key).agg(F.countDistinct(study).alias("n_studies"), F.min(target).alias("target"), F.max(target).alias("last"))
    return seen.where((F.col("n_studies") >= least) & (F.col("target") == F.col("last"))).drop("last")


def label_frequency(rows: DataFrame, selected, value: str) -> DataFrame:
    """Selected, rest and total counts of each value, their percentages, and the ratio of these."""
    sums = rows.agg(F.count_if(selected).alias("ns"), F.count("*").alias("nt"))
    n = rows.groupBy(value).agg(F.count_if(selected).alias("selected"), F.count("*").alias("total"))
    s, t = 100 * F.try_divide("selected", "ns"), 100 * F.try_divide("total", "nt")
    return n.crossJoin(F.broadcast(sums)).select(  # one row of sums
        value, "selected", (F.col("total") - F.col("selected")).alias("rest"), "total", s.alias("sel_pct"), t.alias("plat_pct"), F.try_divide(s, t).alias("ratio")
    )


def latest(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last written row of each key: what an upsert leaves."""
    return keep_first(rows, key, [F.desc(at), F.desc(tie)])


def rare_values(rows: DataFrame, value: str) -> DataFrame:
    """Values with at most max(3, a tenth of all rows) rows."""
    total = rows.agg(F.count("*").alias("t"))
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).where("n <= greatest(3, t div 10)").select(value, "n")  # one row of totals
