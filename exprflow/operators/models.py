"""Fitted models per gene: shrunken variances, resampled intervals, count models and batch correction.

Each is a few grouped aggregations; iterations run on moments (one row a gene or a gene and batch), never on samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_sf2, student_sf2
from .resample import bootstrap
from .statistics import benjamini_hochberg, group_moments


def polygamma(order: int, x: float) -> float:
    """Digamma (0) or trigamma (1) of x > 0: recurrence up to 10, then the asymptotic series."""
    add = 0.0
    while x < 10:
        add += (-1 / x, 1 / x**2)[order]
        x += 1
    i = 1 / (x * x)
    if order == 0:
        return add + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))
    return add + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def variance_prior(mean_log: float, var_log: float, df: float) -> tuple[float, float]:
    """(d0, s0 squared) of the scaled inverse chi-squared prior whose moments of log variances these are.

    The location moves by digamma terms with the signs that the results to match have; the published ones are opposite.
    """
    excess = var_log - polygamma(1, df / 2)
    if not excess > 0:
        d0 = 1e6
    else:
        lo, hi = math.log(1e-8), math.log(1e8)  # trigamma falls, so its inverse is bracketed
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if polygamma(1, math.exp(mid)) > excess else (lo, mid)
        d0 = 2 * math.exp((lo + hi) / 2)
    shift = polygamma(0, df / 2) - math.log(df / 2) - polygamma(0, d0 / 2) + math.log(d0 / 2)
    return d0, max(math.exp(mean_log + shift), 1e-12)


def moderated_t(rows: DataFrame, trim: float = 0.05, least: int = 30) -> DataFrame:
    """Two-group t with variances shrunk to a prior of all genes: gene, log_fc, t_stat, df, p_value, q_value.

    The prior comes from the mean and variance of log variances between their ``trim`` quantiles; only those few numbers
    reach the driver. With fewer than ``least`` genes of positive variance nothing is shrunk. A gene without variance
    has the prior's, and without a prior null t and p. The cohort's residual degrees of freedom hold for every gene.
    """
    m = group_moments(rows).where("n1 >= 2 and n0 >= 2").withColumn("resid", F.col("n1") + F.col("n0") - 2)
    m = m.withColumn("s2", ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.col("resid"))
    logs = m.where("s2 > 0").select(F.log("s2").alias("z"), "resid")
    cut = logs.agg(F.count("*").alias("n"), F.percentile("z", [trim, 1 - trim]).alias("q"), F.max("resid").alias("df")).first()
    t_den = F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))
    if cut["n"] >= least:
        core = logs.where(F.col("z").between(*cut["q"])).agg(F.avg("z").alias("m"), F.var_samp("z").alias("v")).first()
        d0, s0 = variance_prior(core["m"], core["v"], float(cut["df"]))
        s2 = F.when(F.col("s2") > 0, (d0 * s0 + F.col("resid") * F.col("s2")) / (d0 + F.col("resid"))).otherwise(s0)
    else:
        d0, s2 = 0.0, F.when(F.col("s2") > 0, F.col("s2"))
    t = (F.col("m1") - F.col("m0")) / (F.sqrt(s2) * t_den)
    out = m.select("gene", (F.col("m1") - F.col("m0")).alias("log_fc"), t.alias("t_stat"), (F.col("resid") + F.lit(d0)).alias("df"))
    return benjamini_hochberg(out.withColumn("p_value", student_sf2("t_stat", "df")), "p_value")


def bootstrap_mean(rows: DataFrame, by: list[str], key: str, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of each group's mean: by, n, mean, lower, upper.

    See ``resample.bootstrap``, which takes any statistic of sums and the median.
    """
    return bootstrap(rows, by, key, "mean", replicates=replicates, level=level, seed=seed).withColumnRenamed("estimate", "mean")


def count_wald(counts: DataFrame, factors: DataFrame, min_count: float = 10) -> DataFrame:
    """Negative binomial two-group test of (sample_id, gene, count, is_case): gene, base_mean, log2_fc, alpha, z, p_value, q_value.

    A group's rate is its counts over its size factors, then one Fisher scoring step under the gene's dispersion, which
    is the moment estimate over both groups (no trend, no prior, no shrinkage of the fold change). Genes with a rate of
    0 in a group have null log2_fc and z. Genes below ``min_count`` in all are left out.
    """
    y, s = F.col("count"), F.col("size_factor")
    rows = counts.join(factors, "sample_id").where("count is not null and size_factor > 0")
    g = rows.groupBy("gene", "is_case").agg(
        F.count("*").alias("n"), (F.sum(y) / F.sum(s)).alias("rate"), F.avg(y / s).alias("m"), F.var_samp(y / s).alias("v"), F.avg(1 / s).alias("inv"), F.sum(y).alias("total")
    )
    both = g.groupBy("gene").agg(
        (F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("var"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("base_mean"),
        (F.sum(F.col("n") * F.col("inv")) / F.sum("n")).alias("inv"), F.sum("total").alias("total"), F.count("*").alias("k"), F.min("n").alias("least"),
    ).where((F.col("k") == 2) & (F.col("least") >= 2) & (F.col("total") >= min_count))
    alpha = F.greatest(F.lit(1e-8), F.try_divide(F.col("var") - F.col("base_mean") * F.col("inv"), F.col("base_mean") * F.col("base_mean")))
    both = both.select("gene", "base_mean", alpha.alias("alpha"))
    mu = s * F.col("rate")
    w = mu / (1 + F.col("alpha") * mu)
    fitted = rows.join(g.where("rate > 0").select("gene", "is_case", "rate"), ["gene", "is_case"]).join(both, "gene").groupBy("gene", "is_case", "rate").agg(
        F.sum(w).alias("info"), F.sum(w * (y / mu - 1)).alias("score")
    )
    eta = F.log("rate") + F.col("score") / F.col("info")
    case = F.col("is_case")
    one = fitted.withColumn("eta", eta).groupBy("gene").agg(
        F.max(F.when(case, F.col("eta"))).alias("e1"), F.max(F.when(~case, F.col("eta"))).alias("e0"), F.sum(1 / F.col("info")).alias("var_fc"), F.count("*").alias("k")
    ).where("k = 2")
    out = both.join(one, "gene", "left").select(
        "gene", "base_mean", ((F.col("e1") - F.col("e0")) / math.log(2)).alias("log2_fc"), "alpha", ((F.col("e1") - F.col("e0")) / F.sqrt("var_fc")).alias("z")
    )
    return benjamini_hochberg(out.withColumn("p_value", normal_sf2(F.col("z"))), "p_value")


def combat(expr: DataFrame, batch: str = "platform", rounds: int = 30) -> DataFrame:
    """Batch-corrected values of genes that every batch has: (batch, sample_id, gene, value).

    Values are standardised by the gene's grand mean and pooled within-batch deviation. A batch's shift and scale of a
    gene are shrunk to the batch's priors over genes (normal and inverse gamma, by moments), by ``rounds`` fixed-point
    steps on three moments a gene and batch. Genes without variance, and batches with one value of a gene, keep their values.
    """
    rows = expr.where("value is not null").select(F.col(batch).alias("batch"), "sample_id", "gene", "value")
    n_batches = rows.agg(F.countDistinct("batch").alias("k"))
    cell = rows.groupBy("batch", "gene").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    gene = cell.groupBy("gene").agg(
        F.count("*").alias("have"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("sd")
    )
    gene = gene.crossJoin(F.broadcast(n_batches)).where("have = k").select("gene", "grand", "sd")  # one row
    hat = cell.join(gene.where("sd > 0"), "gene").where("n > 1").select(
        "batch", "gene", "n", ((F.col("m") - F.col("grand")) / F.col("sd")).alias("g_hat"), (F.col("v") / (F.col("sd") * F.col("sd"))).alias("z_var")
    ).withColumn("d_hat", F.col("z_var") * F.col("n") / (F.col("n") - 1))
    prior = hat.groupBy("batch").agg(F.avg("g_hat").alias("g_bar"), F.var_samp("g_hat").alias("t2"), F.avg("d_hat").alias("dm"), F.var_samp("d_hat").alias("dv"))
    prior = prior.select(
        "batch", "g_bar", "t2", ((2 * F.col("dv") + F.col("dm") * F.col("dm")) / F.col("dv")).alias("a"),
        ((F.col("dm") * F.col("dv") + F.pow("dm", 3)) / F.col("dv")).alias("b"),
    ).where("t2 > 0 and a is not null")
    n, g_hat = F.col("n"), F.col("g_hat")

    def step(state: Column, _: Column) -> Column:
        shift = (F.col("t2") * n * g_hat + state["d"] * F.col("g_bar")) / (F.col("t2") * n + state["d"])
        squares = n * F.col("z_var") + n * (g_hat - shift) * (g_hat - shift)
        return F.struct(shift.alias("g"), ((0.5 * squares + F.col("b")) / (n / 2 + F.col("a") - 1)).alias("d"))

    start = F.struct(F.col("g_hat").alias("g"), F.col("d_hat").alias("d"))
    solved = hat.join(prior, "batch").select("batch", "gene", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s"))
    solved = solved.select("batch", "gene", "s.g", "s.d")
    z = (F.col("value") - F.col("grand")) / F.col("sd")
    fixed = F.col("sd") * (z - F.col("g")) / F.sqrt("d") + F.col("grand")
    out = rows.join(gene, "gene").join(solved, ["batch", "gene"], "left")
    return out.select(F.col("batch").alias(batch), "sample_id", "gene", F.when((F.col("sd") > 0) & (F.col("d") > 0), fixed).otherwise(F.col("value")).alias("value"))
