"""Descriptions of distributions and comparisons between groups: what plots and reports are drawn from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import hypergeom_sf, kolmogorov_sf, ks_two_sample_sf, student_sf2
from .quantiles import exact_quantiles, join_groups
from .statistics import benjamini_hochberg


def transformation(rows: DataFrame, by: list[str]) -> DataFrame:
    """A transformation that each group's skewness and signs ask for: by, n, skew, advice."""
    m = rows.where("value is not null").groupBy(*by).agg(F.count("*").alias("n"), F.skewness("value").alias("skew"), F.min("value").alias("low"), F.count_if(F.col("value") == 0).alias("zeros"))
    s, low = F.coalesce("skew", F.lit(0.0)), F.col("low")
    # The advice by name.
    advice = (
        F.when(F.col("n") < 10, "None").when(F.abs(s) < 0.5, "None (already approximately normal)").when((s > 1) & (low > 0), "Log transformation")
        .when((s > 1) & (low >= 0), "Log(x+1) transformation").when((s > 0.5) & (low >= 0), "Square root transformation")
        .when(s > 0.5, "Yeo-Johnson transformation (handles negatives)").when(s < -1, "Reflect and log transformation")
        .when(s < -0.5, "Square transformation or Yeo-Johnson").when(low > 0, "Box-Cox transformation").otherwise("Yeo-Johnson transformation")
    )
    return m.select(*by, "n", "skew", advice.alias("advice"))


def bin_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Histogram bins of each group by four rules, within 10 to 100: sturges, scott, fd, auto. Without spread scott and fd say 30."""
    live = rows.where("value is not null")
    m = live.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("range"))
    m = join_groups(m, exact_quantiles(live, by, "value", [0.25, 0.75]).drop("n"), by)
    root = F.cbrt("n")
    clamp = lambda x: F.greatest(F.lit(10), F.least(F.lit(100), x)).cast("int")
    width = lambda h: F.when(h > 0, F.ceil(F.col("range") / h)).otherwise(30)
    return m.select(
        *by, clamp(F.ceil(F.log2("n") + 1)).alias("sturges"), clamp(width(3.5 * F.col("sd") / root)).alias("scott"),
        clamp(width(2 * (F.col("q")[1] - F.col("q")[0]) / root)).alias("fd"), clamp(F.floor(F.sqrt("n"))).alias("auto"),
    )


def density(rows: DataFrame, by: list[str], points: int = 64, pad: float = 0.1) -> DataFrame:
    """Gaussian kernel density of each group on a grid over its range, padded by ``pad`` of it: by, k, x, density.

    Scott's bandwidth. Each row adds to its group's grid before the shuffle; groups without spread have no density.
    """
    live = rows.where("value is not null")
    m = live.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("sd > 0")
    m = m.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).withColumn("gap", (F.col("hi") - F.col("lo")) * (1 + 2 * pad) / (points - 1))
    m = m.select(*by, "n", "h", "gap", (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("x0"))
    at = live.join(m, by).select(*by, "n", "h", "gap", "x0", "value", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    u = (F.col("x0") + F.col("k") * F.col("gap") - F.col("value")) / F.col("h")
    sums = at.groupBy(*by, "n", "h", "gap", "x0", "k").agg(F.sum(F.exp(-0.5 * u * u)).alias("s"))
    return sums.select(*by, "k", (F.col("x0") + F.col("k") * F.col("gap")).alias("x"), (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Bland-Altman limits of paired values (a, b): by, n, bias, lower, upper, n_outside (1.96 sample deviations)."""
    d = pairs.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    m = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("bias"), (1.96 * F.stddev_samp("d")).alias("half"))
    out = F.count_if(F.abs(F.col("d") - F.col("bias")) > F.col("half"))
    return d.join(m, by).groupBy(*by, "n", "bias", "half").agg(out.alias("n_outside")).select(
        *by, "n", "bias", (F.col("bias") - F.col("half")).alias("lower"), (F.col("bias") + F.col("half")).alias("upper"), "n_outside"
    )


def student(moments: DataFrame) -> DataFrame:
    """Student's t of equal variances from (n1, n0, m1, m0, v1, v0), both n at least 3; t_stat, df, p_value."""
    df = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / df
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0"))))
    tested = moments.where("n1 >= 3 and n0 >= 3").withColumn("t_stat", t).withColumn("df", df.cast("double"))
    return tested.withColumn("p_value", student_sf2("t_stat", "df"))


def stars(p: Column) -> Column:
    """The usual marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def group_pairs(rows: DataFrame, group: str, by: list[str]) -> DataFrame:
    """All pairs a < b of the groups of each gene by their moments: by, a, b, delta, cohen, t_stat, df, p_value, mark.

    One row a group meets the others; values are aggregated before.
    """
    m = rows.where(F.col("value").isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    one = m.select(*by, F.col(group).alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    other = m.select(*by, F.col(group).alias("b"), F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    t = student(one.join(other, by).where("a < b"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.col("df"))
    delta = F.col("m1") - F.col("m0")
    return t.select(*by, "a", "b", delta.alias("delta"), F.try_divide(delta, pooled).alias("cohen"), "t_stat", "df", "p_value", stars(F.col("p_value")).alias("mark"))


def group_enrichment(rows: DataFrame, group: str, value: str, min_count: int = 3) -> DataFrame:
    """Labels of each group against all rows, in long form: group, value, k, k_all, n, n_all, fold. One count of pairs
    serves all groups; labels with fewer than ``min_count`` rows in all, and missing ones, are left out."""
    pairs = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    groups, labels = pairs.groupBy(group).agg(F.sum("k").alias("n")), pairs.groupBy(value).agg(F.sum("k").alias("k_all"))
    total = pairs.agg(F.sum("k").alias("n_all"))
    j = pairs.join(groups, group).join(labels.where(F.col("k_all") >= min_count), value).crossJoin(F.broadcast(total))  # one row
    return j.select(group, value, "k", "k_all", "n", "n_all", (F.col("k") * F.col("n_all") / (F.col("n") * F.col("k_all"))).alias("fold"))


def group_enrichment_tests(counts: DataFrame, group: str) -> DataFrame:
    """Add the one-sided p of over-representation and its q within each group."""
    return benjamini_hochberg(counts.withColumn("p_value", hypergeom_sf("k", "k_all", "n", "n_all")), "p_value", (group,))


def region_enrichment(rows: DataFrame, selected: Column, value: str, missing: list[str]) -> DataFrame:
    """Labels of the selected rows against the rest: value, selected, rest, fold, p_value (one-sided, not adjusted).
    Missing labels take no part; a label without rest rows has a null fold."""
    live = rows.where(F.col(value).isNotNull() & ~F.lower(value).isin(missing)).withColumn("sel", F.coalesce(selected, F.lit(False)))
    total = live.agg(F.count_if("sel").alias("ns"), F.count_if(~F.col("sel")).alias("nr"))
    n = live.groupBy(value).agg(F.count_if("sel").alias("selected"), F.count_if(~F.col("sel")).alias("rest")).where("selected > 0").crossJoin(F.broadcast(total))  # one row
    p = hypergeom_sf(F.col("selected"), F.col("selected") + F.col("rest"), F.col("ns"), F.col("ns") + F.col("nr"))
    fold = F.try_divide(F.col("selected") * F.col("nr"), F.col("rest") * F.col("ns"))
    return n.select(value, "selected", "rest", fold.alias("fold"), p.alias("p_value"))


def modality(name: Column) -> Column:
    """Kind of data that a source's name tells: microarray, single-cell, rna-seq or expression."""
    n = F.lower(name)
    # Name patterns by kind, first match wins.
    return (
        F.when(n.startswith("gpl") | n.contains("array"), "microarray").when(n.rlike("scrna|single|cellxgene|census|_sc|sc_"), "single-cell")
        .when(n.rlike("ngs|rnaseq|rna-seq|rna_seq|counts|deseq|cpm|salmon|star|kallisto"), "rna-seq").otherwise("expression")
    )


def modality_distances(harmonized: DataFrame, by: str = "platform") -> DataFrame:
    """Kolmogorov-Smirnov D of each gene between each pair of sources: gene, a, b, n1, n0, ks.

    Each pair of sources is one comparison of merged step functions; sources are few, so values are repeated once a partner.
    """
    rows = harmonized.where("value is not null").groupBy("gene", by, "value").agg(F.count("*").alias("c"))
    sources = rows.select(F.col(by).alias("other")).distinct()
    each = rows.withColumn("s", F.col(by)).join(F.broadcast(sources), F.col("s") != F.col("other"))  # one row a source
    each = each.select("gene", F.least("s", "other").alias("a"), F.greatest("s", "other").alias("b"), "value", F.when(F.col("s") < F.col("other"), F.col("c")).otherwise(0).alias("c1"), F.when(F.col("s") > F.col("other"), F.col("c")).otherwise(0).alias("c0"))
    steps = each.groupBy("gene", "a", "b", "value").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    n = steps.groupBy("gene", "a", "b").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).where("n1 > 0 and n0 > 0")
    up = Window.partitionBy("gene", "a", "b").orderBy("value")
    gap = F.abs(F.sum("c1").over(up) / F.col("n1") - F.sum("c0").over(up) / F.col("n0"))
    return steps.join(n, ["gene", "a", "b"]).select("gene", "a", "b", "n1", "n0", gap.alias("gap")).groupBy("gene", "a", "b", "n1", "n0").agg(F.max("gap").alias("ks"))


def modality_verdicts(harmonized: DataFrame, by: str = "platform", exact: bool = True) -> DataFrame:
    """``modality_distances`` with p_value and verdict, "same shape" from 0.05 on, else "differs". Pairs with a source of one value have no verdict and no row.

    ``exact``: the p-value is exact for small samples, as ``tails.ks_two_sample_sf`` says; else asymptotic.
    """
    d = modality_distances(harmonized, by).where("n1 > 1 and n0 > 1")
    p = ks_two_sample_sf("ks", "n1", "n0") if exact else kolmogorov_sf(F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))) * F.col("ks"))
    return d.withColumn("p_value", p).withColumn("verdict", F.when(F.col("p_value") >= 0.05, "same shape").otherwise("differs"))


def modality_concordance(rows: DataFrame, classes: DataFrame, verdicts: DataFrame, by: str = "platform") -> DataFrame:
    """gene, n_sources, n_pairs, n_same, concordant, classes, summary of each gene: whether all of its sources share a distribution class.

    ``rows`` are raw values, ``classes`` (gene, ``by``, distribution) and ``verdicts`` those of ``modality_verdicts``. Kinds of data are read from
    the names of the sources. Genes without a value have no row.
    """
    named = classes.groupBy("gene").agg(F.array_sort(F.collect_set("distribution")).alias("classes"))  # nine classes at most
    kinds = rows.where("value is not null and not isnan(value)").select("gene", by).distinct()
    found = kinds.groupBy("gene").agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_set(modality(F.col(by)))).alias("kinds"))
    pairs = verdicts.groupBy("gene").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("verdict") == "same shape").alias("n_same"))
    j = found.join(named, "gene").join(pairs, "gene", "left").fillna(0, ["n_pairs", "n_same"]).withColumn("concordant", F.size("classes") == 1)
    shape = F.when(F.col("n_pairs") > 0, F.format_string(" %d/%d source pair(s) share the same shape.", "n_same", "n_pairs")).otherwise("")
    kind = F.when(F.col("concordant"), "is consistent").otherwise("varies across modalities")
    text = F.concat(F.col("gene"), F.lit(" compared across "), F.col("n_sources").cast("string"), F.lit(" source(s) ["), F.array_join("kinds", ", "), F.lit("]."), shape, F.lit(" Distribution class "), kind, F.lit(" ("), F.array_join("classes", ", "), F.lit(")."))
    return j.select("gene", "n_sources", "n_pairs", "n_same", "concordant", "classes", text.alias("summary"))


def platform_comparison(rows: DataFrame, gene: str, by: str = "platform") -> tuple[DataFrame, DataFrame]:
    """One gene on every platform, for a report: its statistics, and the distance of raw values between the first two platforms, by name, that have more
    than one value (no row with fewer)."""
    own = rows.where((F.upper("gene") == gene.strip().upper()) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    stats = own.groupBy("gene", by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    first = [r[0] for r in stats.where("n > 1").orderBy(by).select(by).limit(2).collect()]
    return stats, modality_verdicts(own.where(F.col(by).isin(first)), by)


def group_distances(rows: DataFrame, group: str, bins: int = 49) -> DataFrame:
    """Distances of each gene's values between each pair a < b of groups: gene, a, b, wasserstein, delta_mean, js (the root of the Jensen-Shannon divergence in nats, of ``bins`` bins over the
    pair's range).

    Values are counted before they are repeated, once for each other group, of which there are few. Nulls and NaN take no part.
    """
    v = F.col("value").cast("double")
    counted = rows.where(v.isNotNull() & ~F.isnan(v) & F.col(group).isNotNull()).groupBy("gene", F.col(group).alias("g"), v.alias("v")).agg(F.count("*").alias("c"))
    groups = counted.select(F.col("g").alias("other")).distinct()
    each = counted.join(F.broadcast(groups), F.col("g") != F.col("other"))  # one row a group
    side = lambda first: F.when(F.col("g") < F.col("other") if first else F.col("g") > F.col("other"), F.col("c")).otherwise(0)
    steps = each.select("gene", F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"), "v", side(True).alias("c1"), side(False).alias("c0")).groupBy("gene", "a", "b", "v").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    keys = ["gene", "a", "b"]
    sizes = steps.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n1 > 0 and n0 > 0")
    met = steps.join(sizes, keys)
    up = Window.partitionBy(*keys).orderBy("v")
    gap = F.abs(F.sum("c1").over(up) / F.col("n1") - F.sum("c0").over(up) / F.col("n0")) * F.coalesce(F.lead("v").over(up) - F.col("v"), F.lit(0.0))
    mean = F.sum(F.col("c1") * F.col("v") / F.col("n1")) - F.sum(F.col("c0") * F.col("v") / F.col("n0"))
    moved = met.withColumn("gap", gap).groupBy(*keys).agg(F.sum("gap").alias("wasserstein"), F.abs(mean).alias("delta_mean"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    shares = met.groupBy(*keys, at.alias("bin")).agg(F.sum(F.col("c1") / F.col("n1")).alias("p"), F.sum(F.col("c0") / F.col("n0")).alias("q"))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    js = shares.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)).alias("js"))
    return moved.join(js, keys)
