"""Normalisation and quality control of long-format expression data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, join_groups


def qc_metrics(counts: DataFrame, mito: Column) -> DataFrame:
    """Per sample: library_size, n_genes_detected, pct_mito (0 for an empty library); one shuffle, partial sums first."""
    library = F.sum("count")
    return counts.groupBy("sample_id").agg(
        library.alias("library_size"),
        F.count_if(F.col("count") > 0).alias("n_genes_detected"),
        F.coalesce(F.try_divide(100 * F.sum(F.when(mito, F.col("count")).otherwise(0.0)), library), F.lit(0.0)).alias("pct_mito"),
    )


def cpm(counts: DataFrame, prior: float = 1.0) -> DataFrame:
    """Counts per million and log2(CPM + prior); 0 for an empty library. Sizes join back, so no sample must fit a task."""
    sizes = counts.groupBy("sample_id").agg(F.sum("count").alias("library"))
    value = F.coalesce(F.try_divide(F.col("count") * 1e6, F.col("library")), F.lit(0.0))
    return counts.join(sizes, "sample_id").select("sample_id", "gene", value.alias("cpm"), F.log2(value + prior).alias("log_cpm"))


def platform_scale(value: Column, above: float = 50.0) -> Column:
    """Negative values to 0; log2 of values above ``above`` only; nulls stay."""
    v = F.when(value < 0, 0.0).otherwise(value)
    return F.when(v > above, F.log2(v)).otherwise(v)


def quantile_normalize(expr: DataFrame) -> DataFrame:
    """Every sample gets the same distribution: the mean over samples of each rank.

    Nulls take their sample's median for ranking and are null again after it; a sample without
    values counts as 0. Ties are ranked by gene. Two shuffles by sample and by rank.
    """
    middle = expr.groupBy("sample_id").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("middle"))
    filled = expr.join(middle, "sample_id").withColumn("filled", F.coalesce("value", "middle"))
    ranked = filled.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("filled", "gene")))
    means = ranked.groupBy("rank").agg(F.avg("filled").alias("mean"))
    return ranked.join(means, "rank").select("sample_id", "gene", F.when(F.col("value").isNotNull(), F.col("mean")).alias("value"))


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios to the gene's geometric mean, over genes without a zero in any sample.

    Without such genes a sample's factor is its library over the mean library.
    """
    n = counts.select("sample_id").distinct().agg(F.count("*").alias("n_samples"))
    genes = counts.groupBy("gene").agg(F.avg(F.log("count")).alias("log_mean"), F.min("count").alias("least"), F.count("*").alias("n"))
    full = genes.crossJoin(F.broadcast(n)).where("least > 0 and n = n_samples").select("gene", "log_mean")  # n is one row
    ratios = counts.join(full, "gene").groupBy("sample_id").agg(F.exp(F.median(F.log("count") - F.col("log_mean"))).alias("by_ratio"))
    library = counts.groupBy("sample_id").agg(F.sum("count").alias("library"))
    mean = library.agg(F.avg("library").alias("mean_library"))
    joined = library.join(ratios, "sample_id", "left").crossJoin(F.broadcast(mean))  # mean is one row
    return joined.select("sample_id", F.coalesce("by_ratio", F.try_divide("library", "mean_library")).alias("size_factor"))


def expressed_genes(counts: DataFrame, min_count: float) -> DataFrame:
    """Rows of genes whose counts sum to at least ``min_count``."""
    return counts.join(counts.groupBy("gene").agg(F.sum("count").alias("total")).where(F.col("total") >= min_count).select("gene"), "gene", "left_semi")


def most_variable(expr: DataFrame, n: int) -> DataFrame:
    """The ``n`` genes of highest population variance; ties by name."""
    return expr.groupBy("gene").agg(F.var_pop("value").alias("variance")).orderBy(F.desc("variance"), "gene").limit(n)


def harmonize(expr: DataFrame, method: str = "zscore") -> DataFrame:
    """Per platform and gene: z-scores (sample sd; 0 where it is 0), ranks scaled to 0..1, or values as they are."""
    key = ["platform", "gene"]
    if method == "none":
        return expr.select("platform", "sample_id", "gene", "value")
    if method == "zscore":
        moments = expr.groupBy(*key).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
        z = F.when(F.col("sd") > 0, (F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0)
        return expr.join(moments, key).select("platform", "sample_id", "gene", z.alias("value"))
    if method != "rank":
        raise ValueError(f"unknown method {method!r}")
    group = Window.partitionBy(*key)
    rank = F.row_number().over(group.orderBy("value", "sample_id")) - 1
    return expr.select("platform", "sample_id", "gene", (rank / F.greatest(F.count("value").over(group) - 1, F.lit(1))).alias("value"))


def map_probes(values: DataFrame, probe_map: DataFrame) -> DataFrame:
    """Mean over a gene's probes, nulls left out: (gene, sample_id, value)."""
    return values.join(probe_map, "probe_id").where("gene is not null").groupBy("gene", "sample_id").agg(F.avg("value").alias("value"))


def repair_probe_ids(ids: Column, width: int | None = None) -> Column:
    """Probe ids without a trailing ``.0``, zero-padded to ``width`` if they are digits."""
    plain = F.regexp_replace(F.trim(ids), r"\.0$", "")
    return plain if width is None else F.when(plain.rlike(r"^\d+$"), F.lpad(plain, width, "0")).otherwise(plain)


def map_probes_repaired(values: DataFrame, probe_map: DataFrame) -> DataFrame:
    """map_probes and, only if that gives no value at all, once more with the ids of both sides repaired.

    Repaired ids have no trailing ``.0``; ids of digits are padded with zeros to the longest of either side.
    """
    direct = map_probes(values, probe_map)
    if not direct.where("value is not null").isEmpty():
        return direct
    plain = [t.withColumn("probe_id", repair_probe_ids(F.col("probe_id").cast("string"))) for t in (values, probe_map)]
    width = max(t.agg(F.max(F.length("probe_id"))).first()[0] or 0 for t in plain)
    return map_probes(*(t.withColumn("probe_id", repair_probe_ids(F.col("probe_id"), width or None)) for t in plain))


def platform_normalize(expr: DataFrame, above: float = 50.0) -> DataFrame:
    """A platform's values: no negative ones, log2 of those above ``above``, one distribution for all samples, no negative ones."""
    scaled = expr.withColumn("value", platform_scale(F.col("value"), above))
    return quantile_normalize(scaled).withColumn("value", F.when(F.col("value") < 0, 0.0).otherwise(F.col("value")))


def combine_matrices(parts: list[DataFrame]) -> DataFrame:
    """One matrix of many (sample_id, probe_id, value): earlier parts win, parts without values are left out."""
    rows = None
    for k, part in enumerate(parts):
        one = part.select("sample_id", "probe_id", "value", F.lit(k).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    live = rows.groupBy("part").agg(F.count("value").alias("n")).where("n > 0").select("part")
    first = F.min_by(F.struct("value"), "part")["value"]
    owner = rows.join(live, "part", "left_semi").groupBy("sample_id").agg(F.min("part").alias("part"))
    return rows.join(owner, ["sample_id", "part"], "left_semi").groupBy("sample_id", "probe_id").agg(first.alias("value"))


def outliers(expr: DataFrame, z: float = 3.0, whisker: float = 1.5) -> DataFrame:
    """Per gene: values beyond ``z`` population deviations, and values outside the quartiles by ``whisker`` ranges."""
    s = expr.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    s = join_groups(s, exact_quantiles(expr, ["gene"], "value", [0.25, 0.75]), ["gene"])
    s = s.select("gene", "m", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    far = (F.col("sd") > 0) & (F.abs(F.col("value") - F.col("m")) > z * F.col("sd"))
    out = (F.col("value") < F.col("q1") - whisker * iqr) | (F.col("value") > F.col("q3") + whisker * iqr)
    return expr.join(s, "gene").groupBy("gene").agg(F.count_if(far).alias("n_zscore"), F.count_if(out).alias("n_iqr"))
