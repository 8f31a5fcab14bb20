"""Differential, distributional, correlational and meta statistics over long-format data.

All are grouped aggregations: moments travel, not rows. Ranks and cumulative curves are windows by gene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_sf, fisher_two_sided, hypergeom_sf, kolmogorov_sf, normal_sf2, student_sf2


def two_groups(expr: DataFrame, case: Column, control: Column) -> DataFrame:
    """Rows of either group with ``is_case``; others and null values are left out."""
    return expr.withColumn("is_case", F.when(case, True).when(control, False)).where("is_case is not null and value is not null")


def group_moments(rows: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """n, mean and sample variance of both groups of each gene."""
    a, b = F.when(F.col("is_case"), F.col("value")), F.when(~F.col("is_case"), F.col("value"))
    return rows.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0")
    )


def welch(rows: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Per gene: log_fc, t_stat, df (Welch-Satterthwaite); genes with fewer than two values a group are left out."""
    m = group_moments(rows, by).where("n1 >= 2 and n0 >= 2")
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(s1 + s0))
    df = F.try_divide((s1 + s0) * (s1 + s0), s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1))
    return m.select(*by, "n1", "n0", (F.col("m1") - F.col("m0")).alias("log_fc"), t.alias("t_stat"), df.alias("df"))


def rank_genes(rows: DataFrame) -> DataFrame:
    """Welch's test with p-values, Benjamini-Hochberg q-values and rank = t."""
    tested = welch(rows).withColumn("p_value", student_sf2("t_stat", "df"))
    return benjamini_hochberg(tested, "p_value").withColumn("rank", F.col("t_stat"))


def benjamini_hochberg(rows: DataFrame, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``q_value``: min over larger p of p * m / rank, at most 1; null p stay out of m and get null.

    Equal p share the last rank. Distinct p with their counts are ranged by a step function that is finer near 0;
    ranks and running minima are taken inside a range and go on between ranges from one row a range, so no task
    sees all p-values of a large family.
    """
    live = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    step = F.floor(F.col(p) * 1024) + F.floor(16 * F.log2(F.greatest(F.col(p), F.lit(1e-300))))
    n = live.groupBy(*by, p).agg(F.count("*").alias("_n")).withColumn("_b", step)
    ranges = Window.partitionBy(*by).orderBy("_b")
    sums = n.groupBy(*by, "_b").agg(F.sum("_n").alias("_of_range"))
    sums = sums.select(
        *by, "_b", F.sum("_of_range").over(Window.partitionBy(*by)).alias("_m"),
        F.coalesce(F.sum("_of_range").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy(p)
    rank = F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    raw = n.join(sums, [*by, "_b"]).withColumn("_raw", F.col(p) * F.col("_m") / rank)
    later = raw.groupBy(*by, "_b").agg(F.min("_raw").alias("_least"))
    later = later.select(*by, "_b", F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    own = F.min("_raw").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    q = raw.withColumn("_own", own).join(later, [*by, "_b"]).select(*by, p, F.least(F.lit(1.0), "_own", "_later").alias("q_value"))
    return rows.join(q, [*by, p], "left")


def variability(rows: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Per gene with three values a group: log variance ratio and its z (delta method)."""
    m = group_moments(rows).where("n1 >= 3 and n0 >= 3")
    ratio = F.log2((F.col("v1") + floor) / (F.col("v0") + floor))
    z = F.log((F.col("v1") + floor) / (F.col("v0") + floor)) / F.sqrt(2 / (F.col("n1") - 1) + 2 / (F.col("n0") - 1))
    return m.select("gene", ratio.alias("log_ratio"), z.alias("z"))


def levene(rows: DataFrame, center: str = "median") -> DataFrame:
    """Levene's W (center mean) or Brown-Forsythe's (median) per gene."""
    mid = rows.groupBy("gene", "is_case").agg((F.median if center == "median" else F.avg)("value").alias("c"))
    dev = rows.join(mid, ["gene", "is_case"]).select("gene", "is_case", F.abs(F.col("value") - F.col("c")).alias("d"))
    g = dev.groupBy("gene", "is_case").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("v"))
    one = g.groupBy("gene").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    between = F.col("s2") - F.col("n") * F.col("grand") * F.col("grand")
    return one.where("k = 2").select("gene", F.try_divide((F.col("n") - 2) * between, F.col("within")).alias("w_stat"), (F.col("n") - 2).alias("df"))


def distribution_distance(rows: DataFrame) -> DataFrame:
    """Per gene: Kolmogorov-Smirnov D and Wasserstein-1 distance of the two groups, tie-safe."""
    n = rows.groupBy("gene").agg(F.count_if("is_case").alias("n1"), F.count_if(~F.col("is_case")).alias("n0")).where("n1 > 0 and n0 > 0")
    steps = rows.groupBy("gene", "value").agg(F.count_if("is_case").alias("c1"), F.count_if(~F.col("is_case")).alias("c0")).join(n, "gene")
    up = Window.partitionBy("gene").orderBy("value")
    gap = F.abs(F.sum("c1").over(up) / F.col("n1") - F.sum("c0").over(up) / F.col("n0"))
    step = F.coalesce(F.lead("value").over(up) - F.col("value"), F.lit(0.0))
    curve = steps.select("gene", "n1", "n0", gap.alias("gap"), (gap * step).alias("area"))
    return curve.groupBy("gene", "n1", "n0").agg(F.max("gap").alias("ks"), F.sum("area").alias("wasserstein"))


def ks_p_value(distance: DataFrame) -> DataFrame:
    """Add the asymptotic p-value of ``ks``."""
    return distance.withColumn("p_value", kolmogorov_sf(F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))) * F.col("ks")))


def average_ranks(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Add ``rank``: ties get their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    first = F.rank().over(w)
    return rows.withColumn("rank", first + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def rank_sum(rows: DataFrame) -> DataFrame:
    """Per gene: rank-sum z (no tie correction), Cliff's delta and Cohen's d (0 pooled deviation: null)."""
    r = average_ranks(rows, ["gene"]).groupBy("gene").agg(F.sum(F.when(F.col("is_case"), F.col("rank"))).alias("r1"))
    m = group_moments(rows).where("n1 >= 2 and n0 >= 2").join(r, "gene")
    n1, n0 = F.col("n1"), F.col("n0")
    z = (F.col("r1") - n1 * (n1 + n0 + 1) / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)
    u = F.col("r1") - n1 * (n1 + 1) / 2
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2))
    return m.select("gene", z.alias("z"), (2 * u / (n1 * n0) - 1).alias("cliff"), F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohen"))


def jensen_shannon(rows: DataFrame, bins: int = 49) -> DataFrame:
    """Per gene: square root of the Jensen-Shannon divergence (nats) of histograms over the joint range."""
    edge = rows.groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if("is_case").alias("n1"), F.count_if(~F.col("is_case")).alias("n0"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    h = rows.join(edge, "gene").groupBy("gene", "n1", "n0", at.alias("bin")).agg(F.count_if("is_case").alias("c1"), F.count_if(~F.col("is_case")).alias("c0"))
    p, q = F.col("c1") / F.col("n1"), F.col("c0") / F.col("n0")
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    return h.where("n1 > 0 and n0 > 0").groupBy("gene").agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(part(p)) + F.sum(part(q))) / 2)).alias("js"))


def coexpression(expr: DataFrame, gene: str, method: str = "pearson", by: tuple[str, ...] = ("platform",)) -> DataFrame:
    """Correlation of one gene with every other, per platform: Pearson, Spearman or proportionality.

    The query gene's values are one row a sample; they join by sample, and a gene's moments are one aggregation.
    """
    rows = expr.where("value is not null").select(*by, "sample_id", "gene", "value")
    if method == "spearman":
        rows = average_ranks(rows, [*by, "gene"]).select(*by, "sample_id", "gene", F.col("rank").alias("value"))
    own = rows.where(F.upper("gene") == gene.upper()).select(*by, "sample_id", F.col("value").alias("x"))
    pairs = rows.where(F.upper("gene") != gene.upper()).join(own, [*by, "sample_id"])
    d = F.col("value") - F.col("x")
    if method == "rho":
        r = 1 - F.try_divide(F.var_samp(d), F.var_samp("x") + F.var_samp("value"))
    else:
        r = F.corr("x", "value")
    return pairs.groupBy(*by, "gene").agg(F.count("*").alias("n"), r.alias("r"))


def consensus(per_platform: DataFrame, min_abs: float, least: int = 2) -> DataFrame:
    """Genes with one sign and ``min_abs`` in at least ``least`` platforms: mean r, number of sources."""
    strong = per_platform.where(F.abs("r") >= min_abs).groupBy("gene").agg(
        F.count("*").alias("n_sources"), F.avg("r").alias("mean_r"), F.min(F.sign("r")).alias("lo"), F.max(F.sign("r")).alias("hi")
    )
    return strong.where((F.col("n_sources") >= least) & (F.col("lo") == F.col("hi"))).select("gene", "n_sources", "mean_r")


def rank_product(ranked: DataFrame) -> DataFrame:
    """Signed geometric mean over platforms of the fractional ranks 2 * rank / n - 1; zeros are left out."""
    n = Window.partitionBy("platform")
    f = average_ranks(ranked.where("value is not null"), ["platform"]).withColumn("n", F.count("*").over(n))
    f = f.withColumn("f", 2 * F.col("rank") / F.col("n") - 1).where("f <> 0")
    return f.groupBy("gene").agg(
        F.count("*").alias("n_platforms"), (F.exp(F.avg(F.log(F.abs("f") + 1e-6))) * F.sign(F.avg("f"))).alias("score")
    )


def stouffer(z: DataFrame, weight: Column | None = None) -> DataFrame:
    """Weighted z over platforms, nulls left out."""
    w = F.lit(1.0) if weight is None else weight
    return z.where("z is not null").groupBy("gene").agg(F.count("*").alias("n_platforms"), (F.sum(w * F.col("z")) / F.sqrt(F.sum(w * w))).alias("z"))


def random_effects(effects: DataFrame) -> DataFrame:
    """DerSimonian-Laird over (platform, gene, log_fc, t_stat): pooled effect, se, z, q, tau2, i2; two platforms at least."""
    e = effects.where("log_fc is not null and t_stat <> 0 and log_fc <> 0").withColumn("w", F.pow(F.col("t_stat") / F.col("log_fc"), 2))
    a = e.groupBy("gene").agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("log_fc")).alias("swx"),
        F.sum(F.col("w") * F.col("log_fc") * F.col("log_fc")).alias("swxx"),
    ).where("k >= 2")
    q = F.greatest(F.lit(0.0), F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw"))
    a = a.select("gene", "k", q.alias("q"), F.greatest(F.lit(0.0), F.try_divide(q - (F.col("k") - 1), F.col("sw") - F.col("sw2") / F.col("sw"))).alias("tau2"))
    i2 = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("q") - (F.col("k") - 1)) * 100, F.col("q")), F.lit(0.0))
    w = 1 / (1 / F.col("w") + F.col("tau2"))
    p = e.join(a, "gene").groupBy("gene", "k", "q", "tau2").agg(F.sum(w).alias("ws"), F.sum(w * F.col("log_fc")).alias("wx"))
    return p.select("gene", "k", "q", "tau2", i2.alias("i2"), (F.col("wx") / F.col("ws")).alias("pooled"), F.sqrt(1 / F.col("ws")).alias("se"), (F.col("wx") / F.sqrt("ws")).alias("z"))


def label_enrichment(labels: DataFrame, selected: Column, value: str, min_count: int = 3) -> DataFrame:
    """Counts k of n selected and K of N in all for each label, and the fold of their shares."""
    total = labels.agg(F.count_if(selected).alias("n"), F.count("*").alias("n_all"))
    k = labels.groupBy(value).agg(F.count_if(selected).alias("k"), F.count("*").alias("k_all")).where(F.col("k_all") >= min_count)
    fold = F.try_divide(F.col("k") * F.col("n_all"), F.col("n") * F.col("k_all"))
    return k.crossJoin(F.broadcast(total)).select(value, "k", "k_all", "n", "n_all", fold.alias("fold"))  # one row of totals


def enrichment_tests(counts: DataFrame, two_sided: bool = True) -> DataFrame:
    """Add Fisher's exact p and its q over all terms."""
    k, ka, n, na = (F.col(c) for c in ("k", "k_all", "n", "n_all"))
    p = fisher_two_sided(k, ka - k, n - k, na - ka - n + k) if two_sided else hypergeom_sf(k, ka, n, na)
    return benjamini_hochberg(counts.withColumn("p_value", p), "p_value")


def volcano_class(q: Column, fold: Column, alpha: float = 0.05, least: float = 1.5) -> Column:
    return F.when((q < alpha) & (fold >= least), "up").when((q < alpha) & (fold <= 1 / least), "down").otherwise("ns")


def _running_score(hits: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """The extreme of the running sum of each group of hits (pos, value, size): steps up by |value|, down by position."""
    w = Window.partitionBy(*by).orderBy("pos")
    mass = hits.groupBy(*by).agg(F.sum(F.abs("value")).alias("mass")).where("mass > 0")
    run = hits.join(mass, by).crossJoin(F.broadcast(n))  # one row of the gene count
    h, i = F.sum(F.abs("value")).over(w) / F.col("mass"), F.row_number().over(w)
    miss = (F.col("pos") - i) / F.greatest(F.col("n") - F.col("size"), F.lit(1))
    at = run.select(*by, "size", (h - miss).alias("up"), (h - F.abs("value") / F.col("mass") - miss).alias("down"))
    s = at.groupBy(*by, "size").agg(F.max("up").alias("hi"), F.min("down").alias("lo"))
    return s.select(*by, "size", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def _placed(ranked: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes by descending value with their place, members (term, gene, size), gene count). Genes are a list of names
    of one organism, not rows of data, so one ordering of them is small."""
    genes = keep_best(ranked.where("value is not null"))
    place = genes.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("value"), "gene")))
    members = sets.select("term", F.upper("gene").alias("gene")).distinct().join(genes.select("gene"), "gene")
    size = members.groupBy("term").agg(F.count("*").alias("size"))
    return place, members.join(size, "term"), genes.agg(F.count("*").alias("n"))


def enrichment_score(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """Running-sum enrichment score of each gene set over genes by descending value, weighted by |value|."""
    place, members, n = _placed(ranked, sets)
    return _running_score(members.join(place, "gene"), n, ["term"])


def prerank(ranked: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Enrichment scores with their null: term, size, es, nes, p_value, q_value.

    In each permutation the genes change places by the order of a seeded hash, the same one in every run and for every
    partitioning. nes is es over the mean |es| of the permutations with its sign, p_value the share of those that are as
    far out (null if none has the sign), q_value Benjamini-Hochberg over the sets. Permutations are partitions of one job.
    """
    place, members, n = _placed(ranked, sets)
    observed = _running_score(members.join(place, "gene"), n, ["term"])
    turns = place.select("gene", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("turn"))
    moved = F.row_number().over(Window.partitionBy("turn").orderBy(F.xxhash64("gene", "turn", F.lit(seed)), "gene"))
    turns = turns.withColumn("pos", moved).join(place.select("pos", "value"), "pos")
    null = _running_score(members.join(turns, "gene"), n, ["term", "turn"]).select("term", F.col("es").alias("null_es"))
    both = observed.join(null, "term", "left")
    same = F.when((F.col("es") >= 0) == (F.col("null_es") >= 0), F.abs("null_es"))
    tested = both.groupBy("term", "size", "es").agg(
        F.try_divide(F.col("es"), F.avg(same)).alias("nes"),
        F.try_divide(F.count_if(same >= F.abs("es")), F.count(same)).alias("p_value"),
    )
    return benjamini_hochberg(tested, "p_value")


def keep_best(ranked: DataFrame) -> DataFrame:
    """One value of each upper-cased gene: the highest."""
    return ranked.groupBy(F.upper("gene").alias("gene")).agg(F.max("value").alias("value"))


def activity(expr: DataFrame, net: DataFrame) -> DataFrame:
    """Univariate linear model per sample and regulator: t of the slope of expression on weights, absent weights 0."""
    totals = expr.where("value is not null").groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"))
    hit = expr.where("value is not null").join(net, "gene").groupBy("sample_id", "source").agg(
        F.sum("weight").alias("sx"), F.sum(F.col("weight") * F.col("weight")).alias("sxx"), F.sum(F.col("weight") * F.col("value")).alias("sxy")
    )
    j = hit.join(totals, "sample_id")
    n = F.col("n")
    r = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt((n * F.col("sxx") - F.pow("sx", 2)) * (n * F.col("syy") - F.pow("sy", 2))))
    j = j.withColumn("r", r)
    return j.select("sample_id", "source", (F.col("r") * F.sqrt((n - 2) / (1 - F.col("r") * F.col("r")))).alias("score"))


def signed_rank_score(stat: Column, lfc: Column, p: Column) -> Column:
    """The statistic, else sign(lfc) * -log10(p) with p clipped at 1e-300."""
    return F.coalesce(stat, F.sign(lfc) * -F.log10(F.greatest(p, F.lit(1e-300))))


def shape_class(expr: DataFrame, by: list[str]) -> DataFrame:
    """Shape of each gene's values from its moments: too few, constant, or by skewness and excess kurtosis."""
    m = expr.groupBy(*by).agg(F.count("value").alias("n"), F.stddev_pop("value").alias("sd"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    s, k = F.abs("skew"), F.col("kurt")
    c = (
        F.when(F.col("n") < 10, "Not Enough Data").when(F.col("sd") < 1e-6, "Effectively Constant").when((s < 0.5) & (F.abs(k) < 1), "Normal")
        .when((s < 0.5) & (k <= -1), "Uniform").when(s < 0.5, "Heavy-tailed").when(F.col("skew") >= 0.5, "Right-skewed").otherwise("Left-skewed")
    )
    return m.select(*by, "n", "skew", "kurt", c.alias("shape"))


def levene_p(w: DataFrame) -> DataFrame:
    return w.withColumn("p_value", f_sf("w_stat", F.lit(1.0), F.col("df").cast("double")))


def normal_p(z: DataFrame) -> DataFrame:
    return z.withColumn("p_value", normal_sf2(F.col("z")))


#: Methods of rank_by_variability; the first two statistics have a sign of their own.
VARIABILITY_METHODS = ("logvar_z", "logvar_ratio", "bf", "levene", "ks", "wasserstein")


def rank_by_variability(rows: DataFrame, method: str = "logvar_z") -> DataFrame:
    """Per gene with three values a group: var_case, var_control, mean_case, mean_control, delta_var, stat, p_value, rank.

    ``rank`` is the statistic with the sign of delta_var (+ for none), or as it is where it has one; 0 for a missing one. The p-value is null for
    wasserstein and logvar_ratio. Another method is a ValueError.
    """
    if method not in VARIABILITY_METHODS:
        raise ValueError(f"method must be one of {VARIABILITY_METHODS}, got {method!r}")
    m = group_moments(rows).where("n1 >= 3 and n0 >= 3")
    m = m.select("gene", F.col("v1").alias("var_case"), F.col("v0").alias("var_control"), F.col("m1").alias("mean_case"), F.col("m0").alias("mean_control"), (F.col("v1") - F.col("v0")).alias("delta_var"))
    if method == "logvar_z":
        s = normal_p(variability(rows)).select("gene", F.col("z").alias("stat"), "p_value")
    elif method == "logvar_ratio":
        s = variability(rows).select("gene", F.col("log_ratio").alias("stat"), F.lit(None).cast("double").alias("p_value"))
    elif method in ("bf", "levene"):
        s = levene_p(levene(rows, "median" if method == "bf" else "mean")).select("gene", F.col("w_stat").alias("stat"), "p_value")
    else:
        d = ks_p_value(distribution_distance(rows))
        s = d.select("gene", F.col("ks").alias("stat"), "p_value") if method == "ks" else d.select("gene", F.col("wasserstein").alias("stat"), F.lit(None).cast("double").alias("p_value"))
    sign = F.lit(1.0) if method in VARIABILITY_METHODS[:2] else F.when(F.col("delta_var") < 0, -1.0).otherwise(1.0)
    return m.join(s, "gene", "left").withColumn("rank", F.coalesce("stat", F.lit(0.0)) * sign)


def random_effects_tests(effects: DataFrame) -> DataFrame:
    """random_effects with two-sided normal p-values and their q over all genes."""
    return benjamini_hochberg(normal_p(random_effects(effects)), "p_value")


def combine_ranks(effects: DataFrame, method: str = "random_effects") -> DataFrame:
    """Rankings of genes by (platform, gene, log_fc, t_stat) as one: stouffer, rank_product or random_effects; another method is a ValueError."""
    if method == "stouffer":
        return normal_p(stouffer(effects.select("gene", F.col("t_stat").alias("z"))))
    if method == "rank_product":
        return rank_product(effects.select("platform", "gene", F.col("t_stat").alias("value")))
    if method == "random_effects":
        return random_effects_tests(effects)
    raise ValueError(f"no method {method!r} to combine ranks")
