"""Distribution classes of genes, from moments and a fine histogram of each: no gene's values meet in one task.

A gene with up to ``BINS`` values is a table of its distinct values with their counts; the values of others are counted in ``BINS`` bins of the gene's range, each kept with the
mean of what fell into it. This bounded table, whatever the number of samples, gives the density and the likelihoods. Bins of a range say little of heavy tails, so the dip test and
the mixtures see the distinct values or, of a gene with more than ``BINS``, its quantiles at as many equal steps, from a mergeable sketch that only such genes need.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dip
from ..session import materialize

BINS, GRID, SKETCH = 2048, 512, 20_000
#: Least numbers and limits of the classes, in the order of the rules.
LEAST_N, CONSTANT_SD, DIP_P, PROMINENCE, VALLEY, PAD = 20, 1e-6, 0.05, 0.15, 0.75, 0.10
MODAL = ("Bimodal", "Multimodal")
#: A gene's figures, in the order they travel in, and the counts that mark the rows of figures and of quantiles.
FIGURES, FIGURES_ROW, MARKS_ROW = ("n", "low", "high", "mean", "sd", "mean_log", "sd_log"), -1, -2


def peaks(y: np.ndarray, prominence: float) -> np.ndarray:
    """Inner maxima that stand out from the higher of the valleys on their sides by at least ``prominence``."""
    out = []
    for i in np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1:
        higher_left, higher_right = np.flatnonzero(y[:i] > y[i]), np.flatnonzero(y[i + 1 :] > y[i])
        left = y[higher_left[-1] if len(higher_left) else 0 : i + 1].min()
        right = y[i : i + 2 + higher_right[0] if len(higher_right) else len(y)].min()
        if y[i] - max(left, right) >= prominence:
            out.append(i)
    return np.array(out, int)


def _digamma(x: float) -> float:
    total = 0.0
    while x < 6:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _gamma_shape(gap: float) -> float:
    """The shape k with log k - digamma(k) = gap, by bisection on a logarithmic scale."""
    lo, hi = -12.0, 16.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid - _digamma(math.exp(mid)) > gap else (lo, mid)
    return math.exp((lo + hi) / 2)


def _cauchy(x: np.ndarray, n: np.ndarray) -> float:
    """The largest log-likelihood of a Cauchy distribution, by reweighting."""
    total = n.sum()
    order = np.argsort(x)
    q = np.interp(np.array([0.25, 0.5, 0.75]) * total, np.cumsum(n[order]), x[order])
    m, s = q[1], max((q[2] - q[0]) / 2, 1e-9)
    for _ in range(300):
        was = m, s
        w = 2 / (1 + ((x - m) / s) ** 2) * n
        m = (w @ x) / w.sum()
        s = max(math.sqrt((w @ (x - m) ** 2) / total), 1e-12)
        if abs(m - was[0]) + abs(s - was[1]) <= 1e-13 * s:  # settled
            break
    return float(-(n * np.log(math.pi * s * (1 + ((x - m) / s) ** 2))).sum())


def _likeliest(x: np.ndarray, c: np.ndarray, s: dict) -> str:
    n = float(s["n"])
    scores = {"Normal": -n / 2 * (math.log(2 * math.pi * s["sd"] ** 2) + 1)}
    if s["low"] > 0:
        scores["Lognormal"] = -n * s["mean_log"] - n / 2 * (math.log(2 * math.pi * max(s["sd_log"], 1e-12) ** 2) + 1)
        k = _gamma_shape(max(math.log(s["mean"]) - s["mean_log"], 1e-12))
        scores["Gamma"] = (k - 1) * n * s["mean_log"] - n * k - n * k * math.log(s["mean"] / k) - n * math.lgamma(k)
    scores["Cauchy"] = _cauchy(x, c)
    scores["Uniform"] = -n * math.log(s["high"] - s["low"])
    return max(scores, key=scores.get)


def uniform_dips(spark: SparkSession, sizes: tuple[int, ...] = dip.NULL_SIZES, draws: int = dip.NULL_DRAWS) -> dict[int, np.ndarray]:
    """Sorted sqrt(n) times the dips of seeded uniform samples by size: the null of dip_p_value, the same in each session.

    Drawn by one Spark job of ``len(sizes) * draws`` rows, once for each driver; no data take part.
    """
    if (sizes, draws) not in _NULLS:
        rows = spark.range(0, draws, numPartitions=max(1, min(draws, spark.sparkContext.defaultParallelism)))

        def run(batches):
            for b in batches:
                yield pd.DataFrame([(n, dip.null_dips(n, int(i))) for i in b["id"] for n in sizes], columns=["n", "dip"])

        drawn = rows.mapInPandas(run, "n int, dip double").toPandas()
        _NULLS[sizes, draws] = {n: np.sort(drawn.loc[drawn["n"] == n, "dip"].to_numpy()) for n in sizes}
    return _NULLS[sizes, draws]


_NULLS: dict[tuple, dict[int, np.ndarray]] = {}


def _binned(v: np.ndarray, w: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the bins of the range that distinct values ``v`` with counts ``w`` fall into."""
    at = np.floor((v - low) / (high - low) * BINS).astype(int)
    at -= at.min()
    c = np.bincount(at, w)
    held = c > 0
    return np.bincount(at, w * v)[held] / c[held], c[held]


def _classify(v: np.ndarray, w: np.ndarray, s: dict, knots: np.ndarray | None, nulls: dict[int, np.ndarray] | None) -> str:
    """The class of a gene from its distinct values or bins ``v`` with counts ``w``, its figures ``s``, and its quantiles if it has more than ``BINS`` values."""
    if s["n"] < LEAST_N:
        return "Not Enough Data"
    if s["sd"] < CONSTANT_SD:
        return "Effectively Constant"
    n, span = float(s["n"]), s["high"] - s["low"]
    x, c = _binned(v, w, s["low"], s["high"]) if n <= BINS else (v, w)
    if nulls:
        if n <= BINS:
            depth = dip.dip(v, w, n)
        else:
            v, w = (knots[1:] + knots[:-1]) / 2, np.full(len(knots) - 1, n / (len(knots) - 1))
            depth = max(1 / (2 * n), dip.knot_dip(knots, n) - (1 / SKETCH if n > SKETCH else 0.0))  # what the sketch may be off
        if dip.dip_p_value(depth, n, nulls) < DIP_P:
            return "Multimodal" if dip.n_components(v, w) >= 3 else "Bimodal"
    width = n ** (-1 / 5) * s["sd"] * math.sqrt(n / (n - 1))  # Scott's rule
    grid = np.linspace(s["low"] - PAD * span, s["high"] + PAD * span, GRID)
    off = (grid[:, None] - x) / width
    off *= off
    off *= -0.5
    density = np.exp(off, out=off) @ c
    at = peaks(density, PROMINENCE * density.max())
    if len(at) >= 3:
        return "Multimodal"
    if len(at) == 2 and density[at[0] : at[1] + 1].min() < VALLEY * density[at].min():
        return "Bimodal"
    return _likeliest(x, c, s)


def distribution_classes(expr: DataFrame, genes: Iterable[str] | None = None, dip_test: bool = True) -> DataFrame:
    """(gene, n, distribution) of the finite values of each gene, or of the named ``genes`` in any case.

    Fewer than 20 values: Not Enough Data; a deviation below 1e-6: Effectively Constant; where the dip test rejects one mode (p below 0.05), Bimodal or,
    if three or four normals fit better than two by BIC, Multimodal; two or more modes of the density: Bimodal with a deep valley between two,
    Multimodal from three; else the likeliest of Normal, Lognormal, Gamma, Cauchy, Uniform. Genes without a value have no row. Without
    ``dip_test`` the density decides alone.
    """
    if genes is not None:  # as many as a caller names
        expr = expr.where(F.upper("gene").isin([str(g).upper() for g in genes]))
    nulls = uniform_dips(expr.sparkSession) if dip_test else None
    live = F.col("gene").isNotNull() & F.col("value").isNotNull() & (F.abs("value") < float("inf"))
    rows = expr.where(live).select("gene", F.col("value").cast("double").alias("value"))
    log = F.when(F.col("value") > 0, F.log("value"))
    stats = rows.groupBy("gene").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"), F.avg(log).alias("mean_log"), F.stddev_pop(log).alias("sd_log"),
    )
    stats = materialize(stats, "distribution-figures")  # a row a gene
    placed = rows.join(stats.select("gene", "low", "high", (F.col("n") <= BINS).alias("exact")), "gene")
    bin_ = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * BINS), F.lit(0)).cast("double")
    table = placed.groupBy("gene", "exact", F.when(F.col("exact"), F.col("value")).otherwise(bin_).alias("at")).agg(F.count("*").alias("c"), F.avg("value").alias("mean"))
    table = table.select("gene", F.when(F.col("exact"), F.col("at")).otherwise(F.col("mean")).alias("x"), "c", F.lit(None).cast("array<double>").alias("told"))

    def beside(told: DataFrame, kind: int) -> DataFrame:
        return told.select("gene", F.lit(0.0).alias("x"), F.lit(kind).cast("long").alias("c"), "told")

    parts = table.unionByName(beside(stats.select("gene", F.array(*[F.col(k).cast("double") for k in FIGURES]).alias("told")), FIGURES_ROW))
    if dip_test and not stats.where(F.col("n") > BINS).isEmpty():
        sketch = F.percentile_approx("value", [i / BINS for i in range(BINS + 1)], SKETCH).alias("told")
        parts = parts.unionByName(beside(placed.where("not exact").groupBy("gene").agg(sketch), MARKS_ROW))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for genes_ in _whole_genes(batches):
            yield pd.DataFrame([_of_gene(g, x, c, told, nulls) for g, x, c, told in genes_], columns=["gene", "n", "distribution"])

    # a table of at most BINS + 2 rows a gene, in order of genes: a batch holds many
    return parts.repartition("gene").sortWithinPartitions("gene").mapInPandas(run, "gene string, n long, distribution string")


def _whole_genes(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The columns of each gene of batches in order of genes, whose last gene may go on in the next batch."""
    left: list[tuple] = []
    for b in batches:
        if not len(b):
            continue
        gene, columns = b["gene"].to_numpy(), [b[k].to_numpy() for k in ("x", "c", "told")]
        cuts = [0, *(np.flatnonzero(gene[1:] != gene[:-1]) + 1).tolist(), len(gene)]
        found = [(gene[i], *[k[i:j] for k in columns]) for i, j in zip(cuts, cuts[1:], strict=False)]
        if left and left[0][0] != found[0][0]:
            yield [_joined(left)]
            left = []
        if len(found) > 1:
            yield [_joined([*left, found[0]]), *found[1:-1]]
            left = []
        left.append(found[-1])
    if left:
        yield [_joined(left)]


def _joined(pieces: list[tuple]) -> tuple:
    return pieces[0] if len(pieces) == 1 else (pieces[0][0], *[np.concatenate(k) for k in list(zip(*pieces, strict=True))[1:]])


def _of_gene(gene: str, x: np.ndarray, c: np.ndarray, told: np.ndarray, nulls: dict[int, np.ndarray] | None) -> tuple[str, int, str]:
    s = dict(zip(FIGURES, told[c == FIGURES_ROW][0].tolist(), strict=True))
    knots = told[c == MARKS_ROW]
    held = c > 0
    return gene, int(s["n"]), _classify(x[held].astype(float), c[held].astype(float), s, np.asarray(knots[0], float) if len(knots) else None, nulls)


def distribution_summary(classes: DataFrame) -> DataFrame:
    """(distribution, n_genes, fraction) of the classes of genes."""
    counts = classes.groupBy("distribution").agg(F.count("*").alias("n_genes"))
    total = counts.agg(F.sum("n_genes").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("distribution", "n_genes", (F.col("n_genes") / F.col("total")).alias("fraction"))  # one row of totals


def keep_distributions(ranked: DataFrame, classes: DataFrame, keep: tuple[str, ...] = MODAL) -> DataFrame:
    """The rows of ``ranked`` whose gene has one of the classes; genes and classes match in any case, unknown genes go."""
    wanted = classes.where(F.lower("distribution").isin([k.lower() for k in keep])).select(F.upper("gene").alias("_gene")).distinct()
    return ranked.join(wanted, F.upper(ranked["gene"]) == F.col("_gene"), "left_semi")
