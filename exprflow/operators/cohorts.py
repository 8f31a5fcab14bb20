"""Cohorts of samples: clusters of vectors, their summaries, and previews of what a filter selects."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Fits that run at once.
AT_ONCE = 4


def match_all(**fields: str | bool | float | Iterable[str] | None) -> Column:
    """True where every named column equals its value or, for several values, one of them.

    None and collections without values select everything; empty and null values in a collection count
    for nothing; a value of another kind is a TypeError.
    """
    terms = []
    for name, wanted in fields.items():
        if wanted is None:
            continue
        if isinstance(wanted, (list, tuple, set)):
            values = sorted({str(v) for v in wanted if v is not None and str(v) != ""})
            if values:
                terms.append(F.col(name).isin(values))
        elif isinstance(wanted, (bool, str, int, float)):
            terms.append(F.col(name) == F.lit(wanted))
        else:
            raise TypeError(f"no filter on {name} by a {type(wanted).__name__}")
    return reduce(Column.__and__, terms, F.lit(True))


def facet_preview(rows: DataFrame, facets: list[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of each facet: facet, value, n_rows, rank, n_unique (nulls aside).

    All facets in one pass, counted before the shuffle; ties go to the smaller value. A null is a value of its own.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])
    counted = rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n_rows"))
    unique = counted.groupBy("facet").agg(F.count("value").alias("n_unique"))
    order = Window.partitionBy("facet").orderBy(F.desc("n_rows"), F.asc_nulls_last("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).join(unique, "facet")


def cohort_summary(rows: DataFrame, cluster: str, label: str, stability: DataFrame, floor: float = 0.6) -> DataFrame:
    """Per cluster: n_samples, its most frequent label (ties to the smallest), its first three labels, and whether its
    ``bootstrap_jaccard`` in ``stability`` (cluster, bootstrap_jaccard) reaches ``floor``; false where there is none.

    Rows without a label count as samples only. Labels are counted before they meet in their cluster.
    """
    n = rows.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    firsts = n.where("label is not null").withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("label"))).where("k <= 3")
    firsts = firsts.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("label")), "; ").alias("labels"))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("n"), "label")))["label"]
    sums = n.groupBy("cluster").agg(F.sum("n").alias("n_samples"), best.alias("best"))
    joined = sums.join(firsts, "cluster", "left").join(stability.select("cluster", "bootstrap_jaccard"), "cluster", "left")
    return joined.select(
        "cluster",
        "n_samples",
        F.left(F.coalesce("best", F.lit("")), F.lit(100)).alias("representative_label"),
        F.left(F.coalesce("labels", F.lit("")), F.lit(200)).alias("sample_labels"),
        "bootstrap_jaccard",
        F.coalesce(F.col("bootstrap_jaccard") >= floor, F.lit(False)).alias("stable"),
    )


def finite_points(vectors: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(key, features) of the vectors that are neither null nor hold null, NaN or infinite components, written once."""
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return materialize(vectors.where(finite).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")), name)


def pseudo_cohorts(vectors: DataFrame, key: str, vector: str, ks: Iterable[int], seed: int = 0) -> DataFrame:
    """(key, cluster, k): k-means with the k of the best silhouette, the smallest of equals.

    Both the fits and the silhouettes run as jobs over all vectors, of which only centres reach the driver. Null vectors
    and those with null, NaN or infinite components take no part; with fewer than two different vectors all are cluster 0.
    """
    points = finite_points(vectors, key, vector, "cohort-vectors")
    best = None
    for k in sorted(set(ks)):
        if k < 2 or not _has_different(points.select("features"), k):
            continue
        placed = KMeans(k=k, seed=seed, predictionCol="cluster").fit(points).transform(points)
        score = ClusteringEvaluator(predictionCol="cluster").evaluate(placed)
        if best is None or score > best[0]:
            best = score, k, placed
    if best is None:
        return points.select(key, F.lit(0).alias("cluster"), F.lit(1).alias("k"))
    return best[2].select(key, "cluster", F.lit(best[1]).alias("k"))


def _has_different(rows: DataFrame, k: int) -> bool:
    """Whether there are ``k`` different rows: as a rule the first ones tell, else all are compared."""
    return len(set(rows.head(4 * k))) >= k or len(rows.distinct().head(k)) >= k


def stability(vectors: DataFrame, placed: DataFrame, key: str, vector: str, replicates: int = 50, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(cluster, bootstrap_jaccard) of the clusters in ``placed`` (key, cluster).

    Each replicate clusters a seeded ``share`` of the points anew, and a cluster's score is its best Jaccard similarity with a
    new cluster over the points of the replicate; scores are averaged. Overlaps are counts of cluster pairs, a few rows each.
    """
    points = finite_points(vectors, key, vector, "stability-vectors").join(placed.select(key, F.col("cluster").alias("base")), key)
    points = materialize(points, "stability-points").persist()  # read by every replicate; what is lost is read again
    k = points.select("base").distinct().count()

    def replicate(r: int) -> list[tuple]:
        u = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
        drawn = points.where(u < share)
        if k < 2 or not _has_different(drawn.select("features"), k):
            again = drawn.withColumn("again", F.lit(0))
        else:
            again = KMeans(k=k, seed=seed + r, predictionCol="again").fit(drawn.select("features")).transform(drawn)
        n = again.groupBy("base", "again").agg(F.count("*").alias("n"))
        of = lambda c: F.sum("n").over(Window.partitionBy(c))  # noqa: E731  windows over pairs of clusters, so the points are placed once
        both = n.select("base", "n", of("base").alias("n1"), of("again").alias("n2"))
        one = both.groupBy("base").agg(F.max(F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))).alias("j"))
        return [tuple(x) for x in one.collect()]  # a row a cluster

    with ThreadPoolExecutor(AT_ONCE) as pool:  # fits of small jobs overlap
        scores = [x for some in pool.map(replicate, range(replicates)) for x in some]
    points.unpersist()
    kind = dict(points.dtypes)["base"]
    found = points.sparkSession.createDataFrame(scores, f"cluster {kind}, j double")
    return found.groupBy("cluster").agg(F.avg("j").alias("bootstrap_jaccard"))


def cohort_pairs(summary: DataFrame, min_size: int = 10, floor: float = 0.6) -> DataFrame:
    """Pairs a < b of clusters with ``min_size`` samples and a stability of ``floor`` or more; one row a cluster meets another."""
    fit = summary.where((F.col("n_samples") >= min_size) & (F.col("bootstrap_jaccard") >= floor))
    a = fit.select(F.col("cluster").alias("a"), F.col("n_samples").alias("n_a"))
    return a.join(fit.select(F.col("cluster").alias("b"), F.col("n_samples").alias("n_b")), F.col("a") < F.col("b"))


def principal_components(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, scores): the first ``k`` principal components of standardised vectors; constant dimensions count as 0.

    Means, deviations and the covariance are sums over all vectors; only dimensions by dimensions reach the driver. Vectors with
    null or non-finite components take no part; with fewer than three vectors there is no result.
    """
    points = finite_points(vectors, key, vector, "pca-vectors")
    if len(points.head(3)) < 3:
        return points.limit(0).select(key, F.array(F.lit(0.0)).alias("scores"))
    scaled = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(points).transform(points)
    return PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled).select(key, vector_to_array("pc").alias("scores"))
