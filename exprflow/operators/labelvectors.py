"""Vectors of label texts: TF-IDF of character n-grams within words, in long form and as sparse points, and cohorts of labels.

Only distinct labels travel, with the number of samples that bear them.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize, scratch_path

#: Shortest and longest n-gram, fewest and most places of a point, and fits that run at once.
SHORTEST, LONGEST, FEWEST, MOST, AT_ONCE = 3, 5, 1 << 10, 1 << 18, 4
#: Starts of the clustering of all samples, and of a replicate.
STARTS, STARTS_AGAIN = 10, 5


def word_ngrams(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """All runs of ``shortest`` to ``longest`` characters of each word between two blanks, in lower case; a word too short for one is taken whole."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(padded)
        sizes = F.sequence(F.least(F.lit(shortest), n), F.least(F.lit(longest), n))
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(padded, i, k))))

    return F.flatten(F.transform(words, of_word))


def label_vectors(rows: DataFrame, label: str) -> DataFrame:
    """(label, n_samples, term, weight): counts of n-grams times ln((1 + n) / (1 + df)) + 1, of length 1 for each distinct label.

    n and df count samples, not labels. Labels are trimmed; null and blank ones take no part.
    """
    text = F.trim(F.col(f"`{label}`").cast("string"))
    labels = materialize(rows.select(text.alias("label")).where(F.length("label") > 0).groupBy("label").agg(F.count("*").alias("n_samples")), "label-texts")
    terms = labels.select("label", "n_samples", F.explode(word_ngrams(F.col("label"))).alias("term")).groupBy("label", "n_samples", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.sum("n_samples").alias("df"))
    total = labels.agg(F.sum("n_samples").alias("n"))
    raw = terms.join(df, "term").crossJoin(F.broadcast(total))  # one row
    raw = raw.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("label")))  # as many rows as a label has n-grams
    return raw.select("label", "n_samples", "term", (F.col("w") / length).alias("weight"))


def sparse_points(vectors: DataFrame, keys: list[str], places: int | None = None) -> DataFrame:
    """``keys`` and ``features``, a sparse vector with each term at the place its hash names; terms that share one are added.

    Without ``places`` there are 16 for each distinct term, as a power of two from FEWEST to MOST, which bounds the centres of a clustering. The vectors are built as the fields that they are stored in, written, and read as vectors: no row leaves the JVM.
    """
    if places is None:
        n = vectors.agg(F.approx_count_distinct("term")).head()[0]
        places = min(MOST, max(FEWEST, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("term"), F.lit(places)).cast("int")
    merged = vectors.groupBy(*keys, place.alias("place")).agg(F.sum("weight").alias("weight"))
    pairs = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("pairs"))  # as many as a label has n-grams
    point = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(places).alias("size"), F.transform("pairs", lambda p: p["place"]).alias("indices"),
        F.transform("pairs", lambda p: p["weight"]).alias("values"),
    )
    rows = pairs.select(*keys, point.alias("features"))
    path = scratch_path(rows.sparkSession, "label-points")
    rows.write.parquet(path)
    kept = [f for f in rows.schema.fields if f.name != "features"]
    out = rows.sparkSession.read.schema(T.StructType([*kept, T.StructField("features", VectorUDT())])).parquet(path)
    out._scratch = path
    return out


def _clusters(points: DataFrame, k: int, seed: int, starts: int):
    """The fit of the least cost from several starts; ``points`` have features and weight."""
    fit = lambda s: KMeans(k=k, seed=seed + s, predictionCol="cluster", weightCol="weight").fit(points)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return min(pool.map(fit, range(starts)), key=lambda m: m.summary.trainingCost)


def label_cohorts(rows: DataFrame, key: str, label: str, ks: Iterable[int] = range(2, 9), seed: int = 0, starts: int = STARTS) -> DataFrame:
    """(key, label, cluster, k): samples by k-means of their labels' vectors, with the k of the best silhouette, the smallest of equals.

    Labels weigh as many samples as bear them. Samples with a null or blank label are left out; with one distinct label all are cluster 0.
    """
    samples = rows.select(key, F.trim(F.col(f"`{label}`").cast("string")).alias("label")).where(F.length("label") > 0)
    points = sparse_points(label_vectors(rows, label), ["label", "n_samples"]).withColumn("weight", F.col("n_samples").cast("double"))
    points = points.persist()  # what is lost of it is read again
    n, best = points.count(), None
    for k in sorted(set(ks)):
        if k < 2 or k >= n:
            continue
        placed = _clusters(points, k, seed, starts).transform(points)
        score = ClusteringEvaluator(predictionCol="cluster", weightCol="weight").evaluate(placed)
        if best is None or score > best[0]:
            best = score, k, placed
    if best is None:
        return samples.withColumns({"cluster": F.lit(0), "k": F.lit(1)})
    return samples.join(best[2].select("label", "cluster"), "label").select(key, "label", "cluster", F.lit(best[1]).alias("k"))


def cohort_stability(cohorts: DataFrame, key: str, replicates: int = 50, share: float = 0.8, seed: int = 0, starts: int = STARTS_AGAIN) -> DataFrame:
    """(cluster, bootstrap_jaccard) of ``label_cohorts``: each replicate clusters a seeded ``share`` of the samples anew; a cluster's score is its best
    Jaccard similarity with a new cluster over those samples, averaged.

    The draws of all replicates are counted in one pass, a row for each label with an array of counts; fits run a few at a time on
    a table written once. Replicates with fewer labels than clusters are left out, as are clusters without a drawn sample.
    """
    labels = label_vectors(cohorts, "label")
    u = [F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(r)), F.lit(1 << 20)) / float(1 << 20) < share for r in range(replicates)]
    drawn = cohorts.groupBy("label", "cluster").agg(F.array(*[F.count_if(c) for c in u]).alias("drawn"))
    points = sparse_points(labels, ["label"]).join(drawn, "label")
    points = materialize(points.withColumnRenamed("cluster", "base"), "stability-labels").persist()
    k = points.select("base").distinct().count()

    def replicate(r: int) -> dict[int, float]:
        own = points.withColumn("weight", F.col("drawn")[r].cast("double")).where("weight > 0")
        if k < 2 or len(own.select("label").head(k)) < k:
            return {}
        n = _clusters(own, k, seed + r, starts).transform(own).groupBy("base", "cluster").agg(F.sum("weight").alias("n")).collect()  # clusters by clusters
        a, b, best = {}, {}, {}
        for row in n:
            a[row.base] = a.get(row.base, 0) + row.n
            b[row.cluster] = b.get(row.cluster, 0) + row.n
        for row in n:
            best[row.base] = max(best.get(row.base, 0.0), row.n / (a[row.base] + b[row.cluster] - row.n))
        return best

    with ThreadPoolExecutor(AT_ONCE) as pool:
        scores = list(pool.map(replicate, range(replicates)))
    points.unpersist()
    rows = [(int(c), float(j)) for s in scores for c, j in s.items()]
    found = cohorts.sparkSession.createDataFrame(rows, "cluster int, j double").groupBy("cluster").agg(F.avg("j").alias("bootstrap_jaccard"))
    out = materialize(found, "stability-scores")
    discard(points)
    return out
