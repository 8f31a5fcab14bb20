"""Embeddings of cells and samples: a truncated SVD of sparse long rows, and Harmony's removal of batches from given coordinates.

Both loop on the driver over sums that Spark makes in one pass; what comes back is genes by components, or clusters by batches by dimensions, never
a row of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Components beyond those wanted, power steps, and most genes times components that are broadcast (in doubles).
EXTRA, STEPS, MOST_NUMBERS = 10, 4, 50_000_000
#: Fixed value: counts that reach this are put on a log scale.
COUNTS_FROM = 50.0


def _sparse(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gene, value) of the entries of some cells."""
    n = [len(g) for g in pdf["g"]]
    flat = lambda c: np.concatenate(pdf[c].to_numpy()) if sum(n) else np.zeros(0)
    return np.repeat(np.arange(len(n)), n), flat("g").astype(np.int64), flat("v").astype(float)


def _times(row: np.ndarray, gene: np.ndarray, value: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Rows of the product of sparse cells and ``w``."""
    out = np.zeros((n, w.shape[1]))
    for a in range(0, len(row), 200_000):
        part = slice(a, a + 200_000)
        np.add.at(out, row[part], value[part, None] * w[gene[part]])
    return out


@dataclass
class Decomposition:
    """Coordinates (key, scores) of every cell, singular values, and the genes' components (gene, loadings)."""

    scores: DataFrame
    singular: np.ndarray
    loadings: DataFrame


def truncated_svd(rows: DataFrame, key: str, gene: str, value: str, k: int = 30, log_counts: bool = True, seed: int = 0, steps: int = STEPS) -> Decomposition:
    """The ``k`` largest singular values of cells by genes, from long rows in which absent pairs are 0; nothing is centred.

    Values without a negative one that exceed COUNTS_FROM are taken as log(1 + value). Subspace iteration from a seeded start: each step is one pass that adds up
    genes by components; the start of ``k`` + EXTRA columns and as many genes have to fit into MOST_NUMBERS. Nulls and zeros take no part, cells
    without an entry have no row, pairs that repeat are added. Signs are fixed by the largest loading of each component.
    """
    spark = rows.sparkSession
    entries = rows.where(F.col(value).isNotNull() & (F.col(value) != 0) & ~F.isnan(F.col(value).cast("double")) & F.col(key).isNotNull() & F.col(gene).isNotNull())
    entries = entries.groupBy(F.col(key).alias("c"), F.col(gene).cast("string").alias("gene")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    entries = materialize(entries, "svd-entries")
    low, high = entries.agg(F.min("v"), F.max("v")).head()
    genes = entries.groupBy("gene").agg(F.count("*").alias("n"))
    n_genes = genes.count()
    k = max(0, min(k, n_genes))
    width = min(n_genes, k + EXTRA)
    if n_genes * max(width, 1) > MOST_NUMBERS:
        raise ValueError(f"{n_genes} genes by {width} components are more than {MOST_NUMBERS} numbers")
    numbered = materialize(genes.withColumn("g", F.row_number().over(Window.orderBy("gene")) - 1).select("gene", "g"), "svd-genes")  # bounded by the check above
    if not k:
        return Decomposition(entries.select(F.col("c").alias(key), F.array().cast("array<double>").alias("scores")).limit(0), np.zeros(0), numbered.select("gene", F.array().cast("array<double>").alias("loadings")))
    v = F.log1p("v") if log_counts and low >= 0 and high > COUNTS_FROM else F.col("v")
    cells = entries.join(F.broadcast(numbered), "gene").groupBy("c").agg(F.collect_list("g").alias("g"), F.collect_list(v).alias("v"))  # a cell has as many entries as there are genes
    cells = materialize(cells, "svd-cells")

    def summed(w: np.ndarray) -> np.ndarray:
        """X'X w by one pass."""
        held = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(held.value)
            for pdf in batches:
                row, g, x = _sparse(pdf)
                y = _times(row, g, x, held.value, len(pdf))
                for a in range(0, len(row), 200_000):
                    part = slice(a, a + 200_000)
                    np.add.at(total, g[part], x[part, None] * y[row[part]])
            some = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"g": some, "z": list(total[some])})

        parts = cells.select("g", "v").mapInPandas(run, "g int, z array<double>").select("g", F.posexplode("z"))
        added = parts.groupBy("g", "pos").agg(F.sum("col").alias("z")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("z")).select("g", "z.z").toPandas()
        held.unpersist()
        out = np.zeros_like(w)
        if len(added):
            out[added["g"].to_numpy()] = np.stack(added["z"].to_numpy())
        return out

    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_genes, width)))[0]
    for _ in range(steps):
        w = np.linalg.qr(summed(w))[0]
    z = summed(w)
    squares, turn = np.linalg.eigh((w.T @ z + z.T @ w) / 2)
    order = np.argsort(-squares)[:k]
    w = w @ turn[:, order]
    w *= np.sign(w[np.abs(w).argmax(0), np.arange(k)])
    held = spark.sparkContext.broadcast(w)
    kind = dict(cells.dtypes)["c"]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, g, x = _sparse(pdf)
            yield pd.DataFrame({"c": pdf["c"], "scores": list(_times(row, g, x, held.value, len(pdf)))})

    scores = cells.mapInPandas(project, f"c {kind}, scores array<double>").select(F.col("c").alias(key), "scores")
    names = [r.gene for r in numbered.orderBy("g").collect()]
    loadings = spark.createDataFrame(pd.DataFrame({"gene": names, "loadings": [list(map(float, r)) for r in w]}), "gene string, loadings array<double>")
    return Decomposition(scores, np.sqrt(np.maximum(0, squares[order])), loadings)


#: Weight of diversity, softness of clusters, ridge, clusters at most and samples for each, rounds, rounds of clustering in each, gain that stops.
THETA, SIGMA, RIDGE, CLUSTERS, PER_CLUSTER, ROUNDS, INNER, GAIN = 2.0, 0.1, 1.0, 100, 30, 10, 5, 1e-4


def soft_clusters(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Shares of each sample in each cluster: near centres by cosine, and clusters that lack its batch."""
    cosine = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    log = -2 / SIGMA * (1 - cosine @ centres.T) + penalty[:, batch].T
    log -= log.max(1, keepdims=True)
    share = np.exp(log)
    return share / share.sum(1, keepdims=True)


def corrected(z: np.ndarray, batch: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coordinates after the rounds so far: centres, penalties and what each cluster takes from a batch. Each starts from the original ones."""
    now = z
    for centres, penalty, effect in rounds:
        share = soft_clusters(now, batch, centres, penalty)
        now = z - np.einsum("nk,nkd->nd", share, effect[:, batch].transpose(1, 0, 2))
    return now


def ridge_effects(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Effect of each batch in each cluster (clusters x batches x dimensions) by a ridge fit with a free intercept; ``counts`` and ``sums`` hold the shares
    and the weighted coordinates of clusters by batches."""
    n_clusters, n_batches, d = sums.shape
    out = np.zeros((n_clusters, n_batches, d))
    for k in range(n_clusters):
        left = np.zeros((n_batches + 1, n_batches + 1))
        left[0, 0], left[0, 1:], left[1:, 0] = counts[k].sum(), counts[k], counts[k]
        left[1:, 1:] = np.diag(counts[k] + RIDGE)
        if left[0, 0] > 1e-9:
            out[k] = np.linalg.solve(left, np.vstack((sums[k].sum(0), sums[k])))[1:]
    return out


def penalties(counts: np.ndarray, theta: float = THETA) -> np.ndarray:
    """Log of the weight of each batch in each cluster: expected over observed shares to the power ``theta``."""
    expected = counts.sum(1, keepdims=True) * counts.sum(0) / counts.sum()
    return theta * np.log((expected + 1) / (counts + 1))


def first_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit centres of k-means on the cosine from a bounded sample: farthest-first starts, ten rounds."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    at = [int(np.argmax((x - x.mean(0)) @ (x[0] - x.mean(0)) + (x**2).sum(1)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    centres = x[at]
    for _ in range(10):
        own = (x @ centres.T).argmax(1)
        moved = np.stack([x[own == i].sum(0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centres


def harmony(rows: DataFrame, key: str, vector: str, batch: str, clusters: int | None = None, theta: float = THETA, rounds: int = ROUNDS, sample_rows: int = 5000) -> DataFrame:
    """(key, batch, corrected): coordinates in which the batches of each soft cluster lie over each other.

    Rounds of soft clustering with a penalty on clusters of one batch, then a ridge fit of the batches in each cluster, taken from the original coordinates; they
    stop when the correction settles. A task computes all shares anew from the rounds' centres, so nothing is kept for a sample, and only sums of
    clusters by batches by dimensions reach the driver. First centres come from ``sample_rows`` rows chosen by hash. Null batches are a batch; vectors that are
    null or hold null or non-finite components take no part.
    """
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    live = rows.where(finite).select(F.col(key).alias("id"), F.col(batch).cast("string").alias("batch"), F.transform(vector, lambda v: v.cast("double")).alias("z"))
    names = [r.batch for r in live.groupBy("batch").agg(F.count("*")).select("batch").orderBy("batch").collect()]  # as many as there are batches
    place = F.coalesce(*[F.when(F.col("batch").eqNullSafe(F.lit(b)), F.lit(i)) for i, b in enumerate(names)]) if names else F.lit(0)
    points = materialize(live.withColumn("b", place), "harmony-points")
    kind = dict(points.dtypes)["id"]
    n = points.count()
    out = f"id {kind}, batch string, corrected array<double>"
    back = lambda df: df.select(F.col("id").alias(key), F.col("batch").alias(batch), "corrected")
    if n == 0 or len(names) < 2:
        return back(points.select("id", "batch", F.col("z").alias("corrected")))
    k = clusters or max(1, min(round(n / PER_CLUSTER), CLUSTERS))
    sample = np.stack([np.asarray(r.z) for r in points.select("z").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample_rows).collect()])
    centres = first_centres(sample, k)
    k, d, n_batches = len(centres), sample.shape[1], len(names)

    def sums(done: list, centres: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of clusters by batches: shares, weighted original coordinates, weighted directions of the present ones."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, n_batches, 1 + 2 * d))
            for pdf in batches:
                if len(pdf):
                    z, b = np.stack(pdf["z"].to_numpy()), pdf["b"].to_numpy()
                    now = corrected(z, b, done)
                    share = soft_clusters(now, b, centres, penalty)
                    unit = now / np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12)
                    held = np.column_stack((np.ones(len(z)), z, unit))
                    for i in range(n_batches):
                        own = b == i
                        total[:, i] += share[own].T @ held[own]
            yield pd.DataFrame({"k": np.repeat(np.arange(k), n_batches), "b": np.tile(np.arange(n_batches), k), "s": list(total.reshape(-1, 1 + 2 * d))})

        parts = points.select("z", "b").mapInPandas(run, "k int, b int, s array<double>").select("k", "b", F.posexplode("s"))
        pdf = parts.groupBy("k", "b", "pos").agg(F.sum("col").alias("s")).toPandas()
        total = np.zeros((k, n_batches, 1 + 2 * d))
        total[pdf["k"], pdf["b"], pdf["pos"]] = pdf["s"]
        return total[..., 0], total[..., 1 : 1 + d], total[..., 1 + d :]

    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    penalty, last = np.zeros((k, n_batches)), None
    for _ in range(rounds):
        for _ in range(INNER):
            counts, _, units = sums(done, centres, penalty)
            penalty = penalties(counts, theta)
            moved = units.sum(1)
            centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        counts, coordinates, _ = sums(done, centres, penalty)
        effect = ridge_effects(counts, coordinates)
        done.append((centres, penalty, effect))
        size = np.sqrt((effect**2).sum())
        if last is not None and abs(size - last) <= GAIN * max(last, 1e-12):
            break
        last = size

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "batch": pdf["batch"], "corrected": list(corrected(np.stack(pdf["z"].to_numpy()), pdf["b"].to_numpy(), done))})

    return back(points.mapInPandas(finish, out))
