"""Density clusters, truncated SVD and batch removal against brute force and NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from exprflow.operators import embeddings as em
from exprflow.operators import grids

RNG = np.random.default_rng(6)


def plain_dbscan(ids, x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in np.argsort(ids):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = number
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = number
                        todo.append(j)
            number += 1
    for i in np.flatnonzero(~core):
        best = [j for j in np.flatnonzero(near[i] & core)]
        if best:
            label[i] = label[min(best, key=lambda j: (((x[i] - x[j]) ** 2).sum(), ids[j]))]
    return {int(i): (int(c), bool(k)) for i, c, k in zip(ids, label, core, strict=True)}


@pytest.mark.parametrize(("d", "spread", "least"), [(2, 2.5, 4), (1, 3.0, 3), (3, 1.0, 5)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, d, spread, least):
    monkeypatch.setattr(grids, "BLOCK", 40)
    x = np.concatenate([RNG.normal(6 * c, spread, (60, d)) for c in range(3)] + [np.zeros((70, d)), RNG.uniform(-20, 30, (40, d))])
    ids = RNG.permutation(len(x) * 3)[: len(x)] - 50
    rows = [(int(i), [float(a) for a in v], "x") for i, v in zip(ids, x, strict=True)] + [(10**6, None, "x"), (10**6 + 1, [float("nan")] * d, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, cell string").repartition(3)
    got = {r.id: (r.cluster, r.is_core) for r in grids.dbscan(df, "id", "v", 0.8, least).collect()}
    want = plain_dbscan(ids, x, 0.8, least)
    assert got == want and len({c for c, _ in want.values()}) > 1


def test_density_clusters_of_few_points(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in grids.dbscan(df, "id", "v", 0.8, 1).collect()] == [(1, 0, True)]
    assert grids.dbscan(df.limit(0), "id", "v", 0.8, 3).count() == 0
    with pytest.raises(ValueError):
        grids.dbscan(spark.createDataFrame([(1, [0.0] * 9)], "id long, v array<double>"), "id", "v", 0.8, 2)


def test_a_chain_is_one_component(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    links = spark.range(299).selectExpr("id + 1 as a", "id as b").where("a <> 150")
    assert {r.root for r in grids.connected(nodes, links).collect()} == {0, 150}


def test_singular_values_and_subspace_equal_numpy(spark):
    x = RNG.poisson(1.0, (120, 40)) * RNG.integers(1, 40, (120, 1)) * (RNG.random((120, 40)) < 0.3)
    x[:40, :10] += 60
    rows = [(i, f"g{j:02d}", float(x[i, j]), 0) for i in range(120) for j in range(40) if x[i, j]]
    rows += [(0, "g00", None, 0), (None, "g01", 5.0, 0), (200, "g03", 0.0, 0)]
    df = spark.createDataFrame(rows, "cell long, gene string, value double, c int").repartition(5)
    got = em.truncated_svd(df, "cell", "gene", "value", k=5, steps=12)
    logged = np.log1p(x)
    u, s, v = np.linalg.svd(logged, full_matrices=False)
    assert np.allclose(got.singular, s[:5], rtol=1e-4)
    scores = {r.cell: np.array(r.scores) for r in got.scores.collect()}
    full = np.stack([scores.get(i, np.zeros(5)) for i in range(120)])
    assert set(scores) == {i for i in range(120) if x[i].any()}
    assert np.linalg.norm(full[:, :3] @ np.linalg.pinv(full[:, :3]) - u[:, :3] @ u[:, :3].T) < 1e-2
    loadings = np.stack([r.loadings for r in got.loadings.orderBy("gene").collect()])
    assert np.allclose(np.abs(loadings[:, 0]), np.abs(v[0]), atol=1e-3) and np.allclose(full, logged @ loadings)
    assert em.truncated_svd(df.limit(0), "cell", "gene", "value").scores.count() == 0
    with pytest.raises(ValueError, match="numbers"):
        em.MOST_NUMBERS, kept = 10, em.MOST_NUMBERS
        try:
            em.truncated_svd(df, "cell", "gene", "value", k=5)
        finally:
            em.MOST_NUMBERS = kept


def plain_harmony(z, b, centres, rounds):
    k, n_batches, now = len(centres), b.max() + 1, z
    penalty, done, last = np.zeros((k, n_batches)), [], None
    one = np.eye(n_batches)[b]
    for _ in range(rounds):
        for _ in range(em.INNER):
            share = em.soft_clusters(now, b, centres, penalty)
            counts = share.T @ one
            expected = np.outer(counts.sum(1), one.sum(0)) / len(z)
            penalty = em.THETA * np.log((expected + 1) / (counts + 1))
            centres = share.T @ (now / np.linalg.norm(now, axis=1, keepdims=True))
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        share = em.soft_clusters(now, b, centres, penalty)
        design = np.column_stack((np.ones(len(z)), one))
        now, size = z.copy(), 0.0
        for c in range(k):
            weighted = design.T * share[:, c]
            w = np.linalg.solve(weighted @ design + np.diag([0.0] + [em.RIDGE] * n_batches), weighted @ z)
            w[0] = 0
            now -= share[:, c, None] * (design @ w)
            size += (w**2).sum()
        size = np.sqrt(size)
        if last is not None and abs(size - last) <= em.GAIN * last:
            break
        last = size
    return now


def test_batches_go_and_biology_stays(spark):
    n, kind, b = 300, np.arange(300) % 3, (np.arange(300) // 3) % 2
    z = 6 * np.eye(4)[kind] + RNG.normal(0, 0.3, (n, 4)) + b[:, None] * np.array([0.0, 0.0, 1.0, 3.0])
    rows = [(i, [float(v) for v in z[i]], "RNAseq" if b[i] else "GPL570", "x") for i in range(n)] + [(999, None, "GPL570", "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, batch string, b string").repartition(4)
    got = np.stack([r.corrected for r in em.harmony(df, "id", "v", "batch", clusters=3, rounds=4).orderBy("id").collect()])
    sample = np.stack([r.v for r in df.where("v is not null").selectExpr("v", "xxhash64(id, 1) as h", "id").orderBy("h", "id").collect()])
    assert np.allclose(got, plain_harmony(z, b, em.first_centres(sample, 3), 4), atol=1e-6)
    gap = lambda x: np.mean([np.linalg.norm(x[(kind == k) & (b == 0)].mean(0) - x[(kind == k) & (b == 1)].mean(0)) for k in range(3)])
    apart = lambda x: min(np.linalg.norm(x[kind == i].mean(0) - x[kind == j].mean(0)) for i in range(3) for j in range(i))
    assert gap(got) < 0.2 * gap(z) and apart(got) > 0.8 * apart(z)
    same = em.harmony(df.where("batch = 'GPL570'"), "id", "v", "batch").collect()
    assert len(same) == 150 and all(np.allclose(r.corrected, z[r.id]) for r in same)
    assert em.harmony(df.limit(0), "id", "v", "batch").count() == 0
