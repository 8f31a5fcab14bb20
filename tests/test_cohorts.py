"""Cohorts: filters, clusters and edge cases that the tables lack."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from exprflow.operators import cohorts


def test_match_all(spark):
    df = spark.createDataFrame([("a", True, 1), ("b", True, 2), ("c", False, 1)], "x string, y boolean, z int")
    assert [r.x for r in df.where(cohorts.match_all(x=["a", "c", ""], y=True)).collect()] == ["a"]
    assert df.where(cohorts.match_all(x=[], y=None)).count() == 3
    assert [r.x for r in df.where(cohorts.match_all(z=2)).collect()] == ["b"]
    with pytest.raises(TypeError):
        cohorts.match_all(x={"a": 1})


def test_pseudo_cohorts(spark):
    rows = [(10 * g + i, [10.0 * g + 0.1 * i, -10.0 * g]) for g in range(3) for i in range(5)]
    rows += [(97, None), (98, [1.0, None]), (99, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = cohorts.pseudo_cohorts(df, "id", "v", range(2, 6), seed=1).collect()
    assert len(got) == 15 and {r.k for r in got} == {3}
    assert len({(r.id // 10, r.cluster) for r in got}) == 3
    same = cohorts.pseudo_cohorts(df.where("id < 1"), "id", "v", [2, 3]).collect()
    assert [(r.id, r.cluster, r.k) for r in same] == [(0, 0, 1)]
    assert cohorts.pseudo_cohorts(df.where("id < 0"), "id", "v", [2]).count() == 0


def test_summary_without_labels(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "b"), (2, "a")], "c int, l string")
    none = spark.createDataFrame([], "cluster int, bootstrap_jaccard double")
    got = sorted(tuple(r) for r in cohorts.cohort_summary(rows, "c", "l", none).collect())
    assert got == [(1, 2, "", "", None, False), (2, 2, "a", "a; b", None, False)]


def test_stability_of_separate_and_of_random_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 3), 0.5, 4)], i % 3, int(rng.integers(0, 3))) for i in range(150)] + [(999, [float("nan")] * 4, 0, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, good int, bad int")
    good, bad = ({r.cluster: r.bootstrap_jaccard for r in cohorts.stability(df, df.select("id", F.col(c).alias("cluster")), "id", "v", 3, seed=1).collect()} for c in ("good", "bad"))
    assert min(good.values()) >= 0.8 > max(bad.values()) and len(good) == 3


def test_different_rows_are_found_without_a_shuffle(spark):
    many = spark.createDataFrame([(Vectors.dense([float(i)]),) for i in range(50)], ["features"])
    late = spark.createDataFrame([(Vectors.dense([float(max(0, i - 90))]),) for i in range(95)], ["features"])
    assert cohorts._has_different(many, 50) and not cohorts._has_different(many, 51)
    assert cohorts._has_different(late, 5) and not cohorts._has_different(late, 6)
    assert not cohorts._has_different(many.limit(0), 2)


def test_principal_components_explain_what_numpy_says(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5)) @ np.diag([1, 5, 2, 1, 1]) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None)], "id long, v array<double>")
    got = np.array([r.scores for r in cohorts.principal_components(df, "id", "v", 2).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.svd(z, full_matrices=False)[1][:2]
    assert got.shape == (80, 2) and np.allclose(np.linalg.norm(got, axis=0), want, rtol=1e-6)
    assert cohorts.principal_components(df.limit(2), "id", "v").count() == 0
