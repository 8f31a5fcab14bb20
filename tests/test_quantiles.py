"""Quantiles through brackets against NumPy: ties, nulls, infinities, groups without values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from exprflow.operators.quantiles import exact_quantiles

AT = [0.0, 0.001, 0.25, 0.5, 0.7, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [100, 1000, 20_000])
def test_against_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    groups = {
        "normal": rng.normal(size=6000).tolist(), "ties": rng.integers(0, 3, 5000).astype(float).tolist(), "one": [4.5], "two": [1.0, 2.0],
        "heavy": (rng.pareto(0.2, 5000) + 1).tolist(), "same": [7.0] * 3000, None: rng.uniform(size=4000).tolist(), "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    out = {r.g: (r.n, r.q) for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], "x", AT, accuracy).collect()}
    assert set(out) == set(groups)
    assert out["none"] == (0, None)
    for g, vs in groups.items():
        if vs:
            assert out[g][0] == len(vs)
            np.testing.assert_allclose(out[g][1], np.quantile(vs, AT), rtol=1e-12)


def test_special_values_and_empty(spark):
    rows = [("g", v) for v in (float("-inf"), 1.0, float("inf"), float("nan"))]
    q = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.0, 1 / 3, 1.0]).first().q
    assert q[0] == float("-inf") and q[1] == 1.0 and math.isnan(q[2])
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0


def test_rows_in_another_order_each_time_they_are_read(spark):
    """As on a cluster, where a sketch that is computed again meets its parts in another order."""
    parts = [np.random.default_rng(i).normal(size=120_000) for i in range(3)]

    def shuffled(batches):
        for b in batches:
            for i in b["id"]:
                yield pd.DataFrame({"g": "g", "x": np.random.default_rng().permutation(np.random.default_rng(i).normal(size=120_000))})

    rows = spark.range(0, 3, numPartitions=3).mapInPandas(shuffled, "g string, x double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = [exact_quantiles(rows, ["g"], "x", AT, 100).first().q for _ in range(3)]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for q in found:
        np.testing.assert_allclose(q, np.quantile(np.concatenate(parts), AT), rtol=1e-12)
