"""Distribution classes, variability rankings and combined ranks against planted cases and NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from exprflow.functions.tails import normal_sf2
from exprflow.operators import distributions as ds
from exprflow.operators import normalize as nm
from exprflow.operators import statistics as st
from pyspark.sql import functions as F


def test_distribution_classes_of_planted_genes(spark):
    rng = np.random.default_rng(10)
    genes = {
        "two": np.concatenate([rng.normal(-5, 0.5, 200), rng.normal(5, 0.5, 200)]), "tight": np.concatenate([rng.normal(2, 0.3, 30), rng.normal(9, 0.3, 30)]),
        "three": np.concatenate([rng.normal(m, 0.4, 200) for m in (0, 10, 20)]), "normal": rng.normal(0, 1, 400), "lognormal": rng.lognormal(1, 0.8, 2000),
        "uniform": rng.uniform(0, 1, 3000), "cauchy": rng.standard_cauchy(500), "gamma": rng.gamma(3.0, 2.0, 4000), "few": np.ones(3), "constant": np.ones(100),
    }
    rows = [(g, float(x)) for g, v in genes.items() for x in v] + [("few", None), ("few", float("nan")), ("few", float("inf")), ("none", None)]
    got = {r.gene: (r.n, r.distribution) for r in ds.distribution_classes(spark.createDataFrame(rows, "gene string, value double")).collect()}
    want = {"two": "Bimodal", "tight": "Bimodal", "three": "Multimodal", "normal": "Normal", "lognormal": "Lognormal", "uniform": "Uniform", "cauchy": "Cauchy", "gamma": "Gamma", "few": "Not Enough Data", "constant": "Effectively Constant"}
    assert {g: c for g, (_, c) in got.items()} == want and got["two"][0] == 400 and got["few"][0] == 3
    classes = spark.createDataFrame([(g, 1, c) for g, c in want.items()], "gene string, n long, distribution string")
    ranked = spark.createDataFrame([("TWO", 1.0), ("normal", 2.0), ("unknown", 3.0), ("Three", 4.0)], "gene string, rank double")
    assert {r.gene for r in ds.keep_distributions(ranked, classes, ("bimodal", "MULTIMODAL")).collect()} == {"TWO", "Three"}
    summary = {r.distribution: (r.n_genes, r.fraction) for r in ds.distribution_summary(classes).collect()}
    assert summary["Bimodal"] == (2, 0.2) and sum(f for _, f in summary.values()) == pytest.approx(1)
    assert ds.distribution_classes(spark.createDataFrame([], "gene string, value double")).count() == 0


def test_small_genes_need_no_sketch_and_may_span_batches(spark):
    rng = np.random.default_rng(12)
    genes = {f"g{i}": rng.normal(0, 1, 60) if i % 2 else np.concatenate([rng.normal(0, 0.5, 40), rng.normal(9, 0.5, 40)]) for i in range(8)}
    rows = spark.createDataFrame([(g, float(x)) for g, v in genes.items() for x in v] + [(None, 1.0)] * 30, "gene string, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        classes = ds.distribution_classes(rows)
        got = {r.gene: (r.n, r.distribution) for r in classes.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {g: n for g, (n, _) in got.items()} == {g: len(v) for g, v in genes.items()}
    assert {g for g, (_, c) in got.items() if c == "Bimodal"} == {g for g in genes if int(g[1:]) % 2 == 0}
    assert "percentile_approx" not in classes._jdf.queryExecution().toString()


def test_peaks_by_prominence():
    y = np.array([0, 1, 0.9, 3, 0, 2, 0, 0.1, 0])
    assert ds.peaks(y, 0.05).tolist() == [1, 3, 5, 7] and ds.peaks(y, 0.15).tolist() == [3, 5] and ds.peaks(y, 2.5).tolist() == [3]


def pairs(spark):
    rng = np.random.default_rng(4)
    data = {g: (rng.normal(0, s1, 30), rng.normal(1, s0, 25)) for g, s1, s0 in (("up", 3, 1), ("down", 1, 3), ("same", 1, 1))}
    rows = [(g, bool(i == 0), float(x)) for g, v in data.items() for i in (0, 1) for x in v[i]] + [("few", True, 1.0)] * 2 + [("few", False, 2.0)] * 5
    return data, spark.createDataFrame(rows, "gene string, is_case boolean, value double")


@pytest.mark.parametrize("method", st.VARIABILITY_METHODS)
def test_variability_methods(spark, method):
    data, rows = pairs(spark)
    got = {r.gene: r for r in st.rank_by_variability(rows, method).collect()}
    assert set(got) == set(data)
    for g, (a, b) in data.items():
        r = got[g]
        v1, v0 = a.var(ddof=1), b.var(ddof=1)
        assert (r.var_case, r.var_control, r.mean_case, r.mean_control, r.delta_var) == pytest.approx((v1, v0, a.mean(), b.mean(), v1 - v0))
        if method.startswith("logvar"):
            z = np.log(v1 / v0) / np.sqrt(2 / 29 + 2 / 24)
            assert r.stat == pytest.approx(z if method == "logvar_z" else np.log2(v1 / v0)) and r.rank == r.stat
        elif method in ("bf", "levene"):
            mid = np.median if method == "bf" else np.mean
            x, y = abs(a - mid(a)), abs(b - mid(b))
            grand = np.concatenate((x, y)).mean()
            w = 53 * (30 * (x.mean() - grand) ** 2 + 25 * (y.mean() - grand) ** 2) / (((x - x.mean()) ** 2).sum() + ((y - y.mean()) ** 2).sum())
            assert r.stat == pytest.approx(w)
        else:
            at = np.sort(np.concatenate((a, b)))
            gap = np.abs(np.searchsorted(np.sort(a), at, "right") / 30 - np.searchsorted(np.sort(b), at, "right") / 25)
            assert r.stat == pytest.approx(gap.max() if method == "ks" else (gap[:-1] * np.diff(at)).sum())
        assert np.sign(r.rank) == np.sign(v1 - v0)
        assert (r.p_value is None) == (method in ("wasserstein", "logvar_ratio")) and (r.p_value is None or 0 <= r.p_value <= 1)
    if method in ("logvar_z", "bf", "levene"):
        assert got["up"].p_value < 1e-3 < got["same"].p_value


def test_combined_ranks(spark):
    rows = [("A", "g1", 1.0, 4.0), ("B", "g1", 1.2, 5.0), ("A", "g2", 0.1, 0.2), ("B", "g2", -0.1, -0.3), ("A", "g3", 1.0, 3.0)]
    e = spark.createDataFrame(rows, "platform string, gene string, log_fc double, t_stat double")
    got = {r.gene: r for r in st.combine_ranks(e).collect()}
    assert set(got) == {"g1", "g2"}
    z = {g: got[g].z for g in got}
    p = {r.z: r.p for r in spark.createDataFrame([(v,) for v in z.values()], "z double").withColumn("p", normal_sf2(F.col("z"))).collect()}
    assert got["g1"].p_value == p[z["g1"]] and got["g1"].q_value == pytest.approx(2 * got["g1"].p_value) and got["g2"].q_value == pytest.approx(got["g2"].p_value)
    assert {r.gene: round(r.z, 6) for r in st.combine_ranks(e, "stouffer").collect()}["g1"] == round(9 / 2**0.5, 6)
    assert st.combine_ranks(e, "rank_product").count() > 0
    for bad in (lambda: st.combine_ranks(e, "other"), lambda: st.rank_by_variability(e, "other")):
        with pytest.raises(ValueError):
            bad()


def test_probe_repair_only_if_nothing_meets(spark):
    values = spark.createDataFrame([("12.0", 1, 2.0), ("7.0", 1, 4.0), ("x", 1, 9.0)], "probe_id string, sample_id long, value double")
    padded = spark.createDataFrame([("0012", "A"), ("0007", "A")], "probe_id string, gene string")
    assert [(r.gene, r.value) for r in nm.map_probes_repaired(values, padded).collect()] == [("A", 3.0)]
    some = padded.union(spark.createDataFrame([("x", "B")], padded.schema))
    assert [(r.gene, r.value) for r in nm.map_probes_repaired(values, some).collect()] == [("B", 9.0)]
    assert nm.map_probes_repaired(values.limit(0), padded).count() == 0


def test_platform_scale_clips_and_takes_logs_above_fifty(spark):
    got = spark.createDataFrame([(-3.0,), (50.0,), (64.0,), (None,)], "v double").select(nm.platform_scale(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [0.0, 50.0, 6.0, None]
