"""Bootstrap intervals of any statistic against NumPy with the same draws."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprflow.operators import resample

RNG = np.random.default_rng(2)
SCHEMA = "g string, id long, value double, _x int, n string"


@pytest.fixture(scope="module")
def values(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(RNG.gamma(2, 3, 700))] + [("b", 1000 + i, float(v)) for i, v in enumerate(RNG.normal(1e6, 1, 41))]
    rows += [(None, 2000 + i, float(v)) for i, v in enumerate(RNG.integers(0, 3, 90))] + [("one", 3000, 5.0), ("a", 3001, None), ("a", 3002, float("nan")), ("none", 3003, None)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5).cache()


def plain(values, f, replicates, seed=3):
    live = values.where("value is not null and not isnan(value)").select("g", F.xxhash64("id", F.lit(seed)).alias("h"), "value").toPandas()
    out = {}
    for g, own in live.groupby("g", dropna=False):
        times = resample.draws(own["h"].to_numpy(), replicates)
        x = own["value"].to_numpy()
        with np.errstate(all="ignore"):
            stats = np.array([f(np.repeat(x, times[:, r])) if times[:, r].sum() else np.nan for r in range(replicates)])
        stats = stats[np.isfinite(stats)]
        ends = np.quantile(stats, [0.05, 0.95]) if len(x) > 1 else (None, None)
        with np.errstate(all="ignore"):
            whole = f(x) if len(x) else None
        out[g if isinstance(g, str) else None] = (len(x), whole, *ends)
    return out


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("name", ["mean", "variance", "median", "range"])
def test_intervals_equal_numpy(spark, values, name):
    f = {"mean": np.mean, "variance": lambda v: np.var(v, ddof=1) if len(v) > 1 else np.nan, "median": np.median, "range": np.std}[name]
    own = (lambda w, s1, s2: np.sqrt(np.maximum(0, s2 / w - (s1 / w) ** 2))) if name == "range" else name
    got = {r.g: (r.n, r.estimate, r.lower, r.upper) for r in resample.bootstrap(values, ["g"], "id", own, replicates=200, level=0.9, seed=3).collect()}
    want = plain(values, f, 200)
    assert got.keys() == want.keys() == {"a", "b", "one", None}
    for g, w in want.items():
        for x, y in zip(got[g], w, strict=True):
            if y is None or not np.isfinite(y):
                assert x is None, (g, got[g], w)
            elif not (name in ("variance", "range") and g == "one"):
                assert x == pytest.approx(y, rel=1e-4 if name == "range" else 1e-7), (g, got[g], w)


def test_without_groups_and_without_rows(spark, values):
    for name in ("mean", "median"):
        whole = resample.bootstrap(values.where("g = 'a'"), [], "id", name, replicates=50).collect()
        assert len(whole) == 1 and whole[0].n == 700 and whole[0].lower < whole[0].estimate < whole[0].upper
        assert resample.bootstrap(values.limit(0), ["g"], "id", name, replicates=5).count() == 0


def test_draws_are_poisson():
    times = resample.draws(RNG.integers(-(2**62), 2**62, 4000), 50)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    assert (resample._some_draws(np.arange(9), 7, 20) == resample.draws(np.arange(9), 30)[:, 7:20]).all()
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.05
