"""Dip test and mixtures, label vectors, cohorts of labels and the anomaly screen against plain versions."""

from __future__ import annotations

import random
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from exprflow.functions import dip
from exprflow.operators import anomalies as an
from exprflow.operators import distributions as ds
from exprflow.operators import labelvectors as lv


def _least_left(at, upper, lower, x):
    """The least value at ``at`` of a non-decreasing convex function within the bounds at ``x``, all left of it; None without one."""
    least = -np.inf
    for j in range(len(x)):
        if any(lower[j] > upper[b] + 1e-12 for b in range(j, len(x))):
            return None
        least = max(least, lower[j])
        for i in range(j):
            least = max(least, upper[i] + (lower[j] - upper[i]) / (x[j] - x[i]) * (at - x[i]))
            for k in range(j + 1, len(x)):
                t = (x[j] - x[i]) / (x[k] - x[i])
                if lower[j] > (1 - t) * upper[i] + t * upper[k] + 1e-12:
                    return None
    return least


def plain_dip(x, w):
    """By bisection: a distance will do if for some mode a convex left part and a concave right part stay within it."""
    after = np.cumsum(w) / w.sum()
    before = after - w / w.sum()

    def will_do(d):
        upper, lower = before + d, after - d
        for k in range(len(x)):
            left = _least_left(x[k], upper[:k], lower[:k], x[:k])
            right = _least_left(-x[k], -lower[:k:-1], -upper[:k:-1], -x[:k:-1])
            if left is not None and right is not None and left <= min(-right, upper[k]) + 1e-12 and lower[k] <= -right + 1e-12:
                return True
        return False

    a, b = 0.0, 1.0
    for _ in range(40):
        m = (a + b) / 2
        a, b = (a, m) if will_do(m) else (m, b)
    return max(b, 0.5 / w.sum())


def test_dip_equals_a_plain_one():
    rng = np.random.default_rng(0)
    for t in range(120):
        n = int(rng.integers(2, 9))
        x = np.sort(rng.random(n) if t % 3 else rng.choice(25, n, replace=False).astype(float))
        w = rng.integers(1, 5, n).astype(float) if t % 2 else np.ones(n)
        assert abs(dip.dip(x, w) - plain_dip(x, w)) < 1e-6
        assert abs(dip.dip(np.repeat(x, w.astype(int))) - dip.dip(x, w)) < 1e-12
    assert dip.dip(np.array([1.0, 2.0])) == 0.25 and dip.dip(np.ones(9)) == 1 / 18


def test_dip_of_knots_is_that_of_the_sample():
    rng = np.random.default_rng(3)
    at = np.linspace(0, 1, 2049)
    for x in (rng.normal(size=200_000), np.concatenate([rng.normal(-1.5, 1, 100_000), rng.normal(1.5, 1, 100_000)]), rng.standard_cauchy(200_000)):
        assert abs(dip.knot_dip(np.quantile(x, at, method="inverted_cdf"), len(x)) - dip.dip(x)) < 5e-4
    assert dip.knot_dip(np.linspace(0, 1, 2049), 10**9) < 1e-6


def test_heavy_tails_and_large_genes_have_one_mode(spark):
    rng = np.random.default_rng(9)
    values = {"cauchy": rng.standard_cauchy(500), "many": rng.standard_cauchy(60_000), "normal": rng.normal(size=60_000), "two": np.concatenate([rng.normal(-2, 1, 30_000), rng.normal(2, 1, 30_000)])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "gene string, value double")
    assert {r.gene: r.distribution for r in ds.distribution_classes(df).collect()} == {"cauchy": "Cauchy", "many": "Cauchy", "normal": "Normal", "two": "Bimodal"}


def test_p_values_of_uniform_samples_are_uniform(spark):
    nulls = ds.uniform_dips(spark)
    assert {len(v) for v in nulls.values()} == {dip.NULL_DRAWS} and nulls is ds.uniform_dips(spark)
    rng = np.random.default_rng(4)
    for n in (25, 300, 5000):
        p = [dip.dip_p_value(dip.dip(rng.random(n)), n, nulls) for _ in range(60)]
        assert 0.3 < np.mean(p) < 0.7 and 0 < np.mean(np.array(p) < 0.2) < 0.45
    assert dip.dip_p_value(0.2, 200, nulls) == 0 and dip.dip_p_value(1 / 400, 200, nulls) == 1


def test_mixtures_are_counted():
    rng = np.random.default_rng(5)
    for k in (2, 3, 4):
        x = np.concatenate([rng.normal(6 * i, 1, 400) for i in range(k)])
        assert dip.n_components(x, np.ones(len(x))) == k
        score, shares, means, deviations = dip.normal_mixture(x, np.ones(len(x)), k)
        assert np.allclose(np.sort(means), 6 * np.arange(k), atol=0.25) and np.allclose(shares, 1 / k, atol=0.03) and np.allclose(deviations, 1, atol=0.15)
        plain = np.log((shares * np.exp(-((x[:, None] - means) ** 2) / 2 / deviations**2) / deviations / np.sqrt(2 * np.pi)).sum(1)).sum()
        assert abs(plain - score) < 1e-3 * abs(plain)


def test_close_modes_that_the_density_misses(spark):
    rng = np.random.default_rng(7)
    values = {"close": np.concatenate([rng.normal(-1.25, 1, 9000), rng.normal(1.25, 1, 9000)]), "one": rng.normal(size=18000), "few": rng.normal(size=19)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "gene string, value double")
    with_dip = {r.gene: r.distribution for r in ds.distribution_classes(df).collect()}
    without = {r.gene: r.distribution for r in ds.distribution_classes(df, dip_test=False).collect()}
    assert with_dip == {"close": "Bimodal", "one": "Normal", "few": "Not Enough Data"} and without["close"] not in ds.MODAL
    assert [r.gene for r in ds.distribution_classes(df, genes=["ONE", "none"]).collect()] == ["one"]


def plain_grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return Counter(out)


def test_label_vectors_equal_plain_ones(spark):
    texts = ["MCF7 tamoxifen 24h", "a", "ab c", "ab c", "  padded ", "Été à Zürich", None, "", "  ", "x" * 3000]
    got: dict = {}
    for r in lv.label_vectors(spark.createDataFrame([(t,) for t in texts], "label string"), "label").collect():
        got.setdefault(r.label, {})[r.term] = r.weight
    live = [t.strip() for t in texts if t and t.strip()]
    df = Counter(g for t in live for g in plain_grams(t))
    df = {g: sum(g in plain_grams(t) for t in live) for g in df}
    for t in set(live):
        w = {g: c * (np.log((1 + len(live)) / (1 + df[g])) + 1) for g, c in plain_grams(t).items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        assert got[t].keys() == w.keys() and all(abs(got[t][g] - v / norm) < 1e-9 for g, v in w.items())
    assert len(got) == len(set(live)) and lv.label_vectors(spark.createDataFrame([], "label string"), "label").count() == 0


def test_cohorts_of_labels_and_their_stability(spark):
    rows = [(i, f"{('MCF7 tamoxifen 24h', 'MCF7 DMSO control 24h', 'A549 cisplatin 48h')[i // 8]} rep{i}") for i in range(24)] + [(90, None), (91, " ")]
    cohorts = lv.label_cohorts(spark.createDataFrame(rows, "id long, label string"), "id", "label", range(2, 5), starts=4).cache()
    got = cohorts.collect()
    assert len(got) == 24 and {r.k for r in got} == {3} and len({(r.id // 8, r.cluster) for r in got}) == 3
    scores = lv.cohort_stability(cohorts, "id", replicates=3, starts=3).collect()
    assert len(scores) == 3 and min(r.bootstrap_jaccard for r in scores) >= 0.8
    rng = random.Random(42)
    noise = spark.createDataFrame([(i, "".join(rng.choices(string.ascii_lowercase, k=20))) for i in range(20)], "id long, label string")
    scores = lv.cohort_stability(lv.label_cohorts(noise, "id", "label", range(2, 5), starts=3), "id", replicates=3, starts=3).collect()
    assert min(r.bootstrap_jaccard for r in scores) < 0.75
    same = spark.createDataFrame([(1, "x"), (2, "x ")], "id long, label string")
    assert [(r.cluster, r.k) for r in lv.label_cohorts(same, "id", "label").collect()] == [(0, 1)] * 2


SCHEMA = "g string, id long, value string, text string, n int, suspicion string"


def test_anomaly_screen_of_odd_samples(spark):
    rows = [("a", i, "breast tumor", "tissue: breast tumor; age: 5") for i in range(9)] + [("a", 20, "!!! ???", "tissue: breast tumor")]
    rows += [("b", 30, None, None), (None, 40, "liver", "liver"), (None, 41, "liver", None), ("a", 9, "", "x")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    signals = an.anomaly_signals(df, ["g"], "id", "value", "text").cache()
    got = {r.id: r for r in signals.collect()}
    assert len(got) == len(rows) and got[0].evidence < 1e-6 and got[30].evidence == 1 and got[30].value == an.UNSPECIFIED
    assert (got[30].consensus, got[30].knn_ood, got[30].ngram_div) == (0, 0, 1)
    assert got[40].knn_ood < 1e-9 and got[41].evidence == 1 and got[20].consensus > 0.8 and got[20].knn_ood == 1 and got[20].ngram_div == 1
    assert all(0 <= getattr(r, s) <= r.suspicion <= 1 for r in got.values() for s in an.SIGNALS)
    flags = {r.id: r for r in an.flag_anomalies(signals, ["g"], "id").collect()}
    assert 20 in flags and 0 not in flags and flags[20].nearest_sibling is None and flags[20].cluster_size == 1
    empty = an.anomaly_signals(df.limit(0), ["g"], "id", "value", "text")
    assert empty.count() == 0 and an.flag_anomalies(empty, ["g"], "id").count() == 0


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(3)
    words = ["liver", "lung", "tumor", "normal", "cell", "line", "blood", "T-cell"]
    values = [" ".join(rng.choices(words, k=3)) for _ in range(60)]
    df = spark.createDataFrame([("g", i, v, v) for i, v in enumerate(values)], "g string, id long, value string, text string")
    key = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows)
    whole = an.anomaly_signals(df, ["g"], "id", "value", "text")
    flags = key(an.flag_anomalies(whole, ["g"], "id").collect())
    monkeypatch.setattr(an, "BLOCK", 9)
    cut = an.anomaly_signals(df, ["g"], "id", "value", "text")
    assert key(cut.collect()) == key(whole.collect()) and key(an.flag_anomalies(cut, ["g"], "id").collect()) == flags and len(flags) > 3
    assert cut.where(F.col("knn_ood") > 0).count() > 0
