"""Exact tails against plain sums and enumerated paths; the consensus curator's rules."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest

from exprflow.functions import tails
from exprflow.operators import describe as de
from exprflow.operators import labels as lb

RNG = np.random.default_rng(1)


def terms(b, c, d):
    return {i: math.comb(b, i) * math.comb(d - b, c - i) / math.comb(d, c) for i in range(max(0, b + c - d), min(b, c) + 1)}


def test_tails_equal_plain_sums():
    for _ in range(400):
        d = int(RNG.integers(1, 60))
        b, c = (int(x) for x in RNG.integers(0, d + 1, 2))
        t = terms(b, c, d)
        a = int(RNG.integers(-1, min(b, c) + 3))
        assert tails.hypergeom_tail(a, b, c, d) == pytest.approx(sum(p for i, p in t.items() if i >= a), rel=1e-9, abs=1e-15)
        a = int(RNG.choice(list(t)))
        want = sum(p for p in t.values() if p <= t[a] * (1 + 1e-7))
        assert tails.fisher_p(a, b - a, c - a, d - b - c + a) == pytest.approx(want, rel=1e-7)
    assert tails.fisher_p(-3, 0, 0, 0) == 1 and tails.hypergeom_tail(0, 0, 0, 0) == 1


def test_tails_of_large_tables_are_quick():
    began = time.perf_counter()
    p = tails.fisher_p(250_100_000, 249_900_000, 249_900_000, 250_100_000)
    assert 1e-40 < p < 1e-30 and time.perf_counter() - began < 2
    z = (251_000 - 250_000) / math.sqrt(1_000_000 / 16)
    assert tails.hypergeom_tail(251_000, 500_000, 500_000, 1_000_000) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=0.02)


def test_distances_have_exact_p_values(spark):
    for m, n in ((3, 3), (4, 2), (5, 3), (4, 4)):
        seen = []
        for picks in itertools.combinations(range(m + n), m):
            steps = [1 if i in picks else 0 for i in range(m + n)]
            up = np.cumsum(steps) / m - np.cumsum([1 - s for s in steps]) / n
            seen.append(np.abs(up).max())
        for d in sorted(set(np.round(seen, 12))):
            assert tails.ks_exact(np.array([d]), m, n)[0] == pytest.approx(np.mean(np.array(seen) >= d - 1e-9), abs=1e-12)
    df = spark.createDataFrame([(0.5, 4, 4), (0.5, 3000, 3000), (0.02, 3000, 3000)], "ks double, n1 long, n0 long")
    got = [r[0] for r in df.select(tails.ks_two_sample_sf("ks", "n1", "n0")).collect()]
    assert got[0] == pytest.approx(0.771428571) and got[1] < 1e-100 and 0.5 < got[2] < 0.7


def test_verdicts_and_one_gene_on_all_platforms(spark):
    rows = [("A", "x", float(v)) for v in RNG.normal(size=60)] + [("A", "y", float(v)) for v in RNG.normal(size=60)] + [("A", "z", float(v)) for v in RNG.normal(3, 1, 60)]
    df = spark.createDataFrame([*rows, ("A", "one", 1.0), ("b", "x", 1.0), ("A", "x", None)], "gene string, platform string, value double")
    got = {(r.a, r.b): r.verdict for r in de.modality_verdicts(df).collect()}
    assert got == {("x", "y"): "same shape", ("x", "z"): "differs", ("y", "z"): "differs"}
    classes = spark.createDataFrame([("A", "x", "Normal"), ("A", "y", "Normal"), ("A", "z", "Gamma"), ("b", "x", "Not Enough Data")], "gene string, platform string, distribution string")
    told = {r.gene: r for r in de.modality_concordance(df, classes, de.modality_verdicts(df)).collect()}
    assert (told["A"].n_sources, told["A"].n_pairs, told["A"].n_same, told["A"].concordant) == (4, 3, 1, False)
    assert told["b"].concordant and told["b"].n_pairs == 0 and "is consistent" in told["b"].summary
    stats, pair = de.platform_comparison(df, " a ")
    assert {r.platform: r.n for r in stats.collect()} == {"x": 60, "y": 60, "z": 60, "one": 1} and [(r.a, r.b) for r in pair.collect()] == [("x", "y")]
    assert de.platform_comparison(df, "none")[1].count() == 0


def test_curator_rules(spark):
    rows = [("g", i, None if i < 8 else "Tumor", "tissue: skin", ["tissue"]) for i in range(9)]
    rows += [("h", 20 + i, "lung" if i else None, "a", ["k"] if i < 5 else None) for i in range(8)] + [("h", 30, "n/a", "", ["other"])]
    rows += [("g", 40, "tissue: skin", "x;\ttissue:  skin", ["tissue"]), ("g", 41, "Skin", "tissue: skin", ["tissue"]), (None, 50, None, None, None), ("g", 42, "Ghost", "", ["rare"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, id long, label string, blob string, fields array<string>, n int")
    got = {r.id: (r.final_value, r.action, r.reason) for r in lb.curate(df, ["g"], "label", "blob", "fields", share=0.6).collect()}
    assert len(got) == len(rows) and got[0] == ("Not Specified", "keep", "no_consensus") and got[8] == ("Not Specified", "demote", "siblings_silent")
    assert got[20] == ("lung", "promote", "siblings_agree") and got[30] == ("Not Specified", "flag_only", "siblings_agree") and got[21][1] == "keep"
    assert got[40] == ("Not Specified", "demote", "key_value_leak") and got[41][:2] == ("Skin", "keep") and got[42] == ("Ghost", "flag_only", "siblings_silent")
    assert got[50] == ("Not Specified", "keep", "few_siblings") and lb.curate(df.limit(0), ["g"], "label", "blob", "fields").count() == 0
