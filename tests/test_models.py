from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprflow.operators import describe as de
from exprflow.operators import memory as me
from exprflow.operators import models as mo
from exprflow.operators import statistics as st

EXPR = "platform string, sample_id long, gene string, value double"


def test_polygamma_against_known_values():
    assert mo.polygamma(0, 1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert mo.polygamma(1, 1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert mo.polygamma(1, 0.5) == pytest.approx(math.pi**2 / 2, abs=1e-9)


def test_variance_prior_recovers_what_it_was_drawn_from():
    rng = np.random.default_rng(3)
    d0, s0, df = 8.0, 2.0, 12.0
    s2 = d0 * s0 / rng.chisquare(d0, 200_000) * rng.chisquare(df, 200_000) / df
    got = mo.variance_prior(float(np.log(s2).mean()), float(np.log(s2).var(ddof=1)), df)
    assert got[0] == pytest.approx(d0, rel=0.05)
    shift = mo.polygamma(0, df / 2) - math.log(df / 2) - mo.polygamma(0, d0 / 2) + math.log(d0 / 2)
    assert got[1] == pytest.approx(s0 * math.exp(2 * shift), rel=0.05)  # the published sign would give s0 itself
    assert mo.variance_prior(0.0, 0.0, df)[0] == 1e6


def test_moderated_t_shrinks_between_gene_and_prior(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", s < 4, float(rng.normal(0, 1 + g % 3))) for g in range(60) for s in range(8)] + [("flat", s < 4, 1.0) for s in range(8)]
    df = spark.createDataFrame(rows, "gene string, is_case boolean, value double")
    mod, plain = ({r.gene: r for r in f(df).collect()} for f in (mo.moderated_t, st.welch))
    assert len(mod) == 61 and mod["flat"].t_stat == 0
    assert mod["g0"].df > 6
    spread = lambda m: np.var([r.t_stat for r in m.values() if r.t_stat])
    assert spread(mod) < spread(plain)
    few = {r.gene: r for r in mo.moderated_t(df.where("gene in ('g1', 'flat')")).collect()}
    assert few["g1"].df == 6 and few["flat"].t_stat is None and few["flat"].p_value is None


def test_benjamini_hochberg_over_many_ranges(spark):
    random.seed(1)
    p = [random.random() ** 6 for _ in range(3000)] + [0.0, 0.0, 1.0, 1e-300, 0.5, 0.5]
    got = {r.i: r.q_value for r in st.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    order, low, want = sorted(range(len(p)), key=lambda i: p[i]), 1.0, {}
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        low = want[i] = min(low, p[i] * len(p) / rank)
    assert all(got[i] == pytest.approx(want[i], rel=1e-12, abs=1e-300) for i in want)


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(rng.normal(10, 2, 400))] + [("b", 0, None)], "g string, id long, value double")
    one = mo.bootstrap_mean(rows, ["g"], "id", 300).collect()
    again = mo.bootstrap_mean(rows.repartition(7), ["g"], "id", 300).collect()
    assert [r.g for r in one] == [r.g for r in again] == ["a"] and tuple(one[0][2:]) == pytest.approx(tuple(again[0][2:]), rel=1e-12)
    r = one[0]
    assert r.n == 400 and r.lower < r.mean < r.upper
    assert r.upper - r.lower == pytest.approx(2 * 1.96 * 2 / 20, rel=0.2)


@pytest.mark.parametrize(("query", "module", "operator", "count"), [
    ("bootstrap_intervals", "models", "bootstrap_mean", 1000), ("gene_set_prerank", "statistics", "prerank", 1000), ("cohort_stability", "cohorts", "stability", 50),
])
def test_resampling_queries_run_the_reference_counts(spark, monkeypatch, query, module, operator, count):
    import importlib
    import inspect

    from exprflow import registry
    from exprflow.plans import models  # noqa: F401

    m, seen = importlib.import_module(f"exprflow.operators.{module}"), {}
    signature = inspect.signature(getattr(m, operator))
    turns = "permutations" if operator == "prerank" else "replicates"
    assert signature.parameters[turns].default == count

    def stub(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen["count"] = bound.arguments[turns]
        return args[0].limit(0)

    monkeypatch.setattr(m, operator, stub)
    registry.queries()[query](spark, "/root/testdata/sf0.001")
    assert seen["count"] == count


def test_prerank_finds_a_planted_set_and_ignores_partitioning(spark):
    ranked = spark.createDataFrame([(f"g{i}", 100.0 - i) for i in range(200)], "gene string, value double")
    sets = spark.createDataFrame([("top", f"G{i}") for i in range(12)] + [("mixed", f"g{i}") for i in range(3, 200, 17)] + [("absent", "x")], "term string, gene string")
    a = {r.term: r for r in st.prerank(ranked, sets, 100).collect()}
    b = {r.term: r for r in st.prerank(ranked.repartition(5), sets.repartition(3), 100).collect()}
    assert set(a) == {"top", "mixed"} and a["top"].es == pytest.approx(1.0) and a["top"].p_value < 0.05 < a["mixed"].p_value
    assert all(a[t].p_value == b[t].p_value for t in a)


def test_combat_removes_a_batch_shift_and_keeps_what_it_cannot_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(b, i, f"g{g}", float(rng.normal(g + shift, 1 + 0.3 * (b == "B")))) for b, shift in (("A", 0.0), ("B", 3.0)) for i in range(40) for g in range(20)]
    rows += [("A", 1, "lonely", 5.0), ("A", 1, "flat", 2.0), ("B", 1, "flat", 2.0)]
    out = mo.combat(spark.createDataFrame(rows, EXPR))
    gap = out.where("gene like 'g%'").groupBy("gene").agg(F.abs(F.avg(F.when(F.col("platform") == "A", F.col("value"))) - F.avg(F.when(F.col("platform") == "B", F.col("value")))).alias("d"))
    worst, usual = gap.agg(F.max("d"), F.avg("d")).first()  # sampling alone leaves gaps of 0.26 deviations; the planted shift is 3
    assert worst < 0.6 and usual < 0.25
    assert out.where("gene = 'lonely'").count() == 0
    assert [r.value for r in out.where("gene = 'flat'").collect()] == [2.0, 2.0]


def test_count_wald_against_planted_genes(spark):
    rng = np.random.default_rng(6)
    rows = [(s, f"g{g}", float(rng.negative_binomial(10, 10 / (10 + (200 if g < 5 and s < 6 else 50)))), s < 6) for s in range(12) for g in range(60)]
    counts = spark.createDataFrame(rows + [(s, "none", 0.0, s < 6) for s in range(12)], "sample_id int, gene string, count double, is_case boolean")
    flat = spark.createDataFrame([(s, 1.0) for s in range(12)], "sample_id int, size_factor double")
    got = {r.gene: r for r in mo.count_wald(counts, flat).collect()}
    assert "none" not in got and all(got[f"g{g}"].log2_fc == pytest.approx(2, abs=0.8) and got[f"g{g}"].q_value < 0.01 for g in range(5))
    assert sum(got[f"g{g}"].q_value < 0.01 for g in range(5, 60)) <= 3


def test_empty_inputs(spark):
    e = spark.createDataFrame([], EXPR).withColumn("is_case", F.lit(True)).withColumn("count", F.col("value"))
    for out in (
        mo.moderated_t(e), mo.bootstrap_mean(e, ["gene"], "sample_id", 5), mo.combat(e.drop("is_case")), de.transformation(e, ["gene"]), de.bin_counts(e, ["gene"]),
        de.density(e, ["gene"]), de.group_pairs(e, "platform", ["gene"]), de.group_enrichment(e, "platform", "gene"), de.modality_distances(e),
        mo.count_wald(e, e.select("sample_id", F.lit(1.0).alias("size_factor"))), me.sibling_snap(e, ["platform"], "gene"), me.top_or_other(e, "gene", 3),
        me.equal_width(e, "value"), me.stratified_sample(e, "platform", "sample_id", 5),
    ):
        assert out.count() == 0


def test_memory_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c"), (5, "a"), (6, "d")], "id int, v string")
    assert {r.id: r.binned for r in me.top_or_other(rows, "v", 3).collect()} == {1: "a", 2: None, 3: "b", 4: "Other", 5: "a", 6: "Other"}
    assert me.stratified_sample(rows, "v", "id", 6).count() == 6
    assert sorted(r.id for r in me.stratified_sample(rows, "v", "id", 5).collect())[1:] in ([2], [5])  # what is left goes to null, which has one row
    votes = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, None), (2, None)], "k int, s string")
    assert [(r.k, r.s, r.n_votes) for r in me.best_vote(votes, "k", "s").collect()] == [(1, "x", 2)]
