from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from exprflow.functions.tails import fisher_two_sided, kolmogorov_sf, normal_sf2, student_sf2
from exprflow.operators import labels as lb
from exprflow.operators import normalize as nm
from exprflow.operators import statistics as st


def test_tails_against_known_values(spark):
    row = spark.range(1).select(
        normal_sf2(F.lit(1.959964)).alias("z"), student_sf2(F.lit(2.228139), F.lit(10.0)).alias("t"), kolmogorov_sf(F.lit(1.358)).alias("k"),
        fisher_two_sided(F.lit(8), F.lit(2), F.lit(1), F.lit(5)).alias("f"),
    ).first()
    assert row.z == pytest.approx(0.05, abs=1e-5)
    assert row.t == pytest.approx(0.05, abs=1e-6)
    assert row.k == pytest.approx(0.05, abs=1e-3)
    assert row.f == pytest.approx(0.0349650, abs=1e-6)


def test_benjamini_hochberg_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.5)], "id int, p double")
    q = {r.id: r.q_value for r in st.benjamini_hochberg(rows, "p").collect()}
    assert q[4] is None and q[5] == 0.5
    assert q[2] == q[3] == pytest.approx(0.02 * 4 / 3) and q[1] == pytest.approx(min(0.04, 0.02 * 4 / 3))


def test_quantile_normalize_gives_equal_distributions(spark):
    rows = [(s, f"g{g}", float((s + 1) * (g + 1) ** 2)) for s in range(3) for g in range(5)] + [(3, "g0", None), (3, "g1", 5.0)]
    out = nm.quantile_normalize(spark.createDataFrame(rows, "sample_id int, gene string, value double"))
    per = {}
    for r in out.where("sample_id < 3").collect():
        per.setdefault(r.sample_id, []).append(round(r.value, 6))
    assert len({tuple(sorted(v)) for v in per.values()}) == 1
    assert out.where("sample_id = 3 and value is null").count() == 1


def test_size_factors_without_a_full_gene_use_libraries(spark):
    c = spark.createDataFrame([(1, "a", 4.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 12.0)], "sample_id int, gene string, count double")
    f = {r.sample_id: r.size_factor for r in nm.size_factors(c).collect()}
    assert f == {1: 0.5, 2: 1.5}


def test_parse_values_drops_missing_and_repeats(spark):
    d = spark.createDataFrame([("liver; N/A;liver ; lung.",), (None,), ("none",)], "a string")
    assert [r.x for r in d.select(lb.parse_values(F.col("a")).alias("x")).collect()] == ["liver; lung", lb.NOT_SPECIFIED, lb.NOT_SPECIFIED]


def test_collapse_by_form_initials_and_numbers(spark):
    labels = ["T cell"] * 3 + ["t-cell", "natural killer cell", "natural killer cell", "NKC", "CD 4", "CD8"]
    out = lb.collapse(spark.createDataFrame([("s", x) for x in labels], "g string, label string"), ["g"], "label")
    got = {r.label: r.canonical for r in out.collect()}
    assert got["t-cell"] == "T cell" and got["NKC"] == "natural killer cell" and got["CD 4"] == "CD 4" and got["CD8"] == "CD8"


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "platform string, sample_id long, label int, gene string, value double")
    rows = st.two_groups(e, F.col("label") == 0, F.col("label") == 1)
    for f in (st.rank_genes, st.variability, st.levene, st.distribution_distance, st.rank_sum, st.jensen_shannon):
        assert f(rows).count() == 0
    assert nm.quantile_normalize(e).count() == 0


def test_stouffer_of_equal_t(spark):
    z = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", 2.0), ("a", 2.0), ("b", None)], "gene string, z double")
    r = st.stouffer(z).collect()
    assert len(r) == 1 and r[0].z == pytest.approx(2 * math.sqrt(4))
