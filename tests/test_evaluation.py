"""Attached and corrected labels, evaluation items, memory tiers, masked neighbours, group distances, content hashes: odd inputs and plain versions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from exprflow.operators import describe as de
from exprflow.operators import evaluation as ev
from exprflow.operators import neighbours as nb
from exprflow.operators import recollection as rc
from exprflow.operators import siblings as sb
from exprflow.sources import reports

RNG = np.random.default_rng(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_attach_keeps_every_row(spark):
    rows = spark.createDataFrame([("gsm1 ", 1.0, "old"), ("GSM2", 2.0, "old"), (None, 3.0, "old"), ("gsm1", 4.0, "old")], "GSM string, x double, series_id string")
    meta = spark.createDataFrame([("GSM1", "S1", "t", 9), ("gsm1", "S0", "u", 9), (None, "S9", "v", 9)], "GSM string, series_id string, Classified_tissue string, x int")
    assert got(ev.attach(rows, meta, ["GSM"])) == sorted([("gsm1 ", 1.0, "S0", "u"), ("GSM2", 2.0, None, None), (None, 3.0, None, None), ("gsm1", 4.0, "S0", "u")], key=str)
    ctx = spark.createDataFrame([("g1", "m", "title"), ("g2", "m", "other")], "gse string, gsm string, title string")
    res = spark.createDataFrame([("G1", "M", "v"), ("g3", "m", "w")], "gse string, gsm string, value string")
    assert got(ev.with_phase_context(res, ctx)) == [("G1", "M", "v", "title"), ("g3", "m", "w", None)]


def test_last_correction_counts(spark):
    values = spark.createDataFrame([("a", "Tissue", "x"), ("a", "Age", None), ("b", "Tissue", "y")], "gsm string, field string, value string")
    fixes = spark.createDataFrame([("a", "Tissue", "z1", "r", "q", 1), ("a", "Tissue", "z2", "r", "q", 2), ("a", "Sex", "f", "r", None, 1), ("zz", "Tissue", "n", "r", "q", 1), ("a", "Age", "5", "r", "q", None)], "gsm string, field string, suggest string, reason string, quote string, at int")
    assert got(ev.apply_corrections(values, fixes)) == [("a", "Age", "5", "", "r", "q"), ("a", "Sex", "f", "", "r", None), ("a", "Tissue", "z2", "x", "r", "q"), ("b", "Tissue", "y", None, None, None)]
    assert got(ev.apply_corrections(values, fixes.limit(0)).select("gsm", "field", "value")) == got(values)


def test_items_and_diversity(spark):
    schema = "GSM string, Tissue string, Age string"
    a = spark.createDataFrame([("m1", "lung", "N/A"), ("m2", None, "5"), ("m3", "x", "-"), ("m3", "y", "7")], schema)
    b = spark.createDataFrame([("M1 ", "Lung", "4"), ("m2", "liver", "5"), ("m3", "x", "-"), ("m3", "y", "8")], schema)
    assert got(ev.prediction_items(a, "GSM", ["Tissue"])) == [("M1", "Tissue", "lung"), ("M3", "Tissue", "x"), ("M3", "Tissue", "y")]
    assert got(ev.correction_items(a, b, "GSM", ["Tissue", "Age"])) == [("M1", "Age", "N/A", "4"), ("M2", "Tissue", "", "liver")]
    assert got(ev.normalization_items(a, b, "GSM", ["Tissue", "Age"])) == [("M1", "Tissue", "lung", "Lung"), ("M3", "Age", "7", "8")]
    table = {r.field: tuple(r)[1:] for r in ev.label_diversity(a.where("GSM <> 'm3'"), b.where("GSM <> 'm3'").withColumn("GSM", F.lower(F.trim("GSM"))), "GSM", ["Tissue", "Age"]).collect()}
    assert table == {"Tissue": (1, 2, -1, -100.0, 2), "Age": (2, 2, 0, 0.0, 1)}


def test_rows_meet_before_they_are_spread_by_field(spark):
    schema = "GSM string, Tissue string, Age string"
    a = spark.createDataFrame([("m1", "x", None), ("m1", "w", "-"), (None, "p", "1")], schema)
    b = spark.createDataFrame([("m1", "z", "2"), ("m1", "y", "1"), (None, "q", "1")], schema)
    for items, want in ((ev.correction_items(a, b, "GSM", ["Tissue", "Age"]), [("M1", "Age", "", "1"), ("M1", "Age", "-", "1")]), (ev.normalization_items(a, b, "GSM", ["Tissue", "Age"]).where("gsm is null"), [(None, "Tissue", "p", "q")])):
        assert got(items) == want
        assert not any("Join" in line and "field" in line for line in items._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_forms_tiers_and_registration(spark):
    clusters = spark.createDataFrame([("T", "Lung", "Cell line: A-549"), ("T", "Lung", " "), ("T", "Liver", "a 549"), ("T", None, "x"), ("C", "Lung", None)], "col string, cluster string, raw string")
    table = {(r.col, r.raw): r.cluster for r in rc.cluster_map(clusters).collect()}
    assert table["T", "Cell line: A-549"] == table["T", "A-549"] == table["T", "lung"] == "Lung" and table["T", "a 549"] == "Liver" and table["C", "Lung"] == "Lung" and ("T", "x") not in table
    log = spark.createDataFrame([("T", "pulmo", "Lung", 0.5, 1), ("T", "pulmo", "Lung", 0.7, 2), ("T", "Lung", "Lung", 1.0, 1)], "col string, raw string, canonical string, confidence double, at int")
    kin = rc.relations(clusters, log)
    assert got(kin.where("relation = 'variant_of'")) == [("T", "pulmo", "variant_of", "Lung", 0.7)]
    asked = spark.createDataFrame([("T", "pulmo"), ("T", "LUNG"), ("T", None), ("T", "nothing")], "col string, label string")
    found = {(r.label, r.tier): (r.answer, r.score) for r in rc.search(asked, rc.cluster_map(clusters), log, kin).collect()}
    assert found == {("LUNG", "cluster"): ("Lung", 1.0), ("pulmo", "episodic"): ("Lung", 0.6), ("pulmo", "relation"): ("Lung", 0.7)}
    new = spark.createDataFrame([("T", "Kidney", "Renal"), ("T", " ", "x"), ("T", "Lung2", "lung")], "col string, cluster string, raw string")
    after = {(r.col, r.raw): r.cluster for r in rc.registered(rc.cluster_map(clusters), new).collect()}
    assert after["T", "renal"] == after["T", "kidney"] == after["T", "Kidney"] == "Kidney" and after["T", "lung"] == "Lung2" and after["T", "Lung"] == "Lung"
    rules = spark.createDataFrame([("a", "a", "kg_x"), ("a", "b", None), ("a", "b", "episodic"), ("a", "b", "kg_x"), ("a", "b", "abbreviation"), ("a", "b", "zzz")], "r string, c string, k string")
    assert [r[0].why for r in rules.select(rc.log_policy(F.col("r"), F.col("c"), F.col("k"))).collect()] == ["identity", "no_change", "episodic_confirmed", "kg_verified", "deterministic", "other"]
    core = rc.core_labels(spark.createDataFrame([("x",), ("x",), ("n/a",), (None,), ("b",), ("a",)], "t string"), "t", 2)
    assert [(r.label, r.freq, r.rank) for r in core.orderBy("rank").collect()] == [("x", 2, 1), ("a", 1, 2)]


def plain_nearest(queries, base, k, least):
    out = []
    for i, v, c in queries:
        mask = c in {d for _, _, d in base} and c is not None
        sims = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w, d in base if j != i and np.linalg.norm(w) > 0 and (d == c or not mask)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(s for s in sims if -s[0] >= least)[:k])]
    return out


def test_masked_neighbours_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERY_BLOCK", 5)
    monkeypatch.setattr(nb, "BASE_BLOCK", 16)
    base = [(i, [float(x) for x in RNG.integers(-3, 4, 6)], "ab"[i % 2]) for i in range(60)] + [(60, [0.0] * 6, "a"), (61, [1.0] * 6, "a"), (62, [2.0] * 6, "a")]
    asked = [b for b in base if b[0] % 5 == 0 and any(b[1])] + [(500, [1.0] * 6, "zz"), (501, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0], None)]
    schema = "id long, vector array<double>, col string"
    got_ = nb.nearest_vectors(spark.createDataFrame([*asked, (600, None, "a"), (601, [0.0] * 6, "a")], schema), spark.createDataFrame([*base, (700, None, "a"), (701, [float("nan")] * 6, "a")], schema), 4, 0.0, "col")
    rows = sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in got_.collect())
    want = sorted(plain_nearest(asked, base, 4, 0.0))
    assert [r[:2] + r[3:] for r in rows] == [(a, b, round(s, 9)) for a, b, _, s in want] and {r[0] for r in rows} >= {500, 501}
    labels = spark.createDataFrame([("lung", [1.0, 0.0], "T"), ("liver", [0.0, 1.0], "T"), ("lung", [1.0, 0.0], "C")], schema.replace("long", "string"))
    q = spark.createDataFrame([("1", [0.6, 0.8], [1.0, 0.05], "T"), ("2", [0.5, -0.9], None, "T")], "id string, vector array<double>, other array<double>, col string")
    assert [(r.query_id, r["rank"], r.id) for r in nb.semantic_search(q, labels).orderBy("rank").collect()] == [("1", 1, "lung"), ("1", 2, "liver")]


def test_group_distances_of_shifted_groups(spark):
    rows = [("g", "a", float(v)) for v in range(50)] + [("g", "b", float(v + 3)) for v in range(50)] + [("g", "c", None), ("h", "a", 1.0), ("h", "b", 1.0), ("g", None, 5.0)]
    found = {(r.gene, r.a, r.b): r for r in de.group_distances(spark.createDataFrame(rows, "gene string, grp string, value double"), "grp").collect()}
    assert set(found) == {("g", "a", "b"), ("h", "a", "b")}
    assert abs(found["g", "a", "b"].wasserstein - 3) < 1e-9 and abs(found["g", "a", "b"].delta_mean - 3) < 1e-9 and 0 < found["g", "a", "b"].js < 1
    assert tuple(found["h", "a", "b"])[3:] == (0, 0, 0)


def test_hashes_and_reports(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", {"k": 1}), (2, None, None), (2, None, None)], "i long, s string, m map<string,int>")
    same = a.select("m", "s", "i").repartition(3)
    one = reports.content_hash(a)
    assert len(one) == 16 and reports.content_hash(same) == one
    assert len({one, reports.content_hash(a.limit(2)), reports.content_hash(a.withColumn("i", F.col("i") + 1)), reports.content_hash(a.withColumnRenamed("i", "j")), reports.content_hash(a.withColumn("i", F.col("i").cast("int")))}) == 5
    manifest = reports.build_manifest("de", {"alpha": 0.05}, {"counts": a}, seed=3)
    assert manifest["data_hashes"] == {"counts": one} and manifest["seed"] == 3 and manifest["versions"]["pyspark"] != "not installed"
    reports.write_manifest_json(spark, manifest, f"file://{tmp_path}/m")
    assert json.loads(spark.read.text(f"file://{tmp_path}/m").head().value)["tool"] == "de"
    terms = spark.createDataFrame([("t2", 0.5), ("t1", 0.01)], "term string, q_value double")
    text = reports.enrichment_report("a vs b", terms, terms.limit(0), top=1, manifest=manifest)
    assert "# Enrichment report: a vs b" in text and "| t1 | 0.01 |" in text and "t2" not in text and "_No results._" in text and f"counts=`{one}`" in text and '"alpha": 0.05' in text


def test_siblings_of_odd_groups(spark):
    rows = [("a", 1, "lung", 0), ("a", 2, "lung ", 0), ("a", 3, "liver", 1), ("a", 4, None, 0), ("b", 5, "not specified", 0), (None, 6, "x", 0), ("c", 7, "y", 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "g string, id int, v string, f int, n int")
    assert got(sb.sibling_mode(df, ["g"], "v", F.col("f") == 1)) == sorted([("a", "lung", 2), (None, "x", 1)], key=str)
    assert dict(got(sb.sibling_line(df, ["g"], "v", 1))) == {"a": '"lung" (n=2)', "b": "(none)", None: '"x" (n=1)', "c": '"y" (n=1)'}
    meta = spark.createDataFrame([("a", "T", None, " D ")], "g string, title string, summary string, design string")
    blocks = dict(got(sb.context_blocks(df, "g", "id", "v", "n", meta)))
    assert blocks["a"] == "Experiment title  : T\nOverall design    : D\nTotal samples    : 4  |  Labeled v: 3  |  Still NS     : 1\n\nKnown v labels in this experiment:\n  [   2]  lung\n  [   1]  liver\n\nExample labeled samples:\n  1    v: lung  |  n: 9\n  3    v: liver  |  n: 9"
    assert blocks["b"].endswith("No v labels assigned yet in this experiment.") and set(blocks) == {"a", "b", "c"}
    texts = ["'it''s\\n'", '"x', "x'", "  plain ", "''", "'", None, '\\"q\\"', "a\\\\b"]
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(sb.unrepr(F.col("t"))).collect()
    assert [r[0] for r in plain] == ["it''s\n", "x", "x", "plain", "", "", None, '"q\\', "a\\b"]
