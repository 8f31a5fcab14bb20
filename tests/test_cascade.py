"""The resolution cascade: a planted label for each tier, order, idempotence and odd inputs."""

from __future__ import annotations

from exprflow.operators import cascade as ca

LABELS = "grp string, col string, label string"


def knowledge(spark):
    make = spark.createDataFrame
    return ca.Knowledge(
        siblings=make([("g", "Tissue", "kidney", "D1", "Kidney", 9), ("g", "Tissue", "left lung lobe", "D2", "Lung", 3), ("g", "Condition", "no asthma", "D8", "No Asthma", 50), ("g", "Condition", "asthma severe", "D9", "Asthma", 1)], "grp string, col string, raw string, id string, name string, n_uses long"),
        history=make([("Tissue", "Hippocampus", "D3", "Hippocampus", "x", 1), ("Tissue", "hippocampus", "D4", "Hippocampal Formation", "x", 2)], "col string, label string, id string, name string, source string, at long"),
        vocabulary=make([("Tissue", "Liver", "D5", "Liver"), ("Tissue", "hepar", "D5", "Liver"), ("Tissue", "twice", "D6", "A"), ("Tissue", "twice", "D7", "B"), ("Treatment", "paclitaxel", "D20", "Paclitaxel"), ("Tissue", "Stomach", "D21", "Stomach")], "col string, term string, id string, name string"),
        minted=make([("Tissue", "odd organ", "ART-TI-00004")], "col string, label string, id string"),
        candidates=make([("Tissue", "xylo", "D30", "Xylophone Thing", 0.9), ("Tissue", "xylo", "D31", "Other", 0.8), ("Condition", "sole", "D32", "Sole Disease", 0.1), ("Treatment", "aspirin", "D33", "Aspirin", 0.6), ("Treatment", "aspirin", "D34", "Acetyl", 0.9)], "col string, label string, id string, name string, score double"),
    )


CASES = [
    ("g", "Condition", "Healthy controls", "", "Healthy Control", "control"),
    ("g", "Tissue", "Biopsy", "", "Not Specified", "placeholder"),
    ("g", "Treatment", "without drug", "", "Not Specified", "negation"),
    ("g", "Tissue", " KIDNEY ", "D1", "Kidney", "group_exact"),
    ("g", "Tissue", "renal tissue", "D1", "Kidney", "group_morphology"),
    ("g", "Tissue", "lung", "D2", "Lung", "group_overlap"),
    ("g", "Condition", "asthma", "D9", "Asthma", "group_overlap"),
    (None, "Tissue", "hippocampus", "D4", "Hippocampal Formation", "history"),
    ("h", "Tissue", "HEPAR", "D5", "Liver", "vocabulary"),
    ("h", "Tissue", "Odd Organ", "ART-TI-00004", "odd organ", "minted"),
    ("h", "Tissue", "gastric sample", "D21", "Stomach", "candidates"),
    ("h", "Condition", "sole", "D32", "Sole Disease", "candidates"),
    ("h", "Treatment", "paclitaxel 10 nM 24 h", "D20", "Paclitaxel", "dose_stripped"),
    ("h", "Treatment", "aspirin 5 mg", "D33", "Aspirin", "dose_stripped"),
    ("h", "Tissue", "twice", "ART-TI-00005", "twice", "new"),
    ("h", "Tissue", "xylo", "ART-TI-00006", "xylo", "new"),
    ("h", "Condition", "Gout", "ART-CO-00001", "GOUT", "new"),
    ("k", "Condition", "GOUT", "ART-CO-00001", "GOUT", "new"),
]


def test_each_tier_answers_its_label(spark):
    rows = [c[:3] for c in CASES] * 2 + [("g", "Tissue", None), ("g", "Tissue", " "), ("g", "Tissue", "not specified")]
    got = sorted((tuple(r) for r in ca.resolve(spark.createDataFrame(rows, LABELS), knowledge(spark)).collect()), key=str)
    assert got == sorted(((g, c, label.strip(), *rest) for g, c, label, *rest in CASES), key=str)


def test_minting_again_adds_nothing(spark):
    known = knowledge(spark)
    labels = spark.createDataFrame([c[:3] for c in CASES], LABELS)
    one = ca.resolve(labels, known)
    known.minted = known.minted.unionByName(one.where("source = 'new'").select("col", "name", "id").distinct().toDF("col", "label", "id"))
    again = {(r.col, r.label.lower()): (r.id, r.source) for r in ca.resolve(labels, known).collect()}
    assert not any(s == "new" for _, s in again.values())
    assert all(again[r.col, r.label.lower()][0] == r.id for r in one.collect())


def test_without_knowledge_and_without_rows(spark):
    got = ca.direct_mint(spark.createDataFrame([("g", "Tissue", "b"), (None, "Tissue", "a"), ("g", "Tissue", "tumor")], LABELS), ca.Knowledge()).collect()
    assert sorted((r.label, r.id, r.source) for r in got) == [("a", "ART-TI-00001", "new"), ("b", "ART-TI-00002", "new")]
    assert ca.resolve(spark.createDataFrame([], LABELS), knowledge(spark)).count() == 0


def test_records_are_stacked_and_pivoted(spark):
    rows = [(1, "g", "kidney; liver", "ctrl", "paclitaxel 5 mg + Gout"), (2, None, None, "", "not specified"), (3, "g", "CD4+/CD8+", "wt", "a;b")]
    got = {r.id: r.asDict() for r in ca.resolve_records(spark.createDataFrame(rows, "id long, gse string, Tissue string, Condition string, Treatment string"), "id", "gse", knowledge(spark)).collect()}
    assert (got[1]["Tissue"], got[1]["Tissue_id"], got[1]["Tissue_source"]) == ("Kidney; Liver", "D1; D5", "group_exact; vocabulary")
    assert (got[1]["Condition"], got[1]["Treatment"], got[1]["Treatment_source"]) == ("Control", "Paclitaxel; Gout", "dose_stripped; new")
    assert {c: got[2][c] for c in ca.COLUMNS} == dict.fromkeys(ca.COLUMNS, "Not Specified") and got[2]["Tissue_id"] == ""
    assert got[3]["Tissue"] == "CD4+/CD8+" and got[3]["Treatment"] == "a; b"


def test_words(spark):
    row = spark.createDataFrame([("pulmonary tissue", "lung", "no asthma")], "a string, b string, c string").select(
        ca.nouns(ca.F.col("a")), ca.nouns(ca.F.col("b")), ca.word_set(ca.F.col("a")), ca.is_negated(ca.F.col("c")), ca.is_negated(ca.F.col("b"))
    ).head()
    assert tuple(row) == ("lung", None, ["pulmonary", "lung"], True, False)
