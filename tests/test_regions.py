"""Platform readers, regions, contrasts and label checks on small cases."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from exprflow.operators import labels
from exprflow.operators import regions as rg
from exprflow.sources import files, platform, sinks


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_gene_column():
    assert platform.gene_column(["ID", "GB_ACC", "Gene Symbol", "NAME"]) == "Gene Symbol"
    assert platform.gene_column(["ID", "SPOT_symbol", "My gene name"]) == "My gene name"
    assert platform.gene_column(["ID", "x"]) is None
    assert platform.gene_column(["ID", "spot_id"]) == "spot_id"


def test_annotation(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("^PLATFORM\n!note\n#ID = x\nID\tgene_assignment\n1\tNM_1 // TP53 // tumour /// NM_2 // B\n1\tNM_1 // TP53 // other\n2\t---\n3\tEGFR\n4\n\tX\n")
    assert got(platform.read_annotation(spark, str(p))) == [("1", "TP53"), ("3", "EGFR")]
    t = spark.createDataFrame([("a", "X /// Y", "q"), ("b", " . ", "r"), ("c", None, None)], "probeid string, Symbol string, note string")
    assert got(platform.annotation(t)) == [("a", "X")]
    assert got(platform.annotation(t, "note")) == [("a", "q"), ("b", "r")]
    with pytest.raises(ValueError):
        platform.annotation(t.select("probeid", "note"))
    (tmp_path / "e.txt").write_text("#only\n")
    with pytest.raises(ValueError):
        platform.read_annotation(spark, str(tmp_path / "e.txt"))


def test_canonical_and_local_platform(spark, tmp_path):
    t = spark.createDataFrame([("A", 1.0, "x"), ("B", None, "2")], "gene string, ` gsm1` double, GSM2 string")
    series = spark.createDataFrame([("GSM1", "GSE9"), ("gsm1", "GSE2")], "sample_id string, series string")
    assert got(platform.canonical(t, "gene", series)) == [
        ("GSM1", "A", 1.0, "GSE2"), ("GSM1", "B", None, "GSE2"), ("GSM2", "A", None, None), ("GSM2", "B", 2.0, None),
    ]
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("TP53,Samples,EGFR\n1,s1,2\nNA,s2,3\n")
    assert got(platform.read_platform(spark, str(tmp_path / "p.csv.gz"), "gpl5")) == [
        ("GPL5", "s1", "EGFR", 2.0), ("GPL5", "s1", "TP53", 1.0), ("GPL5", "s2", "EGFR", 3.0), ("GPL5", "s2", "TP53", None),
    ]


def test_assemble(spark):
    s = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "gsm string")
    one = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("c", 1, "c"), (None, 1, "n")], "gsm string, at int, `my label` string")
    two = spark.createDataFrame([("b", "ai", 5)], "gsm string, `My Label` string, score int")
    out = rg.assemble(s, "gsm", (one, ["at"]), (two, ["score"]))
    assert out.columns == ["gsm", "at", "my label", "score"]
    assert got(out) == [("a", 1, "first", None), ("b", None, None, 5)]
    assert rg.assemble(s.limit(0), "gsm", (one, ["at"])).count() == 0


def test_groups_and_contrast(spark):
    r = spark.createDataFrame([("x", "1"), ("x", None), ("y", "1"), ("", "2"), ("NaN", "2")], "v string, w string")
    assert [x[0] for x in r.select(rg.compound_group({"v": "x", "w": "1"})).collect()] == ["v=x AND w=1", *["Other"] * 4]
    assert got(rg.default_contrast(r, "v")) == [("x", "y")]
    assert got(rg.default_contrast(r.where("v = 'y'"), "v")) == [("y", "y")]
    assert got(rg.default_contrast(r.limit(0), "v")) == [("case", "control")]


def test_denied_and_marks(spark):
    r = spark.createDataFrame([("smoker: no",), ("x = Negative",), ("smoker: now",), ("not specified: no",), ("no",), (None,)], "t string")
    assert [x[0] for x in r.select(rg.is_denied(F.col("t"))).collect()] == [True, True, False, False, False, False]
    m = spark.createDataFrame([("pre [[ ## a ## ]]\nx\ny [[ ## b ## ]] z",), ("plain ",), ("",), (None,)], "t string")
    assert [x[0] for x in m.select(rg.marked_section(F.col("t"), "a")).collect()] == ["x\ny", "plain", "", ""]
    assert [x[0] for x in m.select(rg.marked_section(F.col("t"), "c")).collect()] == ["pre", "plain", "", ""]


def test_rank_candidates(spark):
    r = spark.createDataFrame([("NK cells", "lung", 0.9), ("NK cells", "natural killer cell", 0.5), ("NK cells", None, 0.1)], "q string, c string, s double")
    # spelled out, the query has natural, killer, cells; a second "cells" counts once
    assert [(x.c, x.score, x["rank"]) for x in rg.rank_candidates(r, ["q"], "q", "c", "s").orderBy("rank").collect()] == [
        ("natural killer cell", 2.5 + 20 - 3 + 5, 1), (None, 0.5 + 5, 2), ("lung", 4.5 - 3 + 5 - 10, 3),
    ]


def test_converge(spark):
    rows = [("g", "tumor cells")] * 2 + [("g", "the tumor cell"), ("g", "tumor cell 24"), ("g", "tumor"), ("g", "normal cell"), ("g", "N/A"), (None, "a1"), ("", "A1")]
    out = {(r.s, r.label): (r.n, r.canonical) for r in rg.converge(spark.createDataFrame(rows, "s string, label string"), "s", "label").collect()}
    # "cell" and "tumor" are in four of five labels, so they tell nothing; numbers and "normal" do
    assert out == {
        ("g", "tumor cells"): (2, "tumor cells"), ("g", "the tumor cell"): (1, "tumor cells"), ("g", "tumor"): (1, "tumor cells"), ("g", "tumor cell 24"): (1, "tumor cell 24"),
        ("g", "normal cell"): (1, "normal cell"), ("", "a1"): (1, "A1"), ("", "A1"): (1, "A1"),
    }


def test_proposals_activity_sample(spark):
    p = spark.createDataFrame(
        [(" gsm1 ", "x", "liver tissue", None, "from  liver\n tissue"), ("GSM1", "x", "x", "from", "from"), ("GSM9", "x", "y", "y", "y"), ("GSM1", "x", "new", "seen", "seen"),
         ("GSM1", "x", "new", "", "other"), (None, "x", "y", "y", "y"), ("GSM1", "x", "y", "y", None)], "gsm string, current string, suggest string, quote string, source string",
    )
    s = spark.createDataFrame([("GSM1",), ("gsm1",), (None,)], "gsm string")
    assert got(rg.valid_proposals(p, s)) == [("GSM1", "x", "new", "seen"), ("gsm1", "x", "liver tissue", "")]
    a = spark.createDataFrame([("p", -3.0), ("q", 2.0), ("q", 4.0), ("r", None)], "source string, value double")
    assert [tuple(r) for r in rg.activity_ranking(a, "source", 5).collect()] == [("p", -3.0, 3.0), ("q", 3.0, 3.0)]
    ids = spark.range(1000)
    one, again, other = ({r.id for r in rg.capped(ids, "id", 50, k).collect()} for k in (1, 1, 2))
    assert one == again != other and len(one) == 50


def test_reports_and_checkpoint(spark, tmp_path):
    r = spark.createDataFrame([("a|b", 1.23456), (None, None)], "t string, v double")
    assert sinks.markdown_table(r.orderBy("t", ascending=False), 5) == "| t | v |\n| --- | --- |\n| a\\|b | 1.235 |\n|  |  |"
    for k in (1, 2):
        sinks.append_checkpoint(spark.createDataFrame([("GSE1", f"s{k}")], "gse string, gsm string"), str(tmp_path / "c"), "gse")
    assert got(files.read_checkpoint(spark, str(tmp_path / "c"), "gse string, gsm string").select("gse", "gsm")) == [("GSE1", "s1"), ("GSE1", "s2")]


def test_strip_dose(spark):
    cases = {
        "paclitaxel 10 nM 24 h": "paclitaxel", "cisplatin 5 µg/mL": "cisplatin", "metformin 100mg/kg": "metformin", "IL-12 (10 ng) + butyrate (0.5 mM)": "IL-12 + butyrate",
        "cisplatin": None, "LPS for 3 days": "LPS", "10-fold dilution": "dilution", "5x serum, 10%": "serum", "24 h": None, "5 genes": None, "": None, None: None,
    }
    r = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {x[0]: x[1] for x in r.select("t", labels.strip_dose(F.col("t"))).collect()} == cases


def test_split_and_budget(spark):
    r = spark.createDataFrame([("a + b;c; ",), (None,)], "t string")
    assert [x[0] for x in r.select(labels.split_composite(F.col("t"), True)).collect()] == [["a", "b", "c"], None]
    assert [x[0] for x in r.select(labels.split_composite(F.col("t"))).collect()] == [["a + b", "c"], None]
    t = spark.createDataFrame([("One. Two two! Three?",)], "t string")
    assert t.select(labels.sentence_budget(F.col("t"), 14)).first()[0] == "One. Two two!"
