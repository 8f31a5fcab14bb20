"""Readers and writers on small files, and the streaming bus."""

from __future__ import annotations

import gzip
import json

import pytest

from exprflow.sources import files, sinks
from exprflow.streaming import bus


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_table(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("gene,s.1,note,s2\nA,1,x,NA\nB,2,y,3\nA,9,z,9\n")
    want = [("s.1", "A", 1.0), ("s.1", "B", 2.0), ("s2", "A", 0.0), ("s2", "B", 3.0)]
    assert got(files.read_counts_table(spark, str(p))) == want
    (tmp_path / "t.tsv").write_text("gene\ta\nA\tx\n")
    assert got(files.read_counts_table(spark, str(tmp_path / "t.tsv"))) == [("a", "A", 0.0)]
    (tmp_path / "e.csv").write_text("gene,a\n")
    assert got(files.read_counts_table(spark, str(tmp_path / "e.csv"))) == []


def test_sidecar(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("gene,s1,s2\nA,1,2\n")
    counts, none = files.load_counts(spark, str(p))
    assert none is None
    (tmp_path / "c_meta.tsv").write_text("x\tGSM\nu\ts1\nv\ts1\nw\tother\n")
    counts, meta = files.load_counts(spark, str(p))
    assert got(meta) == [("s1", "u"), ("s2", None)]


@pytest.mark.parametrize("turned", [False, True])
def test_mtx(spark, tmp_path, turned):
    entries = [(1, 1, 5), (3, 1, 7), (2, 2, 1), (2, 2, 2)]
    dims = "2 3 4" if turned else "3 2 4"
    body = "".join(f"{j if turned else i} {i if turned else j} {v}\n" for i, j, v in entries)
    with gzip.open(tmp_path / "matrix.mtx.gz", "wt") as f:
        f.write(f"%%MatrixMarket matrix coordinate integer general\n%\n{dims}\n{body}")
    (tmp_path / "genes.tsv").write_text("A\ta\nB\tb\nA\tc\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\n")
    assert got(files.load_counts(spark, str(tmp_path))[0]) == [("x", "A", 5.0), ("y", "B", 3.0)]
    (tmp_path / "barcodes.tsv").write_text("x\n")
    with pytest.raises(ValueError):
        files.read_mtx(spark, str(tmp_path))


def test_numbered_lines_over_blocks(spark, tmp_path):
    p = tmp_path / "n.txt"
    p.write_text("".join(f"{i}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.numbered(files.lines(spark, str(p))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000 and all(int(r.value) == r.line for r in rows)


def test_series_matrices(spark, tmp_path):
    (tmp_path / "GSE1_series.txt").write_text(
        '!Title\tx\n!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\n"p1"\t1.5\tnull\n"p2"\t2\n!series_matrix_table_end\n"p3"\t1\t1\n'
    )
    (tmp_path / "GSE2_series.txt").write_text("!Title\tno table\n")
    df = files.read_series_matrices(spark, str(tmp_path))
    df = df.select(files.series_of_file(df["file"]), "probe", "sample_id", "value")
    assert set(got_nulls(df)) == {("GSE1", "p1", "GSM1", 1.5), ("GSE1", "p1", "GSM2", None), ("GSE1", "p2", "GSM1", 2.0), ("GSE1", "p2", "GSM2", None)}


def got_nulls(df):
    return [tuple(r) for r in df.collect()]


def test_clusters_and_checkpoint(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("CLUSTER: BREAST CANCER (TOTAL: 3)\n  - breast ca | n=2\n  - Brca\nCLUSTER: NOT SPECIFIED\n  - none\ncluster: Lung\n  - lung\n")
    assert got(files.read_clusters(spark, str(p))) == [("Breast Cancer", "Brca"), ("Breast Cancer", "breast ca"), ("Lung", "lung")]
    c = tmp_path / "c.jsonl"
    c.write_text('{"gsm": "a", "n": 1}\n{"gsm": "b", \n{"gsm": "c"}\n')
    assert set(got_nulls(files.read_checkpoint(spark, str(c), "gsm string, n long"))) == {("a", 1), ("c", None)}


def test_sinks(spark, tmp_path):
    rows = [("P", "s1", "A", 1.0), ("P", "s1", "B", None), ("Q", "s2", "A", 2.0)]
    df = spark.createDataFrame(rows, "platform string, sample_id string, gene string, value double")
    sinks.write_long(df, str(tmp_path / "long"))
    back = spark.read.parquet(str(tmp_path / "long")).select(df.columns)
    assert set(got_nulls(back)) == set(rows)
    sinks.write_wide(df, str(tmp_path / "wide"), ["A", "B"])
    assert set(got_nulls(spark.read.csv(str(tmp_path / "wide"), header=True))) == {("s1", "1.0", None), ("s2", "2.0", None)}
    sinks.write_manifest(df, str(tmp_path / "m"), source="test")
    text = "".join(f.read_text() for f in (tmp_path / "m").glob("*.json"))
    assert json.loads(text) == {"n_rows": 3, "n_samples": 2, "n_genes": 2, "n_missing": 1, "source": "test"}


def test_bus_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    posts = ['{"recipient": "r", "message_id": "1", "kind": "post"}', '{"recipient": "r", "message_id": "1", "kind": "nack"}', '{"recipient": "r", "message_id": "2", "kind": "post"}']
    (src / "a.json").write_text("\n".join(posts))
    def run():
        stream = bus.deliver(spark.readStream.schema("recipient string, message_id string, kind string").json(str(src)))
        sink = lambda df, _: seen.extend(tuple(r) for r in df.collect())
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    seen: list = []
    run()
    assert seen == [("r", 2, 2)]
    (src / "b.json").write_text('{"recipient": "r", "message_id": "1", "kind": "ack"}')
    run()
    assert seen[-1] == ("r", 1, 1)
