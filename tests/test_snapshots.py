"""Tables in versions, groups kept fresh by a stream, stages that stop, and source plug-ins."""

from __future__ import annotations

import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from exprflow.sources import plugin
from exprflow.sources.snapshots import Conflict, SnapshotTable, repair_vocabulary
from exprflow.streaming import health, refresh

SCHEMA = "k string, v long"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_readers_see_whole_versions(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", 4)
    assert table.read(SCHEMA).count() == 0 and table.versions() == []
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], SCHEMA)
    assert table.publish(one, "k") == 1
    reader = table.read(SCHEMA)
    # a writer that stops before it commits, and one that fails while it writes
    table.write_parts(one.withColumn("v", F.lit(9)), table.part_of("k"))
    with pytest.raises(Exception, match="stop"):
        table.publish(one.withColumn("v", F.raise_error(F.lit("stop")).cast("long")), "k")
    assert got(table.read(SCHEMA)) == got(one) and table.versions() == [1]
    # an old reader keeps its version while a new one is published
    assert table.publish(one.where("k = 'a'"), "k") == 2
    assert got(reader) == got(one) and got(table.read(SCHEMA)) == [("a", 1)] and got(table.read(SCHEMA, 1)) == got(one)
    with pytest.raises(Conflict):
        table.commit(1, {})
    assert table.vacuum(1) == 3 and table.versions() == [2] and got(table.read(SCHEMA)) == [("a", 1)]


def test_of_writers_at_once_one_wins(spark, tmp_path):
    table, won, lost = SnapshotTable(spark, f"file://{tmp_path}/t"), [], []

    def write(i):
        try:
            won.append(table.commit(0, {"0": f"folder{i}"}))
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == [1] and len(lost) == 5


def test_vocabulary_repair(spark, tmp_path):
    schemas = ("id string, col string, label string", "cluster_id string, synonym string", "label string, id string")
    clusters = [("1", "Condition", "Wild-Type"), ("2", "Condition", "tumor"), ("3", "Tissue", "wt"), ("4", "Tissue", None)]
    synonyms = [("1", "wild-type"), ("2", "TUMOR"), ("2", "lung"), ("9", "tumor"), ("3", "WT"), ("2", None), ("4", "x")]
    table = SnapshotTable(spark, f"file://{tmp_path}/v")
    with pytest.raises(ValueError):
        repair_vocabulary(spark, table.path, *schemas)
    parts = {}
    for name, rows, schema in zip(("clusters", "synonyms", "resolutions"), (clusters, synonyms, [("a", "1")]), schemas, strict=True):
        parts |= table.write_parts(spark.createDataFrame(rows, schema), F.lit(name))
    table.commit(0, parts)
    for version in (2, 3):
        assert repair_vocabulary(spark, table.path, *schemas) == version
        assert got(table.read(schemas[0], parts={"clusters"})) == [("2", "Condition", "tumor"), ("3", "Tissue", "wt")]
        assert got(table.read(schemas[1], parts={"synonyms"})) == [("2", "TUMOR"), ("3", "WT")]
        assert table.read(schemas[2], parts={"resolutions"}).count() == 0
    assert table.read(schemas[2], 1, {"resolutions"}).count() == 1


ROWS = "series string, field string, sample string, value string, at long"


def test_refresh_equals_a_batch_aggregation(spark, tmp_path):
    batches = [
        [("s1", "tissue", "a", "liver", 5), ("s1", "tissue", "b", None, 1), (None, "tissue", "c", "lung", 1), ("s2", "age", "a", "5", 1)],
        [("s1", "tissue", "a", "older", 4), ("s1", "tissue", "b", "liver", 2), ("s1", "tissue", "b", "liver", 2), (None, "tissue", "d", "lung", 1)],
        [("s3", None, "x", "y", 1), (None, "tissue", "c", None, 9)],
    ]
    aggregate = refresh.value_counts(["series", "field"], "value")
    made = lambda: refresh.GroupRefresher(spark, f"file://{tmp_path}/g", ROWS, ["series", "field"], ["sample"], "at", aggregate, parts=8)
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(str(source))
        made().start(spark.readStream.schema(ROWS).json(str(source)), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
        seen = [r for b in batches[: i + 1] for r in b]
        want = aggregate(made().latest(spark.createDataFrame(seen, ROWS)))
        assert got(made().current()) == got(want)
    state = {(r.series, r.field): (r.n_total, r.n_missing, r.value_dist) for r in made().current().collect()}
    assert state[("s1", "tissue")] == (2, 0, {"liver": 2}) and state[(None, "tissue")] == (2, 1, {"lung": 1}) and len(state) == 4
    before = made().groups.manifest()[1]
    assert made().refresh(spark.createDataFrame(batches[2], ROWS)) == 2  # a batch that runs again
    after = made().groups.manifest()[1]
    assert got(made().current()) == got(want) and 0 < sum(before[p] != after[p] for p in before) < len(before)
    assert made().refresh(spark.createDataFrame([], ROWS)) == 0


def test_a_stage_with_too_many_failures_stops(spark):
    rows = spark.range(100)
    assert health.guarded(rows, F.col("id") < 25, "fine").count() == 100
    with pytest.raises(health.TooManyFailures, match="26 of 100 rows"):
        health.guarded(rows, F.col("id") < 26, "bad")
    assert health.guarded(rows.limit(0), F.lit(True), "empty").count() == 0
    assert health.guarded(rows, F.when(F.col("id") < 50, F.lit(None).cast("boolean")).otherwise(False), "nulls").count() == 100


class Counting(plugin.ExpressionSource):
    """Says in its values which genes it was asked for."""

    info = plugin.SourceInfo("counting", "rna_seq")

    def parts(self):
        return ["p1", "p2"]

    def fetch(self, part, genes):
        asked = float(len(genes)) if genes is not None else -1.0
        yield pa.RecordBatch.from_pydict({"value": [asked, asked], "gene": ["TP53", "BRCA1"], "sample_id": [f"{part} ", part]})


def test_plug_in_sources_get_the_genes_that_are_asked_for(spark, tmp_path):
    plugin.register(spark, Counting, plugin.WideMatrices)
    df = spark.read.format("counting").load()
    assert df.columns == ["sample_id", "series_id", "gene", "value"] and df.rdd.getNumPartitions() == 2 and {r.value for r in df.collect()} == {-1.0}
    assert got(df.where("gene = 'TP53'").select("gene", "value", "series_id")) == [("TP53", 1.0, None)] * 2
    assert {r.value for r in df.where("gene in ('TP53', 'BRCA1', 'X') and value > 0").collect()} == {3.0}
    assert got(plugin.canonical(df.where("gene = 'BRCA1'")).select("sample_id")) == [("P1",), ("P1",)] or {r.sample_id for r in plugin.canonical(df).collect()} == {"P1", "P2"}
    for i in range(2):
        pq.write_table(pa.table({"GSM": [f"GSM{i}", "GSM9"], "series_id": ["GSE1", None], "GeneA": [1.0 + i, 2.0], "GeneB": pa.array([3, None], pa.int64())}), tmp_path / f"{i}.parquet")
    wide = spark.read.format("wide_matrices").option("paths", ",".join(f"file://{tmp_path}/{i}.parquet" for i in range(2))).load()
    assert wide.count() == 8 and got(wide.where("gene = 'GeneB' and value is not null").select("sample_id", "value")) == [("GSM0", 3.0), ("GSM1", 3.0)]
    assert got(wide.where("gene = 'GeneA' and sample_id = 'GSM1'")) == [("GSM1", "GSE1", "GeneA", 2.0)]
    assert spark.read.format("wide_matrices").load().count() == 0
