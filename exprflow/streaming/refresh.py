"""Aggregates of groups that are kept fresh by a stream: only the groups that a batch touches are computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import same_keys
from ..sources.snapshots import SnapshotTable


class GroupRefresher:
    """Rows and the aggregates of their groups below ``path``, as two tables in versions that are dealt to parts by the group.

    A row is known by its keys and ``identity``, and the latest wins, by ``order`` and then by its content, so late and repeated rows change nothing twice. ``aggregate`` maps
    rows to one row for each group, the keys first. A batch rewrites the parts that its groups lie in: rows with the new ones merged, and of the
    aggregates only those of touched groups. Null keys are a group.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], identity: list[str], order: str, aggregate: Callable[[DataFrame], DataFrame], parts: int = 64):
        self.spark, self.schema, self.keys, self.identity, self.order, self.aggregate = spark, schema, keys, identity, order, aggregate
        self.rows = SnapshotTable(spark, f"{path}/rows", parts)
        self.groups = SnapshotTable(spark, f"{path}/groups", parts)
        self.group_schema = aggregate(spark.createDataFrame([], schema)).schema

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row for each identity."""
        columns = [F.col(c) for c in rows.columns]
        newest = Window.partitionBy(*self.keys, *self.identity).orderBy(F.desc_nulls_last(self.order), F.xxhash64(*columns))
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")

    def refresh(self, batch: DataFrame, batch_id: int | None = None) -> int:
        """Take in a batch; the number of groups computed. For ``foreachBatch``: a batch that runs again after a failure gives the same tables."""
        batch = batch.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = batch.select(*self.keys).distinct().withColumn("_part", self.rows.part_of(*self.keys)).persist()
        parts = {r._part for r in touched.select("_part").distinct().collect()}  # as many as the table has at most
        n = touched.count()
        if n:
            base, folders = self.rows.manifest()
            merged = self.latest(self.rows.read(self.schema, base, parts).unionByName(batch))
            new = self.rows.write_parts(merged, self.rows.part_of(*self.keys))
            self.rows.commit(base, folders | new)
            live = self.spark.read.schema(self.schema).parquet(*new.values())
            own = live.alias("l").join(touched.alias("r"), same_keys("l", "r", self.keys), "left_semi")
            base, folders = self.groups.manifest()
            kept = self.groups.read(self.group_schema, base, parts).alias("l").join(touched.alias("r"), same_keys("l", "r", self.keys), "left_anti")
            new = self.groups.write_parts(kept.unionByName(self.aggregate(own)), self.groups.part_of(*self.keys))
            self.groups.commit(base, folders | new)
        touched.unpersist()
        return n

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a query that refreshes with each batch of ``stream``."""
        query = stream.writeStream.foreachBatch(lambda df, i: self.refresh(df, i) and None).option("checkpointLocation", checkpoint)
        return (query.trigger(**trigger) if trigger else query).start()

    def current(self) -> DataFrame:
        """The aggregates of all groups."""
        return self.groups.read(self.group_schema)


def value_counts(keys: list[str], value: str, missing: str = "Not Specified") -> Callable[[DataFrame], DataFrame]:
    """An aggregate: rows, missing values and the number of each other value of a group, in order of the value."""

    def run(rows: DataFrame) -> DataFrame:
        v = F.coalesce(F.col(value), F.lit(missing))
        n = rows.groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
        dist = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_v") != missing, F.struct("_v", "_n")))))
        return n.groupBy(*keys).agg(F.sum("_n").alias("n_total"), F.sum(F.when(F.col("_v") == missing, F.col("_n")).otherwise(0)).alias("n_missing"), dist.alias("value_dist"))

    return run
