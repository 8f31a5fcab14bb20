"""Tables in versions: readers see the old or the new one, never half of either.

A table is a folder of data folders and a log of versions. A version is one small JSON file that names the data folder of each part, and is
put in place whole, and only if no file of its number exists; so a writer that stops early leaves folders that no version names, and of two writers
that start from one version the second fails. A new version names the old folders of parts that it doesn't replace.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version."""


class SnapshotTable:
    """A table below ``path``, on any file system that Spark writes to; ``parts`` is how many parts rows are dealt to."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 1):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        """Numbers of the published versions, in order."""
        fs, path = self._at("_versions")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """(version, data folder by part) of a version, by default the newest; (0, {}) of a table without one."""
        known = self.versions()
        if not known:
            return 0, {}
        version = known[-1] if version is None else version
        row = self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).head()
        return version, json.loads(row.value)

    def commit(self, base: int, manifest: dict[str, str]) -> int:
        """Publish the successor of version ``base``; Conflict if there is one already."""
        text = json.dumps(manifest, sort_keys=True)
        fs, path = self._at(f"_versions/{base + 1:010d}.json")
        spare_fs, spare = self._at(f"_versions/.{uuid.uuid4().hex}")
        out = spare_fs.create(spare, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a link fails where its name is taken; Hadoop's local rename would replace it
                os.link(spare.toUri().getPath(), path.toUri().getPath())
            elif not fs.rename(spare, path):
                raise FileExistsError(str(path))
        except FileExistsError as e:
            raise Conflict(f"version {base + 1} of {self.path} is published already") from e
        finally:
            spare_fs.delete(spare, False)
        return base + 1

    def part_of(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("string")

    def write_parts(self, rows: DataFrame, part: Column) -> dict[str, str]:
        """Write rows to a new data folder, by part; the folders by part, which no reader sees until they are committed."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("_part", part).write.partitionBy("_part").parquet(folder)
        fs, path = self._at(f"data/{folder.rsplit('/', 1)[1]}")
        return {n.removeprefix("_part="): f"{folder}/{n}" for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("_part=")}

    def publish(self, rows: DataFrame, *keys: str) -> int:
        """Replace the whole table; rows are dealt to parts by their keys. The number of the version."""
        base, _ = self.manifest()
        return self.commit(base, self.write_parts(rows, self.part_of(*keys) if keys else F.lit("0")))

    def read(self, schema, version: int | None = None, parts: set[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts; a table without rows has ``schema`` too."""
        folders = [f for p, f in sorted(self.manifest(version)[1].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the newest ``keep``, and data that the kept ones don't name; only when no writer is at work. The number of folders that went."""
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v)[1].values()}
        for v in known[:-keep]:
            fs, path = self._at(f"_versions/{v:010d}.json")
            fs.delete(path, False)
        gone = 0
        fs, path = self._at("data")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            folder = f"{self.path}/data/{s.getPath().getName()}"
            if not any(f.startswith(f"{folder}/") for f in used):
                gone += bool(fs.delete(s.getPath(), True))
        return gone


# Labels of a condition that say that nothing was changed.
WILD_TYPES = ["wt", "wild-type", "wildtype", "wild type"]


def repaired_vocabulary(clusters: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A label vocabulary without its faults: clusters (id, col, label) and synonyms (cluster_id, synonym).

    Condition clusters that are named by a wild type go, with their synonyms; so do synonyms of no cluster, and those that differ
    from the label of their cluster in more than case. Null labels and synonyms are faults too.
    """
    wild = (F.col("col") == "Condition") & F.lower("label").isin(WILD_TYPES)
    kept = clusters.where(F.col("label").isNotNull() & ~F.coalesce(wild, F.lit(False)))
    named = kept.select(F.col("id").alias("cluster_id"), F.lower("label").alias("synonym_key")).distinct()
    fine = synonyms.withColumn("synonym_key", F.lower("synonym")).join(named, ["cluster_id", "synonym_key"], "left_semi")
    return kept, fine.select(*synonyms.columns)


def repair_vocabulary(spark: SparkSession, path: str, clusters: str, synonyms: str, resolutions: str) -> int:
    """Repair the vocabulary stored at ``path`` as the parts clusters, synonyms and resolutions of one SnapshotTable, and publish all three at once.

    Resolutions are emptied, as they may rest on what went. Running it again changes nothing but the number. The schemas are those of the parts.
    """
    table = SnapshotTable(spark, path)
    base, folders = table.manifest()
    old = {p: table.read(s, base, {p}) for p, s in (("clusters", clusters), ("synonyms", synonyms))} if base else {}
    if not old:
        raise ValueError(f"no vocabulary at {path}")
    kept, fine = repaired_vocabulary(old["clusters"], old["synonyms"])
    new = table.write_parts(kept, F.lit("clusters")) | table.write_parts(fine, F.lit("synonyms")) | table.write_parts(spark.createDataFrame([], resolutions), F.lit("resolutions"))
    return table.commit(base, new)
