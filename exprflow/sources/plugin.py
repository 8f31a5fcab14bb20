"""Sources of expression data as plug-ins: subclasses become formats of ``spark.read``, with filters on genes handed down.

A source says what it holds in parts and yields one part's rows for the genes that are asked for; everything else is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

SCHEMA = "sample_id string, series_id string, gene string, value double"
ARROW = pa.schema([("sample_id", pa.string()), ("series_id", pa.string()), ("gene", pa.string()), ("value", pa.float64())])


@dataclass(frozen=True)
class SourceInfo:
    name: str
    technology: str
    species: str = "human"
    description: str = ""


@dataclass
class Part(InputPartition):
    """What one task reads: a name that the source understands."""

    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ExpressionSource(DataSource):
    """A source in the long format (sample_id, series_id, gene, value). Subclasses set ``info`` and define ``parts`` and ``fetch``."""

    info = SourceInfo("base", "unknown")

    @classmethod
    def name(cls) -> str:
        return cls.info.name

    def schema(self) -> str:
        return SCHEMA

    def parts(self) -> list[str]:
        """Names of the pieces that are read by a task each."""
        raise NotImplementedError

    def fetch(self, part: str, genes: set[str] | None) -> Iterator[pa.RecordBatch]:
        """Batches of one part, of the named genes or of all; columns in any order, series_id optional."""
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: ExpressionSource):
        self.source, self.genes = source, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes equality and membership on gene; hands all others back to Spark."""
        for f in filters:
            wanted = None
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("gene",) and f.value is not None:
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("gene",):
                wanted = {v for v in f.value if v is not None}
            if wanted is None:
                yield f
            else:
                self.genes = wanted if self.genes is None else self.genes & wanted

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.source.parts()]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for a source without parts
            return
        for batch in self.source.fetch(partition.name, self.genes):
            n = batch.num_rows
            columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(n, f.type) for f in ARROW]
            out = pa.RecordBatch.from_arrays(columns, schema=ARROW)
            # a source that doesn't look at ``genes`` is right too
            yield out if self.genes is None else out.filter(pa.compute.is_in(out.column("gene"), pa.array(sorted(self.genes), pa.string())))


def register(spark: SparkSession, *sources: type[ExpressionSource]) -> None:
    """Make sources formats of ``spark.read``, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)


class WideMatrices(ExpressionSource):
    """Parquet files of samples by genes, a column ``GSM``, optionally ``series_id``, and one for each gene: only the columns asked for are read.

    Options: ``paths``, separated by commas, as URIs that Arrow opens from every executor (hdfs, s3, gs, or a mounted path); ``rows`` in a batch.
    """

    info = SourceInfo("wide_matrices", "any", description="Parquet matrices of samples by genes")

    def parts(self) -> list[str]:
        return [p for p in self.options.get("paths", "").split(",") if p]

    def fetch(self, part: str, genes: set[str] | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(part)
        with pq.ParquetFile(path, filesystem=where) as f:
            names = f.schema_arrow.names
            own = [n for n in names if n not in ("GSM", "series_id") and (genes is None or n in genes)]
            meta = [n for n in ("GSM", "series_id") if n in names]
            for batch in f.iter_batches(int(self.options.get("rows", 1000)), columns=[*meta, *own]):
                for gene in own:
                    columns = [batch.column("GSM").cast(pa.string()), pa.array([gene] * batch.num_rows), batch.column(gene).cast(pa.float64())]
                    series = [batch.column("series_id").cast(pa.string())] if "series_id" in meta else []
                    yield pa.RecordBatch.from_arrays([*columns, *series], names=["sample_id", "gene", "value", *(["series_id"] if series else [])])


def canonical(rows: DataFrame) -> DataFrame:
    """Sample ids without blanks at the ends and in capitals, as all tables of samples name them; other columns as they are."""
    return rows.withColumn("sample_id", F.upper(F.trim("sample_id")))
