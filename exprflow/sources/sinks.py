"""Writers of expression tables and of their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_long(expr: DataFrame, path: str) -> None:
    """The canonical store: Parquet of the long format, a folder for each platform, sorted by gene so that a gene's
    slice is pruned by row-group statistics. Replaces what is there."""
    expr.sortWithinPartitions("platform", "gene", "sample_id").write.mode("overwrite").partitionBy("platform").parquet(path)


def write_wide(expr: DataFrame, path: str, genes: list[str]) -> None:
    """A csv.gz export of stated genes, a row for each sample; missing values are empty."""
    wide = expr.groupBy("sample_id").pivot("gene", genes).agg(F.first("value", ignorenulls=True))
    wide.write.mode("overwrite").csv(path, header=True, compression="gzip", nullValue="")


def write_manifest(expr: DataFrame, path: str, **provenance: str) -> None:
    """One JSON row beside a table: counts of rows, samples, genes and missing values, and the given provenance."""
    facts = expr.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("gene").alias("n_genes"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    facts.select("*", *[F.lit(v).alias(k) for k, v in sorted(provenance.items())]).write.mode("overwrite").json(path)


def append_checkpoint(rows: DataFrame, path: str, by: str) -> None:
    """Add rows to a JSON-lines checkpoint with a folder for each value of ``by``; a job that fails leaves no half-written files to readers."""
    rows.write.mode("append").partitionBy(by).json(path)


def markdown_table(rows: DataFrame, n: int) -> str:
    """The first ``n`` rows as a Markdown table for a report; doubles have four digits, bars in texts are escaped, a null is empty."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " ")
    body = [[show(v) for v in r] for r in rows.limit(n).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *body])
