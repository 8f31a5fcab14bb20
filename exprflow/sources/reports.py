"""Records of a run: hashes of its inputs' contents, a manifest, and reports in Markdown."""

from __future__ import annotations

import json
import platform
import sys
from collections.abc import Iterable
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sinks import markdown_table

PACKAGES = ("pyspark", "pandas", "numpy", "pyarrow")


def content_hash(df: DataFrame) -> str:
    """16 hexadecimal digits that tell tables with other rows, columns or types apart, whatever the order of rows and of columns.

    Two sums of row hashes of different seeds, each kept to 64 bits, and the count, made in one pass; repeated rows count.
    """
    names = sorted(df.columns)
    # maps have no hash: their entries do, in order
    value = lambda c, t: F.array_sort(F.map_entries(F.col(f"`{c}`"))) if t.startswith("map") else F.col(f"`{c}`")
    types = dict(df.dtypes)
    row = [x for c in names for x in (value(c, types[c]).isNull(), value(c, types[c]))]
    wide = lambda seed: F.sum(F.xxhash64(*row, F.lit(seed)).cast("decimal(20,0)"))
    n, a, b = df.agg(F.count("*"), *[F.coalesce(wide(s), F.lit(0).cast("decimal(30,0)")).cast("string") for s in (1, 2)]).head()
    shape = json.dumps([n, a, b, [[c, types[c]] for c in names]])
    return df.sparkSession.range(1).select(F.substring(F.sha2(F.lit(shape), 256), 1, 16)).head()[0]


def build_manifest(tool: str, params: dict | None = None, inputs: dict[str, DataFrame] | None = None, seed: int | None = None, packages: Iterable[str] = PACKAGES) -> dict:
    """What is needed to run an analysis again: tool, timestamp, params, seed, hashes of the inputs, versions, environment; fit for JSON."""

    def version(name: str) -> str:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return "not installed"

    return {
        "tool": tool,
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "params": json.loads(json.dumps(params or {}, default=str)),
        "seed": seed,
        "data_hashes": {name: content_hash(df) for name, df in (inputs or {}).items()},
        "versions": {p: version(p) for p in packages},
        "environment": {"python": sys.version.split()[0], "platform": platform.platform()},
    }


def write_manifest_json(spark, manifest: dict, path: str) -> None:
    """A manifest as a JSON row in a folder, on any file system that Spark writes to."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest_markdown(manifest: dict) -> str:
    """A manifest as a block for a report; empty parts and packages that aren't installed are left out."""
    lines = ["### Reproducibility", f"- **tool**: `{manifest['tool']}`", f"- **timestamp**: {manifest['timestamp']}", f"- **seed**: {manifest['seed']}"]
    if manifest["params"]:
        lines.append(f"- **params**: `{json.dumps(manifest['params'], sort_keys=True)}`")
    if manifest["data_hashes"]:
        lines.append("- **data hashes**: " + ", ".join(f"{k}=`{v}`" for k, v in manifest["data_hashes"].items()))
    shown = [f"{k} {v}" for k, v in manifest["versions"].items() if v != "not installed"]
    if shown:
        lines.append("- **versions**: " + ", ".join(shown))
    lines.append(f"- **python**: {manifest['environment']['python']} ({manifest['environment']['platform']})")
    return "\n".join(lines)


def report(title: str, *sections: tuple[str, DataFrame | str | None], top: int = 15, manifest: dict | None = None) -> str:
    """A Markdown report: a title, and for each section its heading and text or the first ``top`` rows of its table; "No results." without rows. Tables come sorted by whoever
    asks for them; only ``top`` rows reach the driver."""
    lines = [f"# {title}", ""]
    for heading, body in sections:
        text = markdown_table(body, top) if isinstance(body, DataFrame) else body
        if not text or (isinstance(body, DataFrame) and text.count("\n") == 1):  # a header without rows
            text = "_No results._"
        lines += [f"## {heading}", text, ""]
    return "\n".join(lines + ([manifest_markdown(manifest), ""] if manifest else []))


def enrichment_report(comparison: str, over: DataFrame | None, ranked: DataFrame | None, top: int = 15, manifest: dict | None = None) -> str:
    """Over-representation (by q_value) and ranked sets (by q_value) of a comparison."""
    order = lambda df: df.orderBy("q_value", df.columns[0]) if df is not None else None
    return report(f"Enrichment report: {comparison}", ("Over-representation", order(over)), ("Ranked gene sets", order(ranked)), top=top, manifest=manifest)
