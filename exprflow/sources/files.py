"""Readers of expression files into the long format, by paths of any file system that Spark knows.

A line's place in its file is (start of its block, id within the partition): lines of a block are read in
order by one task, so both together order a file without a sort or a driver-side loop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# Texts that stand for a missing number, lower-cased.
MISSING_NUMBERS = ["", "na", "n/a", "nan", "null", "none", "#n/a", "<na>", "-nan"]
# Names of a sidecar's file and of its sample column, in order of preference.
SIDECAR_TAGS = [".meta", "_meta", ".metadata", "_metadata"]
SIDECAR_NAMES = ["metadata", "samples"]
SAMPLE_COLUMNS = ["sample", "GSM", "sample_id", "Sample", "id"]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, value) of each line of text files, plain or compressed; ``at`` orders the lines of a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``line`` (from 1) to ``lines``. What is summed up in order is one row for each block, not for each line."""
    kept = materialize(rows, "lines")
    blocks = kept.groupBy("file", F.col("at.block").alias("block")).agg(F.min("at.id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.col("first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = kept.withColumn("block", F.col("at.block")).join(starts, ["file", "block"])
    return joined.select("file", "at", "value", (F.col("base") + F.col("at.id") - F.col("first") + 1).alias("line"))


def number(text: Column) -> Column:
    """A text as a double; null where it isn't a finite number."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v), v)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    return next((f"{folder}/{n}" for n in names if exists(spark, f"{folder}/{n}")), None)


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that a file's first line holds most often: comma, tab, semicolon or bar; comma if none."""
    first = spark.read.text(path).first()
    head = first[0] if first else ""
    return max([",", "\t", ";", "|"], key=head.count)


def _table(spark: SparkSession, path: str, sep: str | None) -> tuple[DataFrame, list[str]]:
    raw = spark.read.csv(path, sep=sep or sniff(spark, path), header=True, inferSchema=False, enforceSchema=False)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns], at.alias("__at")), raw.columns


def read_counts_table(spark: SparkSession, path: str, sep: str | None = None, gene_col: int = 0) -> DataFrame:
    """(sample_id, gene, count) of a genes-by-samples table with a header.

    Columns whose every value is a number or missing are samples; if there are none, all are, and what isn't a
    number counts as missing. Missing is 0. The first row of a gene holds, picked by partial aggregation, so a
    gene with very many rows is no hot group. A gene without a name is ``nan``. An empty table gives no rows.
    """
    table, names = _table(spark, path, sep)
    gene, rest = names[gene_col], [c for k, c in enumerate(names) if k != gene_col]
    if not rest:
        return spark.createDataFrame([], "sample_id string, gene string, count double")

    def numeric(c: str) -> Column:
        text = F.col(f"`{c}`")
        return F.coalesce(F.every(text.isNull() | F.lower(F.trim(text)).isin(MISSING_NUMBERS) | number(text).isNotNull()), F.lit(True))

    checks = table.agg(*[numeric(c).alias(f"c{k}") for k, c in enumerate(rest)]).first()
    samples = [c for k, c in enumerate(rest) if checks[k]] or rest
    values = F.array(*[F.struct(F.lit(c).alias("sample_id"), F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)).alias("count")) for c in samples])
    firsts = table.groupBy(F.coalesce(F.col(f"`{gene}`"), F.lit("nan")).alias("gene")).agg(F.min_by(values, "__at").alias("values"))
    return firsts.select("gene", F.explode("values").alias("v")).select("v.sample_id", "gene", "v.count")


def read_mtx(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, gene, count) of a folder with matrix.mtx, features.tsv or genes.tsv, and barcodes.tsv, plain or gz.

    Only stored entries are rows: what is absent is 0. A matrix of cells by genes is turned round; other shapes are
    a ValueError, missing files a FileNotFoundError. Of features with one name the first holds. Entries of one
    cell and gene add up; cells with one barcode stay rows of their own. A matrix without values holds ones.
    """
    both = lambda *stems: [f"{s}{e}" for s in stems for e in (".gz", "")]
    matrix = first_existing(spark, folder, both("matrix.mtx"))
    features = first_existing(spark, folder, both("features.tsv", "genes.tsv"))
    barcodes = first_existing(spark, folder, both("barcodes.tsv"))
    if not (matrix and features and barcodes):
        raise FileNotFoundError(f"no matrix, features or barcodes in {folder}")
    rows = lines(spark, matrix)
    head = rows.agg(F.min_by("value", "at").alias("kind"), F.min(F.when(~_comment(), F.struct("at", "value"))).alias("dims")).first()
    kind = (head["kind"] or "").lower()
    if head["dims"] is None or "array" in kind:
        raise ValueError(f"{matrix} is not a coordinate matrix")
    n_rows, n_cols = (int(x) for x in head["dims"]["value"].split()[:2])
    names = lambda p, c: numbered(lines(spark, p)).select(F.col("line").alias(c), F.split("value", "\t")[0].alias("name"))
    genes, cells = names(features, "g"), names(barcodes, "c")
    shape = (genes.count(), cells.count())
    if (n_rows, n_cols) not in (shape, shape[::-1]):
        raise ValueError(f"a matrix of {n_rows} by {n_cols} fits neither {shape} nor its transpose")
    turned = (n_rows, n_cols) != shape
    at = head["dims"]["at"]
    parts = F.split(F.trim("value"), r"\s+")
    entry = rows.where(~_comment() & ~((F.col("at.block") == at["block"]) & (F.col("at.id") == at["id"]))).select(
        parts[1 if turned else 0].cast("long").alias("g"),
        parts[0 if turned else 1].cast("long").alias("c"),
        (F.lit(1.0) if "pattern" in kind else parts[2].cast("double")).alias("count"),
    )
    if "symmetric" in kind:
        entry = entry.unionByName(entry.where("g <> c").select(F.col("c").alias("g"), F.col("g").alias("c"), "count"))
    first = genes.groupBy(F.col("name").alias("gene")).agg(F.min("g").alias("g"))
    summed = entry.groupBy("g", "c").agg(F.sum("count").alias("count"))
    return summed.join(first, "g").join(cells.select("c", F.col("name").alias("sample_id")), "c").select("sample_id", "gene", "count")


def _comment() -> Column:
    return F.col("value").startswith("%") | (F.trim("value") == "")


def read_sidecar(spark: SparkSession, counts_path: str, samples: DataFrame) -> DataFrame | None:
    """Sample metadata beside a table of counts: each distinct sample_id of ``samples`` with the columns of the first
    sidecar there is, null for samples it lacks; None without one. Of several rows of a sample the first holds."""
    folder, _, name = counts_path.rpartition("/")
    stem = name.split(".")[0]
    bases = [f"{stem}{t}" for t in SIDECAR_TAGS] + SIDECAR_NAMES
    path = first_existing(spark, folder or ".", [f"{b}{e}" for b in bases for e in (".csv", ".tsv")])
    if path is None:
        return None
    table, names = _table(spark, path, "\t" if path.endswith(".tsv") else None)
    key = next((c for c in SAMPLE_COLUMNS if c in names), names[0])
    others = [F.col(f"`{c}`") for c in names if c != key]
    wanted = samples.select(F.col("sample_id").cast("string")).distinct()
    if not others:
        return wanted
    found = table.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min_by(F.struct(*others), "__at").alias("__row"))
    return wanted.join(found, F.col("sample_id") == F.col("__key"), "left").select("sample_id", "__row.*")


def load_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(counts, metadata or None) of a matrix folder, its matrix file, a Parquet table of the long format, or a text table."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if name.lower().startswith("matrix.mtx"):
        return read_mtx(spark, folder or "."), None
    if name.lower().endswith(".parquet"):
        return spark.read.parquet(path).select("sample_id", "gene", "count"), None
    if name.lower().endswith(".h5ad"):
        raise NotImplementedError("HDF5 needs a library that is not at hand; convert to Parquet (sample_id, gene, count)")
    if is_folder(spark, path):
        return read_mtx(spark, path.rstrip("/")), None
    counts = read_counts_table(spark, path)
    return counts, read_sidecar(spark, path, counts)


def read_series_matrices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, probe, sample_id, value) of the tables in series-matrix files; a value that isn't a number is null and stays.

    A table is what lies between the begin and the end mark, or the file's end; its first line names the samples.
    Fields beyond the header's are ignored, those a line lacks are null. Files without a table give no rows.
    Marks and headers are one row a file; only they are joined, so no file must fit into a group.
    """
    rows = lines(spark, path)
    begins, ends = F.col("value").startswith("!series_matrix_table_begin"), F.col("value").startswith("!series_matrix_table_end")
    marks = rows.where(begins | ends).groupBy("file").agg(F.min(F.when(begins, F.col("at"))).alias("begin"), F.collect_set(F.when(ends, F.col("at"))).alias("ends"))
    marks = marks.where("begin is not null").select("file", "begin", F.array_min(F.filter("ends", lambda e: e > F.col("begin"))).alias("end"))
    table = rows.join(marks, "file").where((F.col("at") > F.col("begin")) & (F.col("end").isNull() | (F.col("at") < F.col("end")))).select("file", "at", "value")
    heads = table.groupBy("file").agg(F.min(F.struct("at", "value")).alias("head")).select("file", F.col("head.at").alias("head_at"), _fields(F.col("head.value")).alias("names"))
    body = table.join(heads, "file").where(F.col("at") > F.col("head_at")).select("file", "names", _fields(F.col("value")).alias("parts"))
    cells = body.select("file", F.col("parts")[0].alias("probe"), F.posexplode(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0)))).alias("k", "sample_id"), "parts")
    return cells.select("file", "probe", "sample_id", number(F.try_element_at("parts", F.col("k") + 2)).alias("value"))


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, "\t"), lambda p: F.regexp_replace(p, '^"+|"+$', ""))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, label) of a vocabulary file: ``CLUSTER: name`` lines, each followed by indented ``- label`` lines.

    A total in brackets after a name and whatever follows a bar after a label are no part of them. Names in capitals
    get title case; labels below ``NOT SPECIFIED`` are left out. A vocabulary is one file that people keep by hand.
    """
    text = F.rtrim("value")
    name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, r"(?i)^\s*CLUSTER:(.*)$", 1)), r"(?i)\s*\(TOTAL:.*$", ""))
    named = F.when((name == F.upper(name)) & (F.length(name) > 1), F.initcap(F.lower(name))).otherwise(name)
    is_head = text.rlike(r"(?i)^\s*CLUSTER:")
    rows = lines(spark, path).select("file", "at", text.alias("text"), F.when(is_head, named).alias("head"))
    under = F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    label = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s*\|.*$", ""), r"^\s*-\s*", ""))
    placed = rows.select("head", under.alias("cluster"), "text", label.alias("label"))
    return placed.where(F.col("head").isNull() & F.col("text").rlike(r"^\s+-\s+") & (F.col("label") != "") & (F.upper("cluster") != "NOT SPECIFIED")).select("cluster", "label")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines checkpoint; lines that aren't whole JSON objects, as after a crash, are passed over."""
    bad = "__bad"
    raw = spark.read.schema(f"{schema}, {bad} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    return raw.where(F.col(bad).isNull()).drop(bad)


def series_of_file(file: Column) -> Column:
    """The series accession in a file's name, or null."""
    found = F.regexp_extract(file, re.escape("/") + r"?(GSE\d+)[^/]*$", 1)
    return F.when(found != "", found)
