"""Platforms: annotation of probes by genes, and local matrices in the long form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import stripped
from .files import _fields, lines, number, sniff

# Names of a gene column, the better ones first; words that tell one otherwise.
GENE_COLUMNS = [
    r"Gene[\s_.]?Symbol", "Symbol", "GENE_SYMBOL", "ILMN_Gene", "GeneName", "gene_assignment", "ORF", "GENE_NAME", r"Gene\.Symbol", "gene_symbol",
    "GeneSymbol", r"Associated[\s_.]Gene[\s_.]Name", "GENE", "gene", "Gene_Name", "NAME", r"Reporter[\s_]Name", "SystematicName", "SPOT_ID",
]
GENE_WORDS = ["symbol", "gene_name", "genename", "gene.symbol"]
# Names of a probe column and of a sample column, in capitals.
PROBE_COLUMNS = ["ID", "PROBE_ID", "PROBEID"]
MATRIX_SAMPLE_COLUMNS = ["GSM", "SAMPLE", "SAMPLES"]
# Symbols that name no gene.
NO_SYMBOL = ["", "nan", "NaN", "NA", "N/A", "n/a", "--", "---", "null", "NULL", "none", "None", ".", "undefined"]


def gene_column(names: list[str]) -> str | None:
    """The column that holds gene symbols by its name, or None."""
    named = [c for p in GENE_COLUMNS for c in names if re.fullmatch(p, c, re.IGNORECASE)]
    hinted = [c for c in names if "spot" not in c.lower() and any(w in c.lower().replace(" ", "_") for w in GENE_WORDS)]
    return next(iter(named + hinted), None)


def probe_column(names: list[str]) -> str:
    """The column of probe ids by its name, else the first."""
    return "ID" if "ID" in names else next((c for c in names if c.upper() in PROBE_COLUMNS), names[0])


def symbol(text: Column, assignment: bool = False) -> Column:
    """The first symbol of ``A /// B``, of an assignment ``accession // symbol // ...`` its second field; null if it names no gene."""
    first = stripped(F.split(text, "///")[0])
    if assignment:
        parts = F.split(first, "//")
        first = stripped(F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]))
    return F.when(~first.isin(NO_SYMBOL), first)


def annotation(table: DataFrame, gene: str | None = None) -> DataFrame:
    """Distinct (probe_id, gene) of an annotation table. The gene column is ``gene`` if the table has it, else found by name; none is a
    ValueError. Rows without a probe id or a symbol are left out; a probe may have several genes."""
    column = gene if gene in table.columns else gene_column(table.columns)
    if column is None:
        raise ValueError(f"no gene column among {table.columns}")
    cleaned = symbol(F.col(f"`{column}`").cast("string"), column.lower() == "gene_assignment")
    rows = table.select(stripped(F.col(f"`{probe_column(table.columns)}`").cast("string")).alias("probe_id"), cleaned.alias("gene"))
    return rows.where("probe_id <> '' and gene is not null").distinct()


def read_annotation(spark: SparkSession, path: str, gene: str | None = None) -> DataFrame:
    """``annotation`` of a tab-separated file; lines that begin with #, ! or ^ are notes. The header is the first other line;
    an empty file is a ValueError."""
    rows = lines(spark, path).where(~F.col("value").rlike("^[#!^]") & (F.trim("value") != ""))
    head = rows.agg(F.min(F.struct("at", "value"))).first()[0]
    if head is None:
        raise ValueError(f"no table in {path}")
    names = [n.strip().strip('"') for n in head.value.split("\t")]
    body = rows.where((F.col("at.block") != head.at.block) | (F.col("at.id") != head.at.id)).select(_fields(F.col("value")).alias("parts"))
    return annotation(body.select(*[F.try_element_at("parts", F.lit(k + 1)).alias(n) for k, n in enumerate(names)]), gene)


def _long(table: DataFrame, key: str, names: list[str], name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias(name), number(F.col(f"`{c}`").cast("string")).alias("value")) for c in names])
    return table.select(F.col(f"`{key}`").cast("string").alias("key"), F.explode(cells).alias("c")).select("key", f"c.{name}", "c.value")


def canonical(table: DataFrame, gene: str, series: DataFrame | None = None) -> DataFrame:
    """(sample_id, gene, value, series) of a genes-by-samples table: sample ids trimmed and in capitals, and the series of ``series``
    (sample_id, series), the smallest if a sample has several; null without one."""
    names = [c for c in table.columns if c != gene]
    rows = _long(table, gene, names, "sample_id").select(F.upper(F.trim("sample_id")).alias("sample_id"), F.col("key").alias("gene"), "value")
    if series is None:
        return rows.withColumn("series", F.lit(None).cast("string"))
    return rows.join(series.groupBy(F.upper(F.trim("sample_id")).alias("sample_id")).agg(F.min("series").alias("series")), "sample_id", "left")


def read_platform(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """(platform, sample_id, gene, value) of a local samples-by-genes file, plain or gz. The sample column is GSM, else one called so or
    like a sample in any case, else the first; values that aren't numbers are null."""
    table = spark.read.csv(path, sep=sniff(spark, path), header=True, inferSchema=False)
    names = table.columns
    key = "GSM" if "GSM" in names else next((c for c in names if c.strip().upper() in MATRIX_SAMPLE_COLUMNS), names[0])
    rows = _long(table, key, [c for c in names if c != key], "gene")
    return rows.select(F.lit(platform.upper()).alias("platform"), F.col("key").alias("sample_id"), "gene", "value")


# Patterns of kinds of measurement, looked for in a platform's technology and title.
SINGLE_CELL = [
    r"\bsingle[\s\-]?cell\b", r"\bsc[\-_]?rna[\-_]?seq\b", r"\bsn[\-_]?rna[\-_]?seq\b", r"\bsingle[\s\-]?nucle(us|i)\b", r"\b10x\s*genomics\b", r"\bchromium\b", r"\bdrop[\s\-]?seq\b",
    r"\bsmart[\s\-]?seq2?\b", r"\bcel[\s\-]?seq2?\b", r"\bmars[\s\-]?seq\b", r"\bindrop(s|seq)?\b", r"\bbd\s*rhapsody\b", r"\bfluidigm\s*c1\b", r"\bparse\s*biosciences?\b", r"\bsplit[\s\-]?seq\b",
]
METHYLATION = [r"methylation", r"\bbisulfite\b", r"\binfinium\b", r"\bepic\b", r"\b450k?\b", r"\b850k?\b", r"\bmeth[\s\-]?seq\b", r"\brrbs\b", r"\bwgbs\b"]
BULK_RNA = [
    r"\brna[\s\-]?seq\b", r"\btranscriptom", r"\bmrna\b", r"\btotal\s+rna\b", r"\billumina\s+(hi|nova|next)seq", r"\billumina\s+genome\s+analyzer", r"\bion\s+torrent\b", r"\bab\s+solid\b",
    r"\bbgiseq\b", r"\bpacbio\b", r"\boxford\s+nanopore\b",
]
OTHER_SEQUENCING = [r"\bchip[\s\-]?seq\b", r"\batac[\s\-]?seq\b", r"\bdnase[\s\-]?seq\b", r"\bcut\s*&?\s*run\b", r"\bcut\s*&?\s*tag\b", r"\bhi[\s\-]?c\b", r"\bmnase\b", r"\bribo[\s\-]?seq\b"]


def technology(kind: Column, title: Column) -> Column:
    """The class of a platform by its technology and its title, which may be null: single-cell and methylation before all; of sequencing, SAGE and MPSS, assays of chromatin
    before bulk-rna-seq, as they run on the same machines, and sequencing-other for the rest; microarray; then what the title alone tells, or other."""
    tech, name = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (kind, title))
    both = F.concat(tech, F.lit(" "), name)
    any_ = lambda patterns: both.rlike("|".join(patterns))
    sequenced = F.contains(tech, F.lit("sequencing")) | tech.isin("sage", "mpss")
    array = tech.rlike("oligonucleotide|spotted|cdna|array|bead")
    return (
        F.when(any_(SINGLE_CELL), "single-cell").when(any_(METHYLATION), "methylation").when(sequenced & ~any_(OTHER_SEQUENCING) & any_(BULK_RNA), "bulk-rna-seq").when(sequenced, "sequencing-other")
        .when(array, "microarray").when(any_(BULK_RNA), "bulk-rna-seq").when(any_(OTHER_SEQUENCING), "sequencing-other").otherwise("other")
    )


def match_platform(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, name): for each asked text the platform (name) that is meant: equal, equal in any case, one that holds or is held by it, or else the first; ties in order of the name.

    Both tables are catalogues of names; the smaller is repeated to the larger. Without platforms there are no rows, a null or empty text means the first.
    """
    text = F.trim(F.coalesce("asked", F.lit("")))
    low, own = F.lower(text), F.lower("name")
    part = (low != "") & (F.contains(own, low) | F.contains(low, own))
    tier = F.when(F.col("name") == text, 0).when(own == low, 1).when(part, 2).otherwise(3)
    met = asked.select("asked").distinct().crossJoin(F.broadcast(names.select("name").where("name is not null").distinct()))  # platforms of a catalogue: some ten thousand at most
    return met.groupBy("asked").agg(F.min(F.struct(tier.alias("tier"), F.col("name"))).alias("b")).select("asked", "b.name")
