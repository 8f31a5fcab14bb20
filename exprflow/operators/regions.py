"""Regions of samples with their labels, contrasts between groups of them, and checks of proposed labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import is_missing, stripped

# Abbreviations of cells and places, and words that tell a cell type or an organ.
ABBREVIATIONS = {
    "nk": "natural killer cells", "pbmc": "peripheral blood mononuclear cell", "bm": "bone marrow", "sc": "spinal cord", "cns": "central nervous system",
    "dc": "dendritic cells", "treg": "regulatory t cell", "hspc": "hematopoietic stem progenitor cell", "msc": "mesenchymal stem cell",
    "ipsc": "induced pluripotent stem cell", "esc": "embryonic stem cell",
}
CELL_WORDS = [
    "cell", "cells", "macrophage", "monocyte", "lymphocyte", "neutrophil", "nk", "killer", "dendritic", "fibroblast", "neuron", "astrocyte", "microglia",
    "hepatocyte", "epithelial", "endothelial", "stem", "progenitor", "cd4", "cd8", "cd3", "cd19", "cd14", "treg",
]
ORGAN_WORDS = ["lung", "liver", "heart", "brain", "kidney", "spleen", "pancreas", "blood", "bone", "muscle", "skin", "thymus", "breast", "colon"]
# Words that tell nothing about a label.
STOP_WORDS = ["a", "an", "the", "of", "is", "and", "or", "with", "to", "for", "in", "on", "at", "from", "by", "as"]
# Fixed value: a field whose answer denies it.
DENIED = r"(?i)^[A-Za-z][A-Za-z0-9_.\- ]*\s*[:=]\s*(N|No|0|false|negative|absent|unaffected|none|neg)\s*$"


def assemble(samples: DataFrame, key: str, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """One row for each distinct sample, with the columns that each table adds: tables are (rows, order), and a sample's
    first row by ``order`` counts. Columns that an earlier table brought, in any case, are left out; null keys too."""
    out = samples.where(F.col(key).isNotNull()).select(key).distinct()
    for table, order in tables:
        seen = {c.lower() for c in out.columns}
        new = [c for c in table.columns if c.lower() not in seen]
        if new:
            row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in new]), F.struct(*order)).alias("__row")
            firsts = table.join(samples.select(key), key, "left_semi").groupBy(key).agg(row)
            out = out.join(firsts, key, "left").select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(f"__row.`{c}`").alias(c) for c in new])
    return out


def compound_group(conditions: dict[str, str], other: str = "Other") -> Column:
    """``a=x AND b=y`` for rows that meet all conditions (a null meets none), ``other`` for the rest."""
    meets = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in conditions.items()])
    return F.when(meets, " AND ".join(f"{c}={v}" for c, v in conditions.items())).otherwise(other)


def default_contrast(rows: DataFrame, column: str) -> DataFrame:
    """(case, control): the two most common values, ties to the smaller; one value stands for both, without any they are case and control."""
    n = rows.where(F.col(column).isNotNull() & (F.col(column) != "") & (F.lower(column) != "nan")).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    place = F.struct((-F.col("n")).alias("a"), F.col("v"))
    top = n.orderBy(F.desc("n"), "v").limit(2)
    return top.agg(F.coalesce(F.min_by("v", place), F.lit("case")).alias("case"), F.coalesce(F.max_by("v", place), F.lit("control")).alias("control"))


def is_denied(text: Column) -> Column:
    """Whether a text is a field that is denied, as ``smoker: no``; a null isn't."""
    return F.coalesce(stripped(text).rlike(DENIED) & ~F.contains(F.lower(text), F.lit("not specified")), F.lit(False))


def marked_section(text: Column, name: str) -> Column:
    """What stands below the mark ``[[ ## name ## ]]`` up to the next mark; without that mark, what stands above the first one."""
    mark = r"\[\[\s*##\s*{}\s*##\s*\]\]"
    any_mark = mark.format(r"[^#\[\]]+?")
    here = mark.format(r"\Q" + name + r"\E")
    below = F.regexp_extract(text, rf"(?s){here}(.*?)(?={any_mark}|\z)", 1)
    return F.coalesce(stripped(F.when(text.rlike(here), below).otherwise(F.regexp_replace(text, rf"(?s){any_mark}.*", ""))), F.lit(""))


def _words(text: Column) -> Column:
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.split(F.lower(text), r"\s+")
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(full, F.regexp_replace(w, r"^[+()\-]+|[+()\-]+$", "")), w))
    return F.array_distinct(F.filter(F.split(F.array_join(spelled, " "), " "), lambda w: w != ""))


def rank_candidates(rows: DataFrame, by: list[str], query: str, candidate: str, similarity: str) -> DataFrame:
    """Rows with a ``score`` of how well the candidate fits the query's words, and its ``rank`` in its group; ties to the smaller candidate.

    Five times the similarity, ten a shared word, three off for a word the query lacks, five if the candidate isn't longer, ten off for an organ
    where the query names cells.
    """
    names = lambda words, kind: F.arrays_overlap(words, F.array(*[F.lit(w) for w in kind]))
    w = rows.withColumn("__q", _words(F.coalesce(F.col(query), F.lit("")))).withColumn("__c", _words(F.coalesce(F.col(candidate), F.lit(""))))
    shared = F.size(F.array_intersect("__q", "__c"))
    organ = names(F.col("__q"), CELL_WORDS) & names(F.col("__c"), ORGAN_WORDS) & ~names(F.col("__c"), CELL_WORDS)
    score = 5 * F.coalesce(F.col(similarity), F.lit(0.0)) + 10 * shared - 3 * (F.size("__c") - shared)
    score = score + F.when(F.size("__c") <= F.size("__q"), 5).otherwise(0) - F.when(organ, 10).otherwise(0)
    scored = w.withColumn("score", F.round(score, 3)).drop("__q", "__c")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), candidate, F.desc(similarity))))


def _stem(token: Column) -> Column:
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    plural = F.endswith(token, F.lit("s")) & (F.length(token) > 3)
    return F.when(F.endswith(token, F.lit("ers")) | F.endswith(token, F.lit("ing")), cut(3)).when(F.endswith(token, F.lit("er")), cut(2)).when(plural, cut(1)).otherwise(token)


def converge(rows: DataFrame, group: str, label: str, common: float = 0.7) -> DataFrame:
    """Each label of a group with its count and canonical spelling: labels are one if they have the same numbers and, but for the stems that
    at least ``common`` of the group's labels share, the same stems. Canonical is the most common, then the shortest, then the smallest.

    Missing labels are left out; a null group counts as an empty name. Shared stems are at most a label's mean number of stems over
    ``common``, so what is gathered for a group is small.
    """
    tokens = F.filter(F.regexp_extract_all(F.lower(label), F.lit(r"[a-z][a-z0-9-]*"), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))
    digits = F.array_sort(F.array_distinct(F.regexp_extract_all(label, F.lit(r"\d+"), F.lit(0))))
    n = rows.where(~is_missing(F.col(label))).groupBy(F.coalesce(group, F.lit("")).alias(group), label).agg(F.count("*").alias("n"))
    n = n.select(group, label, "n", F.array_distinct(F.transform(tokens, _stem)).alias("__stems"), digits.alias("__digits"))
    total = n.groupBy(group).agg(F.count("*").alias("__total"))
    of_stem = n.select(group, F.explode("__stems").alias("__stem")).groupBy(group, "__stem").agg(F.count("*").alias("__c"))
    shared = of_stem.join(total, group).where(F.col("__c") / F.col("__total") >= common).groupBy(group).agg(F.collect_list("__stem").alias("__shared"))
    told = F.array_sort(F.array_except("__stems", F.coalesce("__shared", F.array().cast("array<string>"))))
    printed = n.join(shared, group, "left").select(group, label, "n", told.alias("__told"), "__digits")
    place = F.struct((-F.col("n")).alias("a"), F.length(label).alias("b"), F.col(label).alias("c"))
    best = printed.groupBy(group, "__told", "__digits").agg(F.min_by(label, place).alias("canonical"))
    return printed.join(best, [group, "__told", "__digits"]).select(group, label, "n", "canonical")


def valid_proposals(proposals: DataFrame, samples: DataFrame) -> DataFrame:
    """Proposals (gsm, current, suggest, quote, source) that change a known sample's label and whose suggestion or quote stands in the source
    text; white space runs count as one space. Texts are trimmed, a null is empty."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    known = samples.select(F.lower("gsm").alias("__gsm")).distinct()
    p = proposals.select(stripped(F.col("gsm")).alias("gsm"), *[stripped(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("current", "suggest", "quote")], "source")
    held = lambda c: (flat(c) != "") & F.contains(flat("source"), flat(c))
    p = p.where((F.col("suggest") != "") & (F.col("suggest") != F.col("current")) & (held("suggest") | held("quote")))
    return p.join(known, F.lower("gsm") == F.col("__gsm"), "left_semi").drop("source")


def activity_ranking(rows: DataFrame, source: str, n: int) -> DataFrame:
    """The ``n`` sources of highest absolute mean activity; ties by name. Sources without a value are left out."""
    mean = rows.groupBy(source).agg(F.avg("value").alias("mean_activity")).where("mean_activity is not null")
    return mean.withColumn("abs_activity", F.abs("mean_activity")).orderBy(F.desc("abs_activity"), source).limit(n)


def capped(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of ``n`` rows, those of smallest hash of key and seed, the same at each run; tasks keep ``n`` rows each."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def platform_series(meta: dict[str, DataFrame], gpl: str) -> DataFrame:
    """(gpl, title, gse) of a platform, named in any case, and its distinct series; a platform without series has one row with a null."""
    named = meta["gpl"].where(F.upper("gpl") == gpl.upper()).select("gpl", "title")
    return named.join(meta["gse_gpl"].select("gpl", "gse").distinct(), "gpl", "left")


def first_series(series_ids: Column) -> Column:
    """The first of a list of series ids that commas separate."""
    return F.trim(F.substring_index(series_ids, ",", 1))
