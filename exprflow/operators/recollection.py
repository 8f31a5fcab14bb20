"""What curation remembers: maps of raw labels to clusters in all their forms, relations, core labels, and a search of four tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import is_missing
from .memory import recall

# Prefixes of a label that name its field.
PREFIXES = ["cell line:", "cell type:", "tissue:", "organ:", "cell line :", "cell type :", "tissue :"]
#: Relations that a lookup gives, and core labels.
RELATIONS, CORE = 5, 100


def without_prefix(text: Column) -> Column:
    """A label without the name of its field; the label itself, blanks included, where it has none."""
    low = F.lower(F.trim(text))
    out = text
    for p in reversed(PREFIXES):  # of two that fit, the first
        out = F.when(low.startswith(p), F.trim(F.substring(text, F.lit(len(p) + 1), F.length(text)))).otherwise(out)
    return out


def spaced(text: Column) -> Column:
    """Lower case, with signs between words as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[-_/]", " "), r"\s+", " "))


def all_forms(text: Column) -> Column:
    """The forms that a label is remembered in: as it is, lower, spaced, and those of the label without the name of its field; each once, in order."""
    t, bare = F.trim(text), without_prefix(F.trim(text))
    return F.array_distinct(F.filter(F.array(t, F.lower(t), spaced(t), bare, F.lower(bare), spaced(bare)), lambda f: f != ""))


def cluster_map(clusters: DataFrame) -> DataFrame:
    """(col, raw, cluster): every form of the raw labels and names of clusters (col, cluster, raw), a row each; exact forms win over derived ones, and then the smaller cluster.

    Blank and null raw labels are left out, the names of their clusters are not.
    """
    named = clusters.where(F.col("cluster").isNotNull())
    own = named.select("col", "cluster", F.explode(F.array("cluster", "raw")).alias("text")).where(F.length(F.trim("text")) > 0).distinct()
    forms = own.select("col", "cluster", F.trim("text").alias("text"), F.explode(all_forms(F.col("text"))).alias("raw"))
    exact = (F.col("raw") == F.col("text")) | (F.col("raw") == F.lower("text"))
    best = forms.groupBy("col", "raw").agg(F.min(F.struct((~exact).alias("derived"), F.col("cluster"))).alias("b"))
    return best.select("col", "raw", "b.cluster")


def relations(clusters: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(col, subject, relation, object, weight): raw labels assigned to clusters, at weight 1, and logged labels (col, raw, canonical, confidence) that differ from their canonical one as its
    variants, at the confidence of the last by ``at``."""
    out = clusters.where(F.length(F.trim("raw")) > 0).select("col", F.trim("raw").alias("subject"), F.lit("assigned_to").alias("relation"), F.col("cluster").alias("object"), F.lit(1.0).alias("weight")).distinct()
    if log is not None:
        differs = log.where(F.col("raw") != F.col("canonical"))
        last = differs.groupBy("col", F.col("raw").alias("subject"), F.col("canonical").alias("object")).agg(F.max_by("confidence", F.struct("at", "confidence")).alias("weight"))
        out = out.unionByName(last.select("col", "subject", F.lit("variant_of").alias("relation"), "object", F.col("weight").cast("double").alias("weight")))
    return out


def core_labels(rows: DataFrame, col: str, n: int = CORE) -> DataFrame:
    """(label, freq, rank): the ``n`` most frequent labels of a column that say something; ties to the smaller."""
    live = rows.where(~is_missing(F.col(col))).groupBy(F.col(col).alias("label")).agg(F.count("*").alias("freq"))
    top = live.orderBy(F.desc("freq"), "label").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "label")))  # n rows


def registered(known: DataFrame, new: DataFrame) -> DataFrame:
    """The map ``known`` (col, raw, cluster) with new clusters (col, cluster, raw) under three names each: the raw label in lower case, the cluster's name, and that in lower case; a new name
    replaces an old one. Rows without a name are left out."""
    fine = new.where((F.length(F.trim("cluster")) > 0) & (F.length(F.trim("raw")) > 0)).select("col", F.trim("cluster").alias("cluster"), F.lower(F.trim("raw")).alias("raw"))
    names = fine.select("col", "cluster", F.explode(F.array("raw", F.lower("cluster"), "cluster")).alias("raw"))
    names = names.groupBy("col", "raw").agg(F.min("cluster").alias("cluster"))
    return known.join(names.select("col", "raw"), ["col", "raw"], "left_anti").select("col", "raw", "cluster").unionByName(names)


def related(asked: DataFrame, triples: DataFrame, n: int = RELATIONS) -> DataFrame:
    """(col, label, object, relation, weight, rank): the ``n`` weightiest relations of each label; ties by object and relation."""
    met = asked.select("col", "label").distinct().join(triples.withColumnRenamed("subject", "label"), ["col", "label"])
    order = Window.partitionBy("col", "label").orderBy(F.desc("weight"), "object", "relation")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("col", "label", "object", "relation", "weight", "rank")


def search(asked: DataFrame, mapping: DataFrame, log: DataFrame, triples: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(col, label, tier, rank, answer, score): what each tier knows of the labels (col, label): cluster (by the first form that the map holds), episodic (earlier answers, by how often), semantic
    (col, label, answer, score, rank; those of ``neighbours.semantic_search``), relation. Tiers stand side by side; none shuts another out."""
    asked = asked.select("col", "label").where("label is not null").distinct()
    form = asked.select("col", "label", F.posexplode(all_forms(F.col("label"))).alias("form", "raw")).join(mapping, ["col", "raw"])
    cluster = form.groupBy("col", "label").agg(F.min(F.struct("form", "cluster")).alias("b")).select("col", "label", F.lit("cluster").alias("tier"), F.lit(1).alias("rank"), F.col("b.cluster").alias("answer"), F.lit(1.0).alias("score"))
    past = recall(log.withColumnRenamed("raw", "label"), ["col", "label"], "canonical", "confidence", "at").join(asked, ["col", "label"], "left_semi")
    past = past.select("col", "label", F.lit("episodic").alias("tier"), "rank", F.col("canonical").alias("answer"), F.col("avg_confidence").alias("score"))
    kin = related(asked, triples).select("col", "label", F.lit("relation").alias("tier"), "rank", F.col("object").alias("answer"), F.col("weight").alias("score"))
    out = cluster.unionByName(past).unionByName(kin)
    return out if semantic is None else out.unionByName(semantic.join(asked, ["col", "label"], "left_semi").select("col", "label", F.lit("semantic").alias("tier"), "rank", "answer", "score"))


def log_policy(raw: Column, canonical: Column, rule: Column) -> Column:
    """Whether a resolution is worth logging, at which confidence, and why: a struct (log, confidence, why)."""
    told = lambda yes, c, why: F.struct(F.lit(yes).alias("log"), F.lit(c).alias("confidence"), F.lit(why).alias("why"))
    return (
        F.when(raw == canonical, told(False, 0.0, "identity")).when(F.coalesce(rule, F.lit("")).isin("", "vocab_exact"), told(False, 0.0, "no_change"))
        .when(rule == "episodic", told(True, 0.98, "episodic_confirmed")).when(rule.startswith("kg_"), told(True, 0.95, "kg_verified")).when(rule == "semantic_vocab", told(True, 0.88, "semantic_llm"))
        .when(rule.isin("exact_match", "abbreviation"), told(True, 0.92, "deterministic")).otherwise(told(True, 0.80, "other"))
    )
