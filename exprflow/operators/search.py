"""Searches: metadata by keyword, vocabularies, nearest vectors, graph walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import nearest_vectors


def any_contains(columns: list[str], words: list[str]) -> Column:
    """Whether any column holds any of the words, without regard to case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(w.lower())), F.lit(False)) for c in columns for w in words])


def keyword_samples(meta: dict[str, DataFrame], words: list[str], platforms: list[str] | None = None) -> DataFrame:
    """Samples of the series whose titles, summaries or sample titles hold a word: gse, gsm, gpl and the words found."""
    links = meta["gse_gpl"] if platforms is None else meta["gse_gpl"].where(F.col("gpl").isin(platforms))
    rows = (
        links.join(meta["gse"], "gse").join(meta["gse_gsm"], "gse")
        .join(meta["gsm"].select("gsm", F.col("title").alias("gsm_title")), "gsm")
        .select("gse", "gsm", "gpl", F.lower(F.concat_ws(" ", "title", "summary", "gsm_title")).alias("blob")).distinct()
    )
    found = F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.col("blob"), w))
    return rows.withColumn("matched", found).where(F.size("matched") > 0).select("gse", "gsm", "gpl", F.array_join("matched", "|").alias("matched"))


def series_of_samples(samples: DataFrame) -> DataFrame:
    """Series with their number of samples and all words found."""
    return samples.groupBy("gse").agg(
        F.countDistinct("gsm").alias("n_samples"), F.array_join(F.array_sort(F.collect_set("matched")), "|").alias("matched")
    )


def platform_search(meta: dict[str, DataFrame], word: str, n: int) -> DataFrame:
    """The ``n`` platforms with most samples whose title holds a word."""
    per = meta["gse_gpl"].join(meta["gse_gsm"], "gse").groupBy("gpl").agg(F.count("*").alias("n_samples"))
    hits = meta["gpl"].where(F.contains(F.lower("title"), F.lit(word.lower()))).join(per, "gpl", "left")
    return hits.select("gpl", "title", F.coalesce("n_samples", F.lit(0)).alias("n_samples")).orderBy(F.desc("n_samples"), "gpl").limit(n)


def lookup(queries: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The id of each label by name, else by synonym, without regard to case; ties go to the smaller id."""
    names = terms.select(F.lower("name").alias("key"), "id", F.lit(0).alias("tier"))
    every = names.unionByName(synonyms.select(F.lower("synonym").alias("key"), "id", F.lit(1).alias("tier")))
    best = every.groupBy("key").agg(F.min(F.struct("tier", "id")).alias("b")).select("key", "b.id", "b.tier")
    return queries.withColumn("key", F.lower("label")).join(best, "key", "left").drop("key")


def nearest(queries: DataFrame, base: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k base vectors of highest cosine for each query of a stated set: ``neighbours.nearest_vectors`` without a category."""
    return nearest_vectors(queries, base, k, least)


def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes reached from ``starts`` (start) over edges (child, parent), with their least number of steps; each once."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["child"]).select("start", F.col("parent").alias("node"), F.lit(d).alias("steps")).distinct()
        front = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "steps"), "walk")
        seen = seen.unionByName(front)
    return seen.where("steps > 0")


def containment(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """Labels of a group whose words are all in a longer label of the group: the most used such label, ties to the smaller."""
    words = F.array_distinct(F.filter(F.split(F.lower(label), r"[^a-z0-9]+"), lambda w: w != ""))
    n = rows.groupBy(*group, label).agg(F.count("*").alias("n")).withColumn("words", words).where(F.size("words") > 0)
    # a label meets the labels that hold its rarest word, so common words bring no pairs together
    each = n.select(*group, label, "words", F.explode("words").alias("w"))
    rare = each.join(each.groupBy(*group, "w").agg(F.count("*").alias("df")), [*group, "w"])
    small = rare.groupBy(*group, label, "words").agg(F.min(F.struct("df", "w")).alias("r")).select(*group, label, "words", F.col("r.w").alias("w"))
    big = n.select(*group, F.col(label).alias("other"), F.col("n").alias("uses"), F.col("words").alias("owords"), F.explode("words").alias("w"))
    pairs = small.join(big, [*group, "w"]).where((F.size("owords") > F.size("words")) & (F.size(F.array_except("words", "owords")) == 0))
    return pairs.groupBy(*group, label).agg(F.min_by("other", F.struct((-F.col("uses")).alias("a"), F.col("other"))).alias("container"))


def json_facets(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column's fields as columns; null where it doesn't parse."""
    return rows.withColumn("_j", F.from_json(column, schema)).select("*", "_j.*").drop("_j", column)


def resume(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of groups that aren't done."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")
