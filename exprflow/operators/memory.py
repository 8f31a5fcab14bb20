"""Tables of past label decisions: recall, votes, promotion, lookups in several forms, quotas and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import compact, is_missing
from .quantiles import exact_quantiles


def recall(log: DataFrame, key: list[str], canonical: str, confidence: str, at: str, top: int = 5) -> DataFrame:
    """Past decisions for each key: canonical, n, avg_confidence, last_at, rank; most frequent first, then by confidence."""
    n = log.groupBy(*key, canonical).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("avg_confidence"), F.max(at).alias("last_at"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("avg_confidence"), canonical)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def table_stats(log: DataFrame, by: str, cluster: str) -> DataFrame:
    """Rows and distinct clusters of each column of labels."""
    return log.groupBy(by).agg(F.count("*").alias("n_rows"), F.countDistinct(cluster).alias("n_clusters"))


def clusters(mapping: DataFrame, raw: str, cluster: str) -> DataFrame:
    """(cluster, members): its raw labels in order, without the cluster's own name in either case."""
    own = (F.col(raw) == F.col(cluster)) | (F.col(raw) == F.lower(cluster))
    return mapping.groupBy(F.col(cluster).alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set(F.when(~own, F.col(raw)))), "; ").alias("members"))


def promotion_candidates(choices: DataFrame, key: list[str], canonical: str, study: str, uses: str, least: int = 3) -> DataFrame:
    """Keys whose one canonical id was chosen in ``least`` studies or more; a key with a second id anywhere is no candidate.

    A key's ids and studies are counted in one aggregation by key: with one id its studies are the id's.
    """
    n = choices.groupBy(*key).agg(
        F.countDistinct(study).alias("n_studies"), F.sum(uses).alias("n_uses"), F.min(canonical).alias("canonical"), F.max(canonical).alias("_last")
    )
    return n.where((F.col("n_studies") >= least) & (F.col("canonical") == F.col("_last"))).drop("_last")


def best_vote(votes: DataFrame, key: str, suggestion: str, least: int = 2) -> DataFrame:
    """The suggestion with most votes for each key, if it has ``least``; ties go to the smaller."""
    n = votes.where(F.col(suggestion).isNotNull()).groupBy(key, suggestion).agg(F.count("*").alias("n"))
    top = n.where(F.col("n") >= least).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col(suggestion).alias("s"))).alias("b"))
    return top.select(key, F.col("b.s").alias(suggestion), (-F.col("b.a")).alias("n_votes"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """A draw of ``n`` rows with a proportional quota for each stratum; the smallest (then by name) takes what rounding leaves.

    Rows are drawn in the order of a hash of their key, so the draw is alike in every run. A quota beyond its stratum takes all of it.
    """
    size = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    all_ = Window.partitionBy()
    quota = size.withColumn("quota", F.floor(F.lit(n) * F.col("size") / F.sum("size").over(all_)))  # one row a stratum
    quota = quota.withColumn("first", F.row_number().over(Window.orderBy("size", stratum)) == 1).withColumn("left", F.lit(n) - F.sum("quota").over(all_))
    quota = quota.select(F.col(stratum).alias("_s"), (F.col("quota") + F.when(F.col("first"), F.col("left")).otherwise(0)).alias("quota"))
    drawn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return rows.withColumn("_k", drawn).join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where("_k <= quota").drop("_k", "_s", "quota")


def rater_agreement(a: DataFrame, b: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Share of equal verdicts of two raters, on what both judged: by, n, agreement."""
    both = a.select(*key, *by, F.col("verdict").alias("va")).join(b.select(*key, F.col("verdict").alias("vb")), key)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("agreement"))


def forms(label: Column) -> Column:
    """The forms a label is looked up in, from the exact one on: as is, lower, trimmed of signs, letters and digits only."""
    return F.array(label, F.lower(label), F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", " ")), compact(label))


def cluster_lookup(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """The cluster of each distinct label by the first of its forms that ``mapping`` (raw, cluster) holds: label, cluster, form.
    Labels without a match have null; a form with two clusters goes to the smaller."""
    best = mapping.groupBy("raw").agg(F.min("cluster").alias("cluster"))
    asked = labels.select("label").distinct()
    hit = asked.select("label", F.posexplode(forms(F.col("label"))).alias("form", "raw")).join(best, "raw")
    found = hit.groupBy("label").agg(F.min(F.struct("form", "cluster")).alias("b"))
    return asked.join(found, "label", "left").select("label", "b.cluster", "b.form")


def sibling_snap(rows: DataFrame, group: list[str], label: str, share: float = 0.6) -> DataFrame:
    """Each label of a group with the most used label that holds ``share`` of its words: label, n, snapped.

    Labels meet by their rarest words within their group, as counted distinct labels; a label holds its own words, so one that is
    the most used of its kind stays. Ties go to the smaller label. Missing labels are left out.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.trim(label)), r"\s+"), lambda w: w != ""))
    n = rows.where(~is_missing(F.col(label))).groupBy(*group, label).agg(F.count("*").alias("n")).withColumn("words", words)
    each = n.select(*group, label, F.explode("words").alias("w"))
    rare = each.join(each.groupBy(*group, "w").agg(F.count("*").alias("df")), [*group, "w"]).groupBy(*group, label).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("by_rarity"))
    # a label that holds ``share`` of the words misses fewer than this many: it holds one of so many rarest
    of = F.size("words")
    few = of - F.ceil(F.lit(share) * of - F.lit(1e-9)).cast("int") + 1
    mine = n.join(rare, [*group, label]).select(*group, label, of.alias("of"), F.col("words").alias("own"), F.explode(F.slice("by_rarity", F.lit(1), few)).alias("r")).withColumn("w", F.col("r.w")).drop("r")
    other = n.select(*group, F.col(label).alias("sib"), F.col("n").alias("uses"), "words", F.explode("words").alias("w"))
    held = mine.join(other, [*group, "w"]).where(F.size(F.array_intersect("own", "words")) >= share * F.col("of"))
    best = held.groupBy(*group, label).agg(F.min(F.struct((-F.col("uses")).alias("a"), F.col("sib").alias("s"))).alias("b"))
    return n.join(best, [*group, label]).select(*group, label, "n", F.col("b.s").alias("snapped"))


def diverse_examples(rows: DataFrame, group: list[str], value: str, order: list[str], top: int = 3) -> DataFrame:
    """The first row of each distinct value of a group, and of these the first ``top``: group, value, order, rank."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(F.struct(*order)).alias("o"))
    out = firsts.select(*group, value, "o.*").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order, value)))
    return out.where(F.col("rank") <= top)


def flag_high(rows: DataFrame, group: list[str], key: str, score: str, quantile: float = 0.7, floor: float = 0.3, top: int = 25) -> DataFrame:
    """Rows of each group above its quantile of scores and ``floor``, the ``top`` highest of them: group, key, score, rank."""
    cut = exact_quantiles(rows, group, score, [quantile]).select(*group, F.greatest(F.col("q")[0], F.lit(floor)).alias("cut"))
    high = rows.join(cut, group).where(F.col(score) > F.col("cut")).select(*group, key, score)
    return high.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key))).where(F.col("rank") <= top)


def audit(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Counts of a vocabulary: n_synonyms, n_orphans (no term has their id), n_mismatched (their label isn't the term's name)."""
    j = synonyms.join(terms.select("id", "name"), "id", "left")
    return j.agg(F.count("*").alias("n_synonyms"), F.count_if(F.col("name").isNull()).alias("n_orphans"), F.count_if(F.col("name") != F.col("label")).alias("n_mismatched"))


def top_or_other(rows: DataFrame, value: str, keep: int) -> DataFrame:
    """Rows with ``binned``: one of the ``keep`` - 1 most frequent values, or ``Other``; with at most ``keep`` values all stay."""
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), value).limit(keep + 1)
    ranks = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), value)))  # keep + 1 rows
    many = ranks.agg((F.max("r") > keep).alias("many"))
    named = ranks.crossJoin(F.broadcast(many)).where(F.when(F.col("many"), F.col("r") < keep).otherwise(True)).select(value, F.col(value).alias("_b"))
    binned = F.when(F.col(value).isNotNull(), F.coalesce("_b", F.lit("Other")))
    return rows.join(F.broadcast(named), value, "left").withColumn("binned", binned).drop("_b")  # keep rows


def equal_width(rows: DataFrame, value: str, bins: int = 12) -> DataFrame:
    """Rows with ``bin``, 0 to ``bins`` - 1, of equal width over the range of a numeric column; the highest value is in the last."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    b = F.when(F.col(value).isNotNull(), F.least(F.floor(at), F.lit(bins - 1)).cast("int"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("bin", b).drop("_lo", "_hi")  # one row


def data_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_rows, n_present, pct_present; all columns in one pass."""
    sums = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_present")) for i, c in enumerate(columns)])
    out = sums.select("n", F.inline(each))
    return out.select("column", F.col("n").alias("n_rows"), "n_present", F.coalesce(F.try_divide(100 * F.col("n_present"), "n"), F.lit(0.0)).alias("pct_present"))


def priority_union(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all parts, of each key those of the first part that has it."""
    rows = None
    for i, part in enumerate(parts):
        one = part.withColumn("_p", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    first = rows.groupBy(*key).agg(F.min("_p").alias("_p"))
    return rows.join(first, [*key, "_p"], "left_semi").drop("_p")
