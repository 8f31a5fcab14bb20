"""Exact quantiles of few, very large groups: no group's values have to fit into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000


def same_keys(a: str, b: str, by: list[str]) -> Column:
    """Equality of the keys ``by`` of two aliased tables; null equals null, and without keys all rows are one group."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in by] or [F.lit(True)])


def join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join of one row for each group, null keys too; columns of ``right`` are added."""
    added = [c for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), same_keys("l", "r", by), "left").select("l.*", *[F.col(f"r.`{c}`") for c in added])


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, q): count of values and interpolated quantiles ``at`` of each group; null where a group has no value.

    A mergeable sketch, whose ranks are off by a share of 1 / ``accuracy`` at most, brackets each quantile; the values below a bracket are
    counted by partial sums, and only those within it, 6 / ``accuracy`` of a group or groups of up to five times ``accuracy`` whole, are
    ordered. Both come from one pass, as a sketch that is computed again can differ by the order in which its parts arrive. A rank outside its
    bracket would be an error, never a guess. Nulls are left out, NaN is the largest value.
    """
    margin, v = 3 / accuracy, F.col("__v")
    live = rows.select(*[F.col(f"`{c}`") for c in by], F.col(f"`{value}`").cast("double").alias("__v"))
    wanted = [x for q in at for x in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = live.groupBy(*by).agg(F.count("__v").alias("n"), F.percentile_approx("__v", wanted, accuracy).alias("__marks"))
    small = F.col("n") <= 5 * accuracy
    low = [F.when(small | F.lit(q - margin <= 0), F.lit(float("-inf"))).otherwise(F.col("__marks")[2 * k]) for k, q in enumerate(at)]
    high = [F.when(small | F.lit(q + margin >= 1), F.lit(float("nan"))).otherwise(F.col("__marks")[2 * k + 1]) for k, q in enumerate(at)]
    groups = sketch.select(*by, "n", *[c.alias(f"__lo{k}") for k, c in enumerate(low)], *[c.alias(f"__hi{k}") for k, c in enumerate(high)])
    placed = join_groups(live.where(v.isNotNull()), groups, by)

    upto_high = [F.when(v <= F.col(f"__hi{k}"), F.struct(F.lit(k).alias("k"), F.when(v >= F.col(f"__lo{k}"), v).alias("v"))) for k in range(len(at))]
    met = placed.select(*by, "n", F.explode(F.array_compact(F.array(*upto_high))).alias("__m")).select(*by, "n", F.col("__m.k").alias("__k"), F.col("__m.v").alias("__v"))
    inside = met.groupBy(*by, "n", "__k", "__v").agg(F.count("*").alias("__c"))  # one null a bracket for all below it, which comes first
    upto = F.sum("__c").over(Window.partitionBy(*by, "__k").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = upto - F.col("__c")
    place = F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("__k") + 1) * (F.col("n") - 1)
    ranked = inside.withColumn("__start", start).withColumn("__p", place)

    def of_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__c")), v))

    ends = ranked.groupBy(*by, "__k", "__p").agg(of_rank(F.floor("__p")).alias("__a"), of_rank(F.ceil("__p")).alias("__b"))
    between = (F.ceil("__p") - F.col("__p")) * F.col("__a") + (F.col("__p") - F.floor("__p")) * F.col("__b")
    found = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    picked = ends.select(*by, "__k", found.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(between).alias("__q"))
    quantiles = picked.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("__k") == k, F.col("__q"))) for k in range(len(at))]).alias("q"))
    return join_groups(sketch.select(*by, "n"), quantiles, by)
