"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source the documents are ranged by that key: its
leading hex digits are a range bucket, bucket totals give each bucket's place in the source, and a
running sum inside the bucket the place of each document, so the prefix sum over a source that holds
a third of all rows is spread over thousands of buckets. A source takes whole epochs of itself and
then the documents, in key order, up to its exact budget; the document at the cut is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources in code-point order, null last, have the weights in turn. ``share`` of all sizes is
    dealt by weight; no target exceeds ``max_epochs`` times its source, and what a full source
    can't take goes to the others by weight. In order of capacity over weight, source i is full if
    the level it would get, with all sources before it full, is above its own; the level of the
    first that isn't full holds for all after it. One row a source: a table of names, not of rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.select(
        "source",
        "source_size",
        F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"),
    )
    levels = ranked.select(
        "*",
        (
            (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
    )
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        F.when(open_level.isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), open_level["level"] * F.col("weight")))
        .alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of each row: (doc_id, source, size, source_size, target, taken).

    A null text has size 0 and takes nothing; an empty table gives an empty plan. Rows with equal
    doc_id have equal keys and follow each other by size; rows that are alike in all columns share
    the cut in any order, which gives the same multiset of rows. Other columns of ``docs`` are
    ignored, whatever their names, but for ``carry``, which the plan then holds.
    """
    ids = ["doc_id", *carry]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(*ids, "source", word_count(F.col("text")).alias("size")).select(
            "*", F.substring(key, 1, BUCKET_DIGITS).alias("bucket"), F.substring(key, BUCKET_DIGITS + 1, 13).alias("key")
        ),
        "mix-sizes",
    )
    name, none = F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null")
    sized = sized.select("*", name, none)
    sums = sized.groupBy("s", "s_null", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = sums.groupBy("s", "s_null").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(
        sources.select(F.when(~F.col("s_null"), F.col("s")).alias("source"), "source_size"), weights, share, max_epochs
    ).select(name, none, "source_size", "target")
    earlier = Window.partitionBy("s", "s_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select(
        "s", "s_null", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")
    ).join(targets, ["s", "s_null"])
    inside = Window.partitionBy("s", "s_null", "bucket").orderBy("key", *ids, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("before")).join(buckets, ["s", "s_null", "bucket"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("bucket_start") - F.col("before")))
    return placed.select(*ids, "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as whole epochs take it, and the row at a source's cut
    shortened to the words that are left. Returns the columns of ``docs``; ``n_chars`` follows the text.

    Rows without words cost no budget and appear once. The plan joins back by two hashes of the row; rows that are
    alike share what the plan takes of them, in any order.
    """
    key = [F.xxhash64("doc_id", "source", "text").alias("_k1"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("_k2")]
    plan = mix_plan(docs.select("doc_id", "source", "text", *key), carry=("_k1", "_k2"), **options)
    plan = plan.groupBy("_k1", "_k2").agg(F.first("size").alias("_size"), F.sum("taken").alias("_total"), F.count("*").alias("_same"))
    alike = Window.partitionBy("_k1", "_k2")
    rows = docs.select("*", *key).withColumn("_i", F.row_number().over(alike.orderBy("_k1")) - 1).join(plan, ["_k1", "_k2"])
    size = F.col("_size")
    epochs = F.when(size > 0, F.floor(F.col("_total") / (F.col("_same") * size))).otherwise(0).cast("long")
    rest = F.col("_total") - epochs * F.col("_same") * size - F.col("_i") * size
    rows = rows.withColumn("_taken", epochs * size + F.least(size, F.greatest(F.lit(0), rest)))
    times = F.when(size > 0, F.ceil(F.col("_taken") / size)).otherwise(1).cast("int")
    repeated = (
        rows.where(times > 0)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), times - 1)))
        .withColumn("_left", F.col("_taken") - F.col("_k") * size)
    )
    text = F.when(F.col("_left") < size, first_words(F.col("text"), F.col("_left"))).otherwise(F.col("text"))
    out = repeated.withColumn("text", text).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
