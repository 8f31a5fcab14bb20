"""Joining labels to samples, correcting them, and items and figures for judging phases of curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import is_missing
from .quantiles import same_keys

FIELDS = ("Tissue", "Condition", "Treatment")


def sample_key(c: Column) -> Column:
    """A sample id without blanks at its ends, in capitals."""
    return F.upper(F.trim(c.cast("string")))


def attach(rows: DataFrame, meta: DataFrame, on: list[str], columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``rows`` with ``columns`` of ``meta`` (by default series_id and those that start with Classified_), by ids without regard to case and blanks.

    One row of ``meta`` counts for each key, the first by ``order`` and then by its values, so no row of ``rows`` is doubled or lost; keys without a partner, null ones too, get
    nulls. A column that ``rows`` has already is replaced.
    """
    wanted = columns if columns is not None else [c for c in meta.columns if (c == "series_id" or c.startswith("Classified_")) and c not in on]
    keys = [f"_k{i}" for i in range(len(on))]
    held = meta.select(*[sample_key(F.col(c)).alias(k) for c, k in zip(on, keys, strict=True)], F.struct(*[F.col(f"`{c}`") for c in [*(order or []), *wanted]]).alias("_m"))
    held = held.groupBy(*keys).agg(F.min("_m").alias("_m"))
    left = rows.withColumns({k: sample_key(F.col(c)) for c, k in zip(on, keys, strict=True)})
    met = left.join(held, keys, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c not in wanted], *[F.col(f"_m.`{c}`").alias(c) for c in wanted])


def with_phase_context(results: DataFrame, context: DataFrame) -> DataFrame:
    """Phase results with the context of their sample, by (gse, gsm); results without one are kept."""
    return attach(results, context, ["gse", "gsm"], [c for c in context.columns if c not in ("gse", "gsm")])


def apply_corrections(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """(gsm, field, value, was, reason, quote): values (gsm, field, value) with corrections (gsm, field, suggest, reason, quote, at) applied, the last of each.

    ``was`` is null where nothing was corrected. A correction of a field that a known sample lacks adds it; one of an unknown sample does nothing.
    """
    last = Window.partitionBy("gsm", "field").orderBy(F.desc_nulls_last("at"), F.col("suggest"))
    final = corrections.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("gsm", "field", "suggest", "reason", "quote")
    final = final.join(values.select("gsm").distinct(), "gsm", "left_semi")
    both = values.withColumn("_in", F.lit(True)).join(final.withColumn("_fix", F.lit(True)), ["gsm", "field"], "full")
    was = F.when(F.col("_fix"), F.coalesce("value", F.lit("")))
    return both.select("gsm", "field", F.when(F.col("_fix"), F.col("suggest")).otherwise(F.col("value")).alias("value"), was.alias("was"), "reason", "quote")


def _told(field: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")))


def _long(rows: DataFrame, key: str, fields: list[str], value: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), _told(f).alias(value)) for f in fields])
    return rows.select(sample_key(F.col(key)).alias("gsm"), F.explode(cells).alias("p")).select("gsm", "p.field", f"p.{value}")


def _pairs(met: DataFrame, fields: list[str]) -> DataFrame:
    """(gsm, field, was, value) of rows that met (l, r) with the values of all fields: rows meet whole and are spread by field afterwards."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l._f{i}").alias("was"), F.col(f"r._f{i}").alias("value")) for i, f in enumerate(fields)])
    return met.select("l.gsm", F.explode(cells).alias("p")).select("gsm", "p.field", "p.was", "p.value")


def prediction_items(first: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gsm, field, value): every value that says something, to be judged."""
    return _long(first, key, fields, "value").where(~is_missing(F.col("value")))


def correction_items(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gsm, field, was, value): fields that said nothing in the first phase and something in the second; of a repeated sample of the second the first value in order counts."""
    gsm, told = sample_key(F.col(key)).alias("gsm"), [_told(f).alias(f"_f{i}") for i, f in enumerate(fields)]
    later = second.select(gsm, *told).groupBy("gsm").agg(*[F.min(f"_f{i}").alias(f"_f{i}") for i in range(len(fields))])
    met = _pairs(first.select(gsm, *told).alias("l").join(later.alias("r"), F.col("l.gsm") == F.col("r.gsm")), fields)
    return met.where(is_missing(F.col("was")) & ~is_missing(F.col("value"))).select("gsm", "field", "was", "value")


def normalization_items(raw: DataFrame, normal: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gsm, field, was, value): values that said something and were changed; samples are paired by id, repeated ones by the order of all their values."""

    def numbered(rows: DataFrame) -> DataFrame:
        copy = F.row_number().over(Window.partitionBy(sample_key(F.col(key))).orderBy(*[F.col(f"`{f}`") for f in fields]))
        return rows.select(sample_key(F.col(key)).alias("gsm"), copy.alias("copy"), *[_told(f).alias(f"_f{i}") for i, f in enumerate(fields)])

    met = _pairs(numbered(raw).alias("l").join(numbered(normal).alias("r"), same_keys("l", "r", ["gsm", "copy"])), fields)
    return met.where((F.col("was") != F.col("value")) & ~is_missing(F.col("was")))


def label_diversity(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n_before, n_after, merged, pct_merged, n_changed): distinct labels of each field in two phases, and samples whose label differs (null equals null)."""
    counts = lambda df, name: df.agg(*[F.count_distinct(F.col(f"`{f}`")).alias(f"c{i}") for i, f in enumerate(fields)]).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias(name)) for i, f in enumerate(fields)])))
    met = before.alias("l").join(after.alias("r"), F.col(f"l.`{key}`") == F.col(f"r.`{key}`"))
    changed = met.agg(*[F.count_if(~F.col(f"l.`{f}`").eqNullSafe(F.col(f"r.`{f}`"))).alias(f"c{i}") for i, f in enumerate(fields)])
    changed = changed.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("n_changed")) for i, f in enumerate(fields)])))
    j = counts(before, "n_before").join(counts(after, "n_after"), "field").join(changed, "field")
    merged = F.col("n_before") - F.col("n_after")
    return j.select("field", "n_before", "n_after", merged.alias("merged"), (100 * merged / F.greatest("n_before", F.lit(1))).alias("pct_merged"), "n_changed")
