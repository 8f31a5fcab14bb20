"""What the samples of an experiment say together: modes, lines and blocks of context, gates of specialists, and regions of expression side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import attach
from .labels import NOT_SPECIFIED, stripped
from .quantiles import join_groups

#: Share of signs below which a label may be a field's name, and evidence gap above which it may.
SIGNS, GAP = 0.5, 0.25
#: Siblings in a line, and examples in a block.
IN_LINE, EXAMPLES = 5, 5


def said(label: Column) -> Column:
    """A label without blanks at its ends; null where it says nothing."""
    v = stripped(label)
    return F.when((v != "") & (F.lower(v) != NOT_SPECIFIED.lower()), v)


def unrepr(text: Column) -> Column:
    """A text without the quotes and escapes of a printed string: a pair of outer quotes, one more quote at either end, and the usual escapes."""
    t = stripped(text)
    paired = (F.length(t) >= 2) & F.left(t, F.lit(1)).isin("'", '"') & (F.left(t, F.lit(1)) == F.right(t, F.lit(1)))
    t = F.when(paired, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, "^['\"]", ""), "['\"]$", "")
    for escape, plain in ((r"\n", "\n"), (r"\t", "\t"), (r"\'", "'"), (r"\"", '"'), ("\\\\", "\\")):
        t = F.replace(t, F.lit(escape), F.lit(plain))
    return t


def sibling_mode(rows: DataFrame, group: list[str], label: str, flagged: Column) -> DataFrame:
    """(group, mode, n): the most common label that says something of the samples that aren't flagged; ties to the smaller. Groups without one have no row."""
    live = rows.where(~F.coalesce(flagged, F.lit(False))).withColumn("_v", said(F.col(label))).where("_v is not null")
    n = live.groupBy(*group, "_v").agg(F.count("*").alias("n"))
    best = n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("_v").alias("v"))).alias("b"))
    return best.select(*group, F.col("b.v").alias("mode"), (-F.col("b.a")).alias("n"))


def sibling_line(rows: DataFrame, group: list[str], label: str, top: int = IN_LINE) -> DataFrame:
    """(group, line): the ``top`` labels of each group with their numbers, as ``"lung" (n=3); "liver" (n=1)``; "(none)" without a label."""
    n = rows.withColumn("_v", said(F.col(label))).groupBy(*group, "_v").agg(F.count("*").alias("n"))
    place = Window.partitionBy(*group).orderBy(F.col("_v").isNull(), F.desc("n"), "_v")
    ranked = n.withColumn("k", F.row_number().over(place)).where(F.col("k") <= top)
    entry = F.when(F.col("_v").isNotNull(), F.struct("k", F.concat(F.lit('"'), "_v", F.lit('" (n='), F.col("n").cast("string"), F.lit(")")).alias("t")))
    joined = ranked.groupBy(*group).agg(F.sort_array(F.collect_list(entry)).alias("e"))  # at most ``top``
    return joined.select(*group, F.when(F.size("e") > 0, F.array_join(F.transform("e", lambda x: x["t"]), "; ")).otherwise("(none)").alias("line"))


def specialist_gates(flags: DataFrame, modes: DataFrame, group: list[str]) -> DataFrame:
    """Flagged samples with the specialists that look at them, and the neighbour that these are shown.

    ``flags`` holds value, punct_z, evidence and nearest_sibling. Gates: parser, always; fieldname, a label that says something, without ``;``, with few signs and a gap
    to its own text; ns, a missing label in a group with a mode; composite, a label with ``;``. ``near`` is the nearest sibling or else the group's mode, which may be empty.
    """
    met = join_groups(flags, modes.select(*group, "mode"), group)
    value = F.coalesce("value", F.lit(NOT_SPECIFIED))
    missing = F.lower(F.trim(value)) == NOT_SPECIFIED.lower()
    many = F.contains(value, F.lit(";"))
    field = ~missing & ~many & (F.coalesce("punct_z", F.lit(0.0)) < SIGNS) & (F.coalesce("evidence", F.lit(0.0)) > GAP)
    gates = {"parser": F.lit(True), "fieldname": field, "ns": missing & F.col("mode").isNotNull(), "composite": many}
    near = F.coalesce(F.when(F.col("nearest_sibling") != "", F.col("nearest_sibling")), "mode", F.lit(""))
    return met.select(*flags.columns, near.alias("near"), F.array_compact(F.array(*[F.when(g, F.lit(k)) for k, g in gates.items()])).alias("specialists"))


def context_blocks(rows: DataFrame, group: str, key: str, label: str, other: str, meta: DataFrame) -> DataFrame:
    """(group, block): a text on each experiment: title, summary and design where it has them, numbers of samples, its labels by frequency (ties by name), and the first sample by key of
    each of the first five labels, with another column.

    ``meta`` is (group, title, summary, design). A block grows with the labels of an experiment.
    """
    live = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).cast("string").alias("_key"), said(F.col(label)).alias("_v"), F.coalesce(said(F.col(other)), F.lit(NOT_SPECIFIED)).alias("_o"))
    n = live.groupBy("_g", "_v").agg(F.count("*").alias("n"), F.min(F.struct("_key", "_o")).alias("first"))
    sums = n.groupBy("_g").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("_v").isNotNull(), F.col("n")).otherwise(0)).alias("named"),
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct((-F.col("n")).alias("a"), F.col("_v").alias("v"))))).alias("labels"),
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("first", F.col("_v").alias("v"))))).alias("examples"),
    )
    met = sums.join(meta.groupBy(F.col(group).alias("_g")).agg(*[F.min(c).alias(c) for c in ("title", "summary", "design")]), "_g", "left")
    titled = lambda name, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(name), F.trim(c)))
    counts = F.format_string(f"Total samples    : %d  |  Labeled {label}: %d  |  Still NS     : %d", "total", "named", F.col("total") - F.col("named"))
    known = F.when(F.size("labels") > 0, F.concat(F.lit(f"\nKnown {label} labels in this experiment:\n"), F.array_join(F.transform("labels", lambda x: F.format_string("  [%4d]  %s", -x["a"], x["v"])), "\n"))).otherwise(
        f"\nNo {label} labels assigned yet in this experiment."
    )
    shown = F.transform(F.slice("examples", 1, EXAMPLES), lambda x: F.concat(F.lit("  "), x["first"]["_key"], F.lit(f"    {label}: "), x["v"], F.lit(f"  |  {other}: "), x["first"]["_o"]))
    examples = F.when(F.size("examples") > 0, F.concat(F.lit("\nExample labeled samples:\n"), F.array_join(shown, "\n")))
    parts = [titled("Experiment title  : ", F.col("title")), titled("Experiment summary: ", F.col("summary")), titled("Overall design    : ", F.col("design")), counts, known, examples]
    return met.select(F.col("_g").alias(group), F.array_join(F.array_compact(F.array(*parts)), "\n").alias("block"))


def region_comparison(expr: DataFrame, regions: DataFrame, meta: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, value, region, platform, gene, and the columns of ``meta`` and ``labels``): the samples whose value lies in a region, of all regions in one table.

    ``regions`` is a stated set (region, platform, gene, low, high), both ends within; genes meet in any case, and a sample may lie in several regions. ``meta`` adds all of its columns, ``labels`` those that start with
    Classified_, by sample_id, one row each. Nulls and NaN are in no region.
    """
    live = expr.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    wanted = regions.select("region", F.col("platform").alias("_p"), F.upper("gene").alias("_gene"), "low", "high")
    met = live.join(F.broadcast(wanted), (F.col("platform") == F.col("_p")) & (F.upper("gene") == F.col("_gene")) & F.col("value").between(F.col("low"), F.col("high")))  # as many rows as a caller states
    picked = met.select(F.col("sample_id").cast("string").alias("sample_id"), "value", "region", "platform", "gene")
    more = [c for c in meta.columns if c not in picked.columns]
    classes = [c for c in labels.columns if c.startswith("Classified_") and c not in more]
    return attach(attach(picked, meta, ["sample_id"], more), labels, ["sample_id"], classes)
