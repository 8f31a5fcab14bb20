"""Curation of free-text sample labels: parsing, canonical forms, voting among siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_groups

NOT_SPECIFIED = "Not Specified"
# Spellings of a missing label.
MISSING = ["not specified", "n/a", "na", "none", "unknown", "null", "", "-"]

# Units of a dose or a time; of units that begin alike the longer ones come first.
DOSE_UNITS = [
    "mg/kg", "µg/kg", "μg/kg", "ug/kg", "ng/kg", "ng/ml", "mg/ml", "µg/ml", "μg/ml", "ug/ml", "iu/ml", "u/ml", "mmol", "nmol", "µmol", "umol", "mol", "mm", "nm", "µm", "μm", "um",
    "pm", "fm", "mg", "µg", "μg", "ug", "ng", "pg", "kg", "g", "ml", "µl", "μl", "ul", "nl", "l", "cgy", "gy", "iu", "u", "hours", "hour", "hrs", "hr", "mins", "min", "months", "month",
    "mo", "m", "secs", "sec", "days", "day", "weeks", "week", "wks", "wk", "years", "year", "yrs", "yr", "h", "s", "d", "y",
]


def is_missing(label: Column, vocabulary: list[str] = MISSING) -> Column:
    """Whether a label says nothing; a null does."""
    return F.coalesce(F.lower(F.trim(label)).isin(vocabulary), F.lit(True))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(label: Column) -> Column:
    """Without control characters, white space runs, or quotes and full stops at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(label, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), r"^[\"'.]+|[\"'.]+$", "")


def parse_values(answer: Column) -> Column:
    """``a; b; a`` as cleaned values in order, each once, missing ones dropped, joined by ``; ``; or Not Specified."""
    parts = F.transform(F.split(F.coalesce(answer, F.lit("")), ";"), clean)
    real = F.array_distinct(F.filter(parts, lambda x: ~is_missing(x)))
    return F.when(F.size(real) > 0, F.array_join(real, "; ")).otherwise(NOT_SPECIFIED)


def characteristics(text: Column) -> Column:
    """``key: value; ...`` as structs of lower-case key and value, in order."""
    parts = F.filter(F.split(text, r"[;\n]"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def numbers(label: Column) -> Column:
    """Numbers in a label, in order."""
    return F.regexp_extract_all(label, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def compact(label: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(label), r"[^a-z0-9]", "")


def initials(label: Column) -> Column:
    """First letters of the words, lower case."""
    words = F.filter(F.split(F.lower(label), r"[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def strip_dose(label: Column) -> Column:
    """A label without doses, concentrations, durations (``for 3 days``), percentages and factors (``5x``, ``10-fold``), and without the brackets
    and separators that this empties; null if nothing is left or nothing goes."""
    unit, amount = f"(?:{'|'.join(DOSE_UNITS)})(?![A-Za-z])", r"\d+(?:\.\d+)?\s*"
    dose = rf"(?i)\b(?:for|at|after|over)\s+\d+\s*{unit}|\b{amount}{unit}|\b{amount}%|\b\d+[\s-]*(?:fold|x)\b"
    bare = F.regexp_replace(F.regexp_replace(label, dose, " "), r"\(\s*\)", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[,;-]\s*[,;-]+", " "), r"\s+", " ")
    bare = F.regexp_replace(bare, r"^[ ,;-]+|[ ,;-]+$", "")
    return F.when((bare != "") & (F.lower(bare) != F.lower(label)), bare)


def split_composite(label: Column, plus: bool = False) -> Column:
    """Parts of a label joined by ``;``, for treatments also by `` + ``."""
    return F.filter(F.transform(F.split(label, r"\s\+\s|;" if plus else ";"), stripped), lambda x: x != "")


def memo_key(*fields: Column) -> Column:
    """SHA-256 of the fields, with a separator that texts don't hold."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def collapse(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """Each label of a group with its canonical spelling: the most common of the labels of equal compact form and
    equal numbers, or of those whose initials it is (2 to 6 letters). Ties go to the smaller label."""
    n = rows.groupBy(*group, label).agg(F.count("*").alias("n"))
    n = n.select(*group, label, "n", compact(F.col(label)).alias("form"), initials(F.col(label)).alias("short"), numbers(F.col(label)).alias("nums"))
    best = F.max_by(label, F.struct(F.col("n"), F.col("form"))).alias("canonical")
    forms = n.groupBy(*group, "form", "nums").agg(F.min_by(label, F.struct((-F.col("n")).alias("a"), F.col(label))).alias("canonical"), F.sum("n").alias("of_form"))
    wide = n.where(F.length("short").between(2, 6) & (F.col("short") != F.col("form"))).groupBy(*group, F.col("short").alias("form"), "nums").agg(best)
    out = n.join(forms.select(*group, "form", "nums", F.col("canonical").alias("same")), [*group, "form", "nums"]).join(wide, [*group, "form", "nums"], "left")
    return out.select(*group, label, "n", F.coalesce("canonical", "same").alias("canonical"))


def consensus_verdict(rows: DataFrame, group: list[str], label: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """keep, promote (a missing label in a group that agrees) or demote (a label that a group's majority contradicts)."""
    named = rows.where(~is_missing(F.col(label))).groupBy(*group, F.lower(label).alias("v")).agg(F.count("*").alias("n"))
    top = named.groupBy(*group).agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v"))).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_named"))
    strong = (F.col("n_named") >= least) & (F.col("n_top") >= share * F.col("n_named"))
    miss = is_missing(F.col(label))
    verdict = F.when(strong & miss, "promote").when(strong & (F.lower(label) != F.col("top")), "demote").otherwise("keep")
    return rows.join(top, group, "left").select(*rows.columns, "top", F.coalesce(verdict, F.lit("keep")).alias("verdict"))


def _flat(text: Column) -> Column:
    """Lower case, with runs of blanks and separators as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s;,|/\\]+", " "))


def curate(rows: DataFrame, group: list[str], label: str, blob: str, fields: str, share: float = 0.8, least: int = 3, twins: int = 3) -> DataFrame:
    """Rows with final_value, action, reason, support and n_twins, by what a sample's siblings and its own text say.

    ``blob`` is all text of a sample, ``fields`` the array of the keys of its characteristics. Rules, the first that holds: a label that is a ``key: value`` of the
    text is demoted to Not Specified; a label that the text doesn't hold is demoted where ``share`` of the group says nothing; a missing one is promoted to a value that
    ``share`` of the group has (equal in any case, spelled as most do, ties to the smaller); else it is kept. Demotion and promotion by siblings need ``twins`` samples of the
    group with the same keys, the sample included, or only flag the row. Groups below ``least`` samples are kept.
    """
    missing, own = is_missing(F.col(label)), stripped(F.coalesce(F.col(label), F.lit("")))
    live = rows.withColumns({"_missing": missing, "_v": own, "_low": F.lower(own), "_keys": F.array_join(F.coalesce(F.col(fields), F.array().cast("array<string>")), "\x1f")})
    spelled = live.where("not _missing").groupBy(*group, "_low", "_v").agg(F.count("*").alias("n"))
    named = spelled.groupBy(*group, "_low").agg(F.sum("n").alias("n"), F.min_by("_v", F.struct((-F.col("n")).alias("a"), F.col("_v"))).alias("v"))
    top = named.groupBy(*group).agg(F.max("n").alias("_n_top"), F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("_low"))).alias("_top"))
    sizes = live.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if("_missing").alias("_n_missing"))
    alike = live.groupBy(*group, "_keys").agg(F.count("*").alias("n_twins"))
    met = join_groups(join_groups(join_groups(live, sizes, group), top, group), alike, [*group, "_keys"])
    text = F.coalesce(F.col(blob), F.lit(""))
    leak = ~F.col("_missing") & F.col("_v").rlike(r"^[A-Za-z][\w.]*\s*:\s*\S+") & (F.contains(_flat(text), _flat(F.col("_v"))) | F.contains(F.lower(text), F.col("_low")))
    silent, common = F.col("_n_missing") / F.col("_n"), F.coalesce("_n_top", F.lit(0)) / F.col("_n")
    enough = F.col("_n") >= least
    demote = enough & ~F.col("_missing") & (silent >= share) & ~F.contains(F.lower(text), F.col("_low"))
    promote = enough & F.col("_missing") & (common >= share)
    few = F.col("n_twins") < twins
    kept = F.when(F.col("_missing"), NOT_SPECIFIED).otherwise(F.col("_v"))
    return met.select(
        *rows.columns,
        F.when(leak, NOT_SPECIFIED).when((demote | promote) & few, kept).when(demote, NOT_SPECIFIED).when(promote, F.col("_top")).otherwise(kept).alias("final_value"),
        F.when(leak, "demote").when((demote | promote) & few, "flag_only").when(demote, "demote").when(promote, "promote").otherwise("keep").alias("action"),
        F.when(leak, "key_value_leak").when(demote, "siblings_silent").when(promote, "siblings_agree").when(~enough, "few_siblings").otherwise("no_consensus").alias("reason"),
        F.when(leak, 1.0).when(demote, silent).when(promote, common).when(~enough, 0.0).otherwise(F.greatest(silent, common)).alias("support"),
        F.col("n_twins"),
    )


def mint(labels: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """Ids ``prefix-00001`` on for labels that aren't known, in their order; numbers go on after the highest known.

    Labels are ranged by name and numbered within ranges, so no task sees them all.
    """
    new = labels.select(F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct().join(known.select("label"), "label", "left_anti")
    base = known.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("base"))
    part = new.withColumn("part", F.substring("label", 1, 2))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = part.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("label"))).join(starts, "part").crossJoin(F.broadcast(base))  # one row
    return numbered.select("label", F.format_string(f"{prefix}-%05d", F.col("base") + F.col("start") + F.col("k")).alias("id"))


def sentence_budget(text: Column, max_chars: int) -> Column:
    """The first sentences of a text that fit into ``max_chars``."""
    s = F.split(text, r"(?<=[.!?])\s+")
    add = lambda acc, x: F.when(F.length(acc) + F.length(x) + 1 <= max_chars, F.trim(F.concat_ws(" ", acc, x))).otherwise(acc)
    return F.aggregate(s, F.lit(""), add)
