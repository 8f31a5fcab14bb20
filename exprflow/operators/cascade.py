"""Resolution of raw labels to ids and names by an ordered cascade, in which each tier sees only what those before it left open.

Distinct labels travel, once through every tier: a tier by rule is a column, a tier by lookup one left join whose key exists for open rows alone. The tier
that answered is recorded. What no tier knows is minted last, so running the cascade on its own results mints nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .labels import NOT_SPECIFIED, mint, split_composite, strip_dose, stripped

COLUMNS = ("Tissue", "Condition", "Treatment")
# Spellings of the state of a sample that nothing was done to, and their canonical forms.
CONTROLS = {
    "control": "Control", "controls": "Control", "ctrl": "Control", "ctl": "Control", "normal": "Normal", "healthy": "Healthy",
    "healthy control": "Healthy Control", "healthy controls": "Healthy Control", "normal control": "Normal Control", "normal controls": "Normal Control",
    "healthy donor": "Healthy Donor", "untreated": "Untreated", "non-treated": "Untreated", "nontreated": "Untreated", "no treatment": "Untreated",
    "wt": "Wild Type", "wild type": "Wild Type", "wild-type": "Wild Type", "wildtype": "Wild Type", "baseline": "Baseline", "mock": "Mock", "sham": "Sham",
    "naive": "Naive", "naïve": "Naive", "unstimulated": "Unstimulated", "unstim": "Unstimulated", "non-tumor": "Non-Tumor", "non-tumorous": "Non-Tumor",
    "non-malignant": "Non-Malignant", "non-disease": "Non-Disease", "unaffected": "Unaffected", "uninflamed": "Uninflamed", "uninvolved": "Uninvolved",
    "no condition": "Control", "no disease": "Control", "none": "Control",
}
# Tissues that name no organ.
PLACEHOLDERS = ["tumor", "tumour", "tumors", "tumours", "tissue", "tissues", "cell", "cells", "sample", "samples", "biopsy", "biopsies", "specimen", "specimens"]
# Adjectives of organs and their nouns.
NOUNS = {
    "hepatic": "liver", "renal": "kidney", "pulmonary": "lung", "cardiac": "heart", "gastric": "stomach", "cerebral": "brain", "splenic": "spleen",
    "intestinal": "intestine", "colonic": "colon", "esophageal": "esophagus", "bronchial": "bronchi", "thymic": "thymus", "pancreatic": "pancreas",
    "ovarian": "ovary", "uterine": "uterus", "prostatic": "prostate", "mammary": "breast", "muscular": "muscle", "neuronal": "neuron", "vascular": "vessel",
    "osseous": "bone", "skeletal": "skeleton", "dermal": "skin", "epidermal": "epidermis", "lingual": "tongue", "nasal": "nose", "ocular": "eye",
    "biliary": "bile", "lymphatic": "lymph", "salivary": "saliva", "adrenal": "adrenal",
}
# Words of histology that name no organ.
STOPS = [
    "tissue", "tissues", "parenchyma", "parenchymal", "sample", "samples", "specimen", "specimens", "cell", "cells", "biopsy", "biopsies", "section", "sections",
    "block", "blocks", "of", "the", "a", "an",
]
# Words that deny what follows.
NEGATIONS = ["no", "not", "never", "absent", "negative", "denied", "without", "unaffected", "neg", "false", "non"]
WORD = r"[A-Za-z][A-Za-z0-9-]+"
#: Candidates that are looked at, the least score of one that stands alone as a word, the score of an exact hit, longest abbreviation.
CANDIDATES, TRUSTED, EXACT, SHORT = 12, 0.45, 0.95, 4


def words(label: Column) -> Column:
    return F.transform(F.regexp_extract_all(label, F.lit(WORD), F.lit(0)), F.lower)


def nouns(label: Column) -> Column:
    """The words of a label with adjectives of organs as nouns and words of histology left out, as a query; null where that is the label itself."""
    noun = F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv])
    kept = F.transform(F.filter(words(label), lambda w: ~w.isin(STOPS)), lambda w: F.coalesce(F.try_element_at(noun, w), w))
    text = F.array_join(kept, " ")
    return F.when((F.size(kept) > 0) & (text != F.lower(F.trim(label))), text)


def word_set(label: Column) -> Column:
    """The words of a label and the nouns of its adjectives, without words of histology."""
    noun = F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv])
    w = words(label)
    both = F.concat(w, F.filter(F.transform(w, lambda x: F.try_element_at(noun, x)), lambda x: x.isNotNull()))
    return F.array_distinct(F.filter(both, lambda x: ~x.isin(STOPS)))


def is_negated(label: Column) -> Column:
    """Whether a label starts with a word that denies the rest."""
    return F.coalesce(F.element_at(F.split(F.lower(F.trim(label)), r"[\s-]+"), 1).isin([n for n in NEGATIONS if n != "unaffected"]), F.lit(False))


@dataclass
class Knowledge:
    """What the tiers look up; a table that is None is empty.

    siblings: (grp, col, raw, id, name, n_uses) resolved labels of a group; history: (col, label, id, name, source, at) earlier answers; vocabulary: (col, term, id, name), a row for
    each name and synonym; minted: (col, label, id); candidates: (col, label, id, name, score) from a search.
    """

    siblings: DataFrame | None = None
    history: DataFrame | None = None
    vocabulary: DataFrame | None = None
    minted: DataFrame | None = None
    candidates: DataFrame | None = None
    prefixes: dict[str, str] = field(default_factory=lambda: {c: f"ART-{c[0:2].upper()}" for c in COLUMNS})


def _open() -> Column:
    return F.col("source").isNull()


def _answer(state: DataFrame, on: Column, id_: Column, name: Column, source: str) -> DataFrame:
    hit = _open() & F.coalesce(on, F.lit(False))
    return state.withColumns({"id": F.when(hit, id_).otherwise(F.col("id")), "name": F.when(hit, name).otherwise(F.col("name")), "source": F.when(hit, F.lit(source)).otherwise(F.col("source"))})


def _lookup(state: DataFrame, keys: dict[str, Column], table: DataFrame, source: str) -> DataFrame:
    """One left join to a table with a row for each of its keys, and columns id and name; rows that are answered have keys of their own, so they neither match nor meet."""
    first, *rest = keys
    salt = F.concat(F.lit("\x00"), F.xxhash64("grp", "col", "label").cast("string"))
    own = {f"_{k}": F.when(_open() & c.isNotNull(), c).otherwise(salt) if k == first else c for k, c in keys.items()}
    right = table.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("id").alias("_id"), F.col("name").alias("_name"))
    on = [F.col(f"_{k}") == F.col(f"_t_{k}") for k in keys]
    met = state.withColumns(own).join(right, on, "left")
    return _answer(met, F.col("_name").isNotNull(), F.col("_id"), F.col("_name"), source).select(*state.columns)


def _one(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return table.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def _only(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that name one id alone."""
    return table.groupBy(*keys).agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.count_distinct("id").alias("_n")).where("_n = 1").drop("_n")


def _overlap(state: DataFrame, siblings: DataFrame) -> DataFrame:
    """Open labels of which the words hold, or lie within, those of a sibling of the same polarity: the most used, then the least.

    A label meets a sibling by one word only, the rarer side's rarest, so common words bring no pairs together.
    """
    sets = lambda df, text: df.withColumn("set", word_set(F.col(text))).where(F.size("set") > 0)
    left = sets(state.where(_open() & F.col("grp").isNotNull()).select("grp", "col", "label"), "label")
    right = sets(siblings.select("grp", "col", "raw", "id", "name", "n_uses"), "raw")
    each = left.select("grp", "col", "set").unionByName(right.select("grp", "col", "set")).select("grp", "col", F.explode("set").alias("w"))
    n = each.groupBy("grp", "col", "w").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, keys: list[str]) -> DataFrame:
        counted = df.select(*keys, F.explode("set").alias("w")).join(n, ["grp", "col", "w"])
        return df.join(counted.groupBy(*keys).agg(F.min(F.struct("n", "w")).alias("r")), keys).withColumn("w", F.col("r.w")).drop("r")

    lk, rk = ["grp", "col", "label"], ["grp", "col", "raw"]
    right = _one(right, rk, [F.desc("n_uses"), F.col("id")])
    far = right.withColumnRenamed("set", "other")
    by_sibling = left.withColumn("w", F.explode("set")).join(rarest(right, rk).withColumnRenamed("set", "other"), ["grp", "col", "w"])
    by_label = rarest(left, lk).join(far.withColumn("w", F.explode("other")), ["grp", "col", "w"])
    denies = lambda s: F.arrays_overlap(F.col(s), F.array(*[F.lit(x) for x in NEGATIONS]))
    within = (F.size(F.array_except("set", "other")) == 0) | (F.size(F.array_except("other", "set")) == 0)
    both = by_sibling.unionByName(by_label).where(within & (denies("set") == denies("other")))
    return _one(both, lk, [F.desc("n_uses"), F.col("raw")]).select(*lk, "id", "name")


def pick(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """(col, label, id, name): the candidate that needs no judge, of labels (col, label) and candidates (col, label, id, name, score).

    Candidates are ranked by how much of their name the label's words explain (all, half, some, nothing), then by score, then by id. Without another the one is taken, and so is the
    first if its name is a single word among the label's with a score of 0.45; a label of at most four characters that shares no word with the first is
    left open, as is everything else.
    """
    own = candidates.groupBy("col", "label", "id").agg(F.max("score").alias("score"), F.min("name").alias("name"))
    met = own.join(labels.select("col", "label").distinct(), ["col", "label"])
    name = F.array_distinct(F.filter(words(F.col("name")), lambda w: ~w.isin(STOPS)))
    met = met.withColumn("_name", name).withColumn("_words", word_set(F.col("label")))
    shared = F.size(F.array_intersect("_name", "_words"))
    cover = shared / F.greatest(F.size("_name"), F.lit(1))
    met = met.withColumn("_shared", shared).withColumn("band", F.when(shared == 0, 0).when(cover >= 1, 3).when(cover >= 0.5, 2).otherwise(1))
    place = Window.partitionBy("col", "label").orderBy(F.desc("band"), F.desc("score"), "id")
    ranked = met.withColumn("_k", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy("col", "label"))).where("_k = 1")
    bare = (F.length(F.trim("label")) <= SHORT) & (F.col("_shared") == 0)
    sure = (F.size("_name") == 1) & (F.col("_shared") == 1) & (F.col("score") >= TRUSTED)
    return ranked.where((F.col("_n") == 1) | (~bare & sure)).select("col", "label", "id", "name")


def resolve(labels: DataFrame, known: Knowledge) -> DataFrame:
    """(grp, col, label, id, name, source) of each distinct label of (grp, col, label).

    Tiers, in order: control (Condition), placeholder (Tissue) and negation give no id; group_exact, group_morphology and group_overlap follow the siblings of a group; history
    the latest earlier answer; vocabulary a term that names one id; minted an earlier id; candidates and rewritten what ``pick`` is sure of among the search's, and of the vocabulary by the
    label's nouns; dose_stripped both again for a Treatment without its doses; new mints an id. Labels are compared in lower case; a null group has no siblings; null and blank
    labels have no row.
    """
    spark = labels.sparkSession
    empty = lambda s: spark.createDataFrame([], s)
    siblings = known.siblings if known.siblings is not None else empty("grp string, col string, raw string, id string, name string, n_uses long")
    history = known.history if known.history is not None else empty("col string, label string, id string, name string, source string, at long")
    vocabulary = known.vocabulary if known.vocabulary is not None else empty("col string, term string, id string, name string")
    minted = known.minted if known.minted is not None else empty("col string, label string, id string")
    candidates = known.candidates if known.candidates is not None else empty("col string, label string, id string, name string, score double")

    text = stripped(F.col("label"))
    none = F.lit(None).cast("string")
    state = labels.select("grp", "col", text.alias("label")).where((F.col("label") != "") & (F.lower("label") != NOT_SPECIFIED.lower())).distinct()
    state = state.withColumns({"id": none, "name": none, "source": none})
    low, blank = F.lower("label"), F.lit("")
    controls = F.create_map(*[F.lit(x) for kv in CONTROLS.items() for x in kv])
    state = _answer(state, (F.col("col") == "Condition") & low.isin(list(CONTROLS)), blank, F.try_element_at(controls, low), "control")
    state = _answer(state, (F.col("col") == "Tissue") & low.isin(PLACEHOLDERS), blank, F.lit(NOT_SPECIFIED), "placeholder")
    state = _answer(state, is_negated(F.col("label")), blank, F.lit(NOT_SPECIFIED), "negation")

    raw = siblings.where(F.col("grp").isNotNull()).withColumn("raw", F.lower(F.trim("raw")))
    by_raw = _one(raw, ["grp", "col", "raw"], [F.desc("n_uses"), F.col("id")])
    state = _lookup(state, {"raw": low, "grp": F.col("grp"), "col": F.col("col")}, by_raw, "group_exact")
    state = _lookup(state, {"raw": nouns(F.col("label")), "grp": F.col("grp"), "col": F.col("col")}, by_raw, "group_morphology")
    state = materialize(state, "cascade-group")
    state = _lookup(state, {"label": F.col("label"), "grp": F.col("grp"), "col": F.col("col")}, _overlap(state, raw), "group_overlap")

    last = _one(history.withColumn("label", F.lower(F.trim("label"))), ["col", "label"], [F.desc_nulls_last("at"), F.col("id")])
    state = _lookup(state, {"label": low, "col": F.col("col")}, last, "history")
    terms = materialize(_only(vocabulary.withColumn("term", F.lower(F.trim("term"))), ["col", "term"]), "cascade-terms")
    state = _lookup(state, {"term": low, "col": F.col("col")}, terms, "vocabulary")
    old = minted.select("col", F.lower(F.trim("label")).alias("label"), "id", F.trim("label").alias("name"))
    state = _lookup(state, {"label": low, "col": F.col("col")}, _one(old, ["col", "label"], [F.col("id")]), "minted")

    state = materialize(state, "cascade-global")
    found = candidates.select("col", F.lower(F.trim("label")).alias("label"), "id", "name", "score")
    exact = vocabulary.select("col", F.lower(F.trim("term")).alias("query"), "id", "name", F.lit(EXACT).alias("score")).distinct()
    ask = state.where(_open()).select("col", low.alias("label"), nouns(F.col("label")).alias("query")).distinct()
    more = ask.join(exact, ["col", "query"]).select("col", "label", "id", "name", "score").unionByName(ask.join(found.withColumnRenamed("label", "query"), ["col", "query"]).select("col", "label", "id", "name", "score"))
    state = _lookup(state, {"label": low, "col": F.col("col")}, pick(ask, found.join(ask.select("col", "label"), ["col", "label"], "left_semi").unionByName(more)), "candidates")
    bare = strip_dose(F.col("label"))
    dose = F.when(F.col("col") == "Treatment", F.lower(bare))
    state = _lookup(state, {"term": dose, "col": F.col("col")}, terms, "dose_stripped")
    ask = state.where(_open() & dose.isNotNull()).select("col", dose.alias("label")).distinct()
    state = _lookup(state, {"label": dose, "col": F.col("col")}, pick(ask, found), "dose_stripped")

    state = materialize(state, "cascade-open")
    new = None
    for c in COLUMNS:
        own = mint(state.where(_open() & (F.col("col") == c)).select("label"), minted.where(F.col("col") == c).select(F.lower(F.trim("label")).alias("label"), "id"), known.prefixes[c])
        own = own.select(F.lit(c).alias("col"), "label", "id")
        new = own if new is None else new.unionByName(own)
    # the name of a minted id is the least of the spellings that share it
    spelled = state.where(_open()).groupBy("col", low.alias("label")).agg(F.min("label").alias("name"))
    return _lookup(state, {"label": low, "col": F.col("col")}, new.join(spelled, ["col", "label"]), "new")


def direct_mint(labels: DataFrame, known: Knowledge) -> DataFrame:
    """``resolve`` by three tiers alone: history, minted, new."""
    return resolve(labels, Knowledge(history=known.history, minted=known.minted, prefixes=known.prefixes)).where(~F.col("source").isin("control", "placeholder", "negation"))


def resolve_records(records: DataFrame, key: str, group: str, known: Knowledge) -> DataFrame:
    """Records with the three label columns resolved: ``key``, and for each column its name, ``<column>_id`` and ``<column>_source``.

    Composite labels are split (at ``;``, for treatments at `` + `` too), their parts resolved and joined by ``; `` in order. Columns are stacked, so that all labels go through one
    cascade, and pivoted back. A null or blank label is Not Specified, with an empty id. ``key`` is unique.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("raw")) for c in COLUMNS])
    long = records.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), F.explode(cells).alias("p")).select("key", "grp", "p.col", F.coalesce("p.raw", F.lit("")).alias("raw"))
    parts = F.when(F.col("col") == "Treatment", split_composite(F.col("raw"), plus=True)).otherwise(split_composite(F.col("raw")))
    parts = long.select("key", "grp", "col", F.posexplode_outer(parts).alias("at", "label"))
    parts = materialize(parts, "cascade-parts")
    found = resolve(parts.select("grp", "col", "label"), known)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("grp", "col", "label")]
    met = parts.alias("l").join(found.alias("r"), same, "left").select("l.key", "l.col", "l.at", "r.id", "r.name", "r.source")
    whole = met.groupBy("key", "col").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "id", "name", "source")))).alias("p"))  # the parts of one label
    text = lambda f: F.array_join(F.transform("p", lambda p: p[f]), "; ")
    named = whole.select("key", "col", F.when(F.size("p") > 0, text("name")).otherwise(NOT_SPECIFIED).alias("name"), text("id").alias("id"), text("source").alias("source"))
    wide = named.groupBy("key").pivot("col", list(COLUMNS)).agg(F.first("name").alias("name"), F.first("id").alias("id"), F.first("source").alias("source"))
    return wide.select(F.col("key").alias(key), *[x for c in COLUMNS for x in (F.col(f"{c}_name").alias(c), F.col(f"{c}_id"), F.col(f"{c}_source"))])
