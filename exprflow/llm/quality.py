"""Quality rules: statistics of whole texts, and decision lists learned from labels.

The list is grown by sequential covering: a rule is a conjunction of thresholds that grows by information gain on
two thirds of the labelled rows, is pruned on the rest, and is kept while it is precise there; rows it covers are
then set aside. What results is an ordered ``when ... when ... otherwise`` of Spark columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrowtext import mix64, slices, split_words, utf8_bytes, windows
from .langid import hash_cut

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Labelled rows that a decision list is fitted on, about at most; chosen by a hash of the row.
FIT_ROWS = 20_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_wordless"]
RATIOS = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "wordless_share": "n_wordless / greatest(n_words, 1)",
}


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each (owner, code) occurs more than once; both arrays are of equal length."""
    with np.errstate(over="ignore"):
        key = mix64(code.astype(np.uint64)) ^ mix64(owner.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each owner."""
    key = np.unique(owner.astype(np.int64) << 32 | code.astype(np.int64))
    return np.bincount(key >> 32, minlength=n)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text; all 0 for a null text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    data, offsets = utf8_bytes(texts)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    sign = np.zeros(256, bool)
    sign[list(SYMBOLS)] = True
    words = split_words(texts)
    owner, at, h = windows(words, REPEAT_WINDOW)
    at = at[_repeats(owner, h)]
    cover = np.bincount(at, minlength=len(words.codes) + REPEAT_WINDOW) - np.bincount(at + REPEAT_WINDOW, minlength=len(words.codes) + REPEAT_WINDOW)
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), n_lines)
    full = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy()
    real = full[line] if len(line) else np.zeros(0, bool)
    line_owner, line = line_owner[real], line[real]
    filled = np.bincount(line_owner, minlength=n)
    letters = pc.match_substring_regex(words.vocab, r"\p{L}").to_numpy(zero_copy_only=False) if len(words.vocab) else np.zeros(0, bool)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(~space[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(sign[data], offsets),
        "n_dup_lines": filled - _distinct(line_owner, line, n),
        "n_repeat_words": _per_text(np.cumsum(cover)[: len(words.codes)] > 0, words.offsets),
        "n_lines": filled,
        "n_distinct_words": _distinct(words.owner, words.codes, n),
        "n_wordless": _per_text(~letters[words.codes], words.offsets),
    }


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        stats = text_stats(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(stats[c], pa.int64()) for c in STATS)], names=["doc_id", *STATS])


def quality_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_stat_batches, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


@dataclass
class Rule:
    """A conjunction: feature, whether values above the threshold match, threshold."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.terms:
            out &= x[name] > t if above else x[name] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.terms:
            value = F.expr(RATIOS[name]).cast("double")
            out = out & (value > t if above else value <= t)
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], max_terms: int) -> Rule:
    rule, live = Rule(), np.ones(len(bad), bool)
    while len(rule.terms) < max_terms and (~bad & live).any():
        p, n = (bad & live).sum(), (~bad & live).sum()
        best, choice = 1e-9, None
        for name, values in x.items():
            v, b = values[live], bad[live]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts[name], "right")
            below = np.concatenate(([0], np.cumsum(b[order])))[at]
            for above, pp, all_ in ((False, below, at), (True, p - below, len(v) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = pp * (np.log2(pp / all_) - np.log2(p / (p + n)))
                gain = np.nan_to_num(gain, nan=-1.0, neginf=-1.0)
                k = int(np.argmax(gain)) if len(gain) else -1
                if k >= 0 and gain[k] > best and 0 < at[k] < len(v):  # in the middle of the gap
                    best, choice = gain[k], (name, above, float(v[order[at[k] - 1]] + v[order[at[k]]]) / 2)
        if choice is None:
            break
        rule.terms.append(choice)
        live = rule.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.terms) - 1, 0, -1):
        shorter = Rule(rule.terms[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.9, min_covered: int = 3, seed: int = 0
) -> list[Rule]:
    """An ordered list of rules for rows that are bad; empty if one of the classes is missing."""
    rules: list[Rule] = []
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65))) if len(v) else v for k, v in x.items()}
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (bad & left & part).any() and (~bad & left & part).any():
        pick = lambda m: {k: v[m] for k, v in x.items()}
        grow, check = left & part, left & ~part
        rule = _prune(_grow(pick(grow), bad[grow], cuts, max_terms), pick(check), bad[check])
        covered = rule.covers(x) & left
        held = covered & ~part
        if not rule.terms or covered.sum() < min_covered or bad[held].sum() < min_precision * max(1, held.sum()) or bad[covered].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """True for rows that no rule covers; a column over STATS."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> list[Rule]:
    """Learn from the labelled rows of ``stats``; ``labels`` holds doc_id and quality (0 is bad).

    Null labels count for nothing; of several labels of a doc_id the lowest holds. At most about
    ``fit_rows`` rows come to the driver, those with the smallest 64-bit hashes, as seven numbers each; rows alike in all of them count once.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    features = [F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()]
    seen = stats.join(known, "doc_id").select("doc_id", "quality", *features).withColumn("u", F.xxhash64("doc_id", *RATIOS, F.lit(17)))
    seen = materialize(seen, "quality-fit")
    n = seen.count()
    drawn = seen if n <= fit_rows else seen.where(F.col("u") <= F.lit(hash_cut(fit_rows, n)))
    sample = drawn.distinct().drop("u").toPandas().sort_values(["doc_id", *RATIOS], ignore_index=True)
    return learn_rules({k: sample[k].to_numpy(float) for k in RATIOS}, (sample["quality"] == 0).to_numpy(), **options)


def base_failed() -> Column:
    """Over STATS: fewer than MIN_WORDS words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Return per row: doc_id, STATS, base_failed, kept.

    base_failed: n_words < 20, or 100 * n_repeat_words > 30 * n_words. kept: not base_failed, and no learned
    rule covers the row. A null or empty text has no words and fails. Repeated rows are judged alike.
    Without labels of both kinds nothing is learned and base_failed decides. Other columns are ignored.
    """
    stats = materialize(quality_stats(docs), "quality-stats")
    good = rules_column(fit_rules(stats, labels, **options))
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"))


def _with_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        stats = text_stats(part.column("text"))
        packed = pa.StructArray.from_arrays([pa.array(stats[c], pa.int64()) for c in STATS], STATS)
        yield pa.RecordBatch.from_arrays([*part.columns, packed], names=[*part.schema.names, STATS_COLUMN])


#: Column that holds STATS beside the columns of documents while they are filtered.
STATS_COLUMN = "_exprflow_quality_stats"


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns they came with, whatever their names but STATS_COLUMN.

    The statistics are computed once and written beside the documents; the rules are Spark conditions over them.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(STATS_COLUMN, T.StructType.fromDDL(", ".join(f"{c} long" for c in STATS)))])
    both = materialize(docs.mapInArrow(_with_stats, schema), "quality-documents")
    stats = both.select("doc_id", f"{STATS_COLUMN}.*")
    kept = ~base_failed() & rules_column(fit_rules(stats, labels, **options))
    judged = both.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), f"{STATS_COLUMN}.*")
    return judged.where(kept).select("doc.*")
