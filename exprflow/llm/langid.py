"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed into ``BUCKETS`` features. Document frequencies cover all
labelled documents that may be learned from, and so does the list of languages. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a sample of bounded size that holds each language,
part of which is left to fit the temperature of the probabilities. Prediction runs over the whole text of every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrowtext import slices

BUCKETS = 1 << 15
#: Labelled rows that the weights and the temperature are fitted on, at most (or one a language, if there are more
#: languages); rows of each language at least, if it has them. Chosen by a hash of doc_id and text.
FIT_ROWS, LEAST_ROWS = 3_000, 50
UNDECIDED = "und"
_SALT = [(0, 0x9E3779B1), (0x85EBCA6B, 0xC2B2AE35), (0x27D4EB2F, 0x165667B1)]


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    out = np.full(0x110000, 0x20, np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    out[letters] = letters
    return out


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, bool]]:
    """(count of each feature, whether there is a letter) of each text."""
    fold = _fold()
    for text in texts.to_pylist():
        c = fold[np.frombuffer(f"  {(text or '').lower()}  ".encode("utf-32-le", "replace"), np.uint32)]
        c = c[np.concatenate(([True], (c[1:] != 0x20) | (c[:-1] != 0x20)))]  # one blank between words
        if not (c != 0x20).any():
            yield np.zeros(BUCKETS, np.int64), False
            continue
        h1 = c * np.uint32(_SALT[0][1])
        h2 = (h1[:-1] ^ np.uint32(_SALT[1][0])) * np.uint32(5) + c[1:] * np.uint32(_SALT[1][1])
        h3 = (h2[:-1] ^ np.uint32(_SALT[2][0])) * np.uint32(7) + c[2:] * np.uint32(_SALT[2][1])
        h = np.concatenate((h1, h2, h3))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield np.bincount(h >> np.uint32(32 - 15), minlength=BUCKETS), True


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    x *= idf
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for part in slices(batches, "text"):
        for counts, _ in _features(part.column("text")):
            df += counts > 0
            n += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["feature", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = [(np.flatnonzero(c), c, ok) for c, ok in _features(part.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("lang"),
                pa.array([i.astype("<u2").tobytes() for i, _, _ in found], pa.binary()),
                pa.array([c[i].astype("<u4").tobytes() for i, c, _ in found], pa.binary()),
                part.column("u"),
            ],
            names=["doc_id", "lang", "at", "n", "u"],
        )


@dataclass
class Model:
    """Languages, inverse document frequencies, weights, biases, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return _tfidf(counts, self.idf) @ self.weights + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for counts, letters in _features(texts):
            if not letters or not self.languages:
                names.append(UNDECIDED)
                scores.append(0.0)
                continue
            z = self.logits(counts).astype(float) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            names.append(self.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return names, np.array(scores)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the softmax: (weights, biases). A row is (features, values, class)."""
    z, n = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)).astype(np.float32)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, np.float32(1))
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :].astype(np.float32)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the held-back labels likeliest, by golden-section search."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

    if not len(y):
        return 1.0
    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fit(idf: np.ndarray, languages: list[str], options: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "lang", "at"], ignore_index=True)
        code = {x: i for i, x in enumerate(languages)}
        rows = []
        for at, n, lang in zip(pdf["at"], pdf["n"], pdf["lang"], strict=True):
            at = np.frombuffer(at, "<u2").astype(np.int64)
            x = np.frombuffer(n, "<u4").astype(np.float32) * idf[at]
            rows.append((at, x / max(float(np.sqrt(x @ x)), 1e-9), code[lang]))
        held_back = (pdf.groupby("lang").cumcount() % 5 == 4).tolist()  # so the first rows of each language are learned from
        held = [r for r, h in zip(rows, held_back, strict=True) if h]
        w, b = follow_the_leader([r for r, h in zip(rows, held_back, strict=True) if not h], len(languages), **options)
        logits = np.array([x @ w[at] + b for at, x, _ in held]).reshape(len(held), len(languages))
        t = calibrate(logits, np.array([y for *_, y in held], int))
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [b.tobytes()], "temperature": [t], "zeros": [float((w == 0).mean())]})

    return run


def quotas(sizes: dict[str, int], fit_rows: int) -> dict[str, int]:
    """Rows to fit on of each language: all if they fit, else LEAST_ROWS each and the rest in proportion."""
    n = sum(sizes.values())
    if n <= fit_rows:
        return dict(sizes)
    least = max(1, min(LEAST_ROWS, fit_rows // len(sizes)))
    rest = max(0, fit_rows - least * len(sizes))
    return {x: min(k, least + rest * k // n) for x, k in sizes.items()}


def hash_cut(quota: int, size: int) -> int:
    """The signed 64-bit bound that about ``quota`` of ``size`` even hashes stay below, with a margin of six deviations."""
    want = math.ceil(quota + 6 * math.sqrt(quota) + 10)
    return min((1 << 63) - 1, want * (1 << 64) // size - (1 << 63))


def train(
    docs: DataFrame, learnable: Column, fit_rows: int = FIT_ROWS, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 1e-4, seed: int = 3
) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``learnable`` holds and lang isn't null.

    Texts without a letter teach nothing. Each language of the rest is learned, however rare. Without rows there are no languages, and all is undecided.
    """
    known = docs.select("doc_id", "text", "lang").where(F.coalesce(learnable, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS)
    n = int(counts.loc[counts["feature"] < 0, "df"].sum())
    some = counts[counts["feature"] >= 0]
    df[some["feature"]] = some["df"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    hashed = known.withColumn("u", F.xxhash64("doc_id", "text", F.lit(29)))
    found = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("first")).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    quota = quotas({r["lang"]: r["n"] for r in found}, fit_rows)
    cuts = [(r["lang"], max(r["first"], hash_cut(quota[r["lang"]], r["n"])), quota[r["lang"]]) for r in found]
    cuts = docs.sparkSession.createDataFrame(cuts, "lang string, cut long, quota long")
    drawn = hashed.join(F.broadcast(cuts.select("lang", "cut")), "lang").where("u <= cut").select("doc_id", "text", "lang", "u")
    # repeated rows have one hash and count once, so no language sorts more than its quota and the margin
    drawn = drawn.mapInArrow(_sparse, "doc_id long, lang string, at binary, n binary, u long").dropDuplicates(["lang", "u"])
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).join(F.broadcast(cuts.select("lang", "quota")), "lang")
    sample = materialize(drawn.where("k <= quota").select("doc_id", "lang", "at", "n"), "langid-sample")
    options = {"epochs": epochs, "alpha": alpha, "beta": beta, "l1": l1, "l2": l2, "seed": seed}
    fitted = sample.groupBy().applyInPandas(_fit(idf, languages, options), "weights binary, bias binary, temperature double, zeros double").first()
    w = np.frombuffer(fitted["weights"], np.float32).reshape(BUCKETS, len(languages))
    return Model(languages, idf, w, np.frombuffer(fitted["bias"], np.float32), fitted["temperature"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """Return per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows that aren't held out. lang_pred is ``und`` with score 0 for a null text, a text without a letter, or
    if there was nothing to learn from. Only the text decides, so rows with equal texts get equal results. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out(F.col("doc_id")), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names, scores = model.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages with at least ``min_score``; same columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out(F.col("doc_id")), **options))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names, scores = model.value.predict(part.column("text"))
            good = pc.and_(pc.not_equal(pa.array(names, pa.string()), UNDECIDED), pa.array(scores >= min_score, pa.bool_()))
            yield part.filter(good).select(columns)

    return docs.mapInArrow(run, docs.schema)
