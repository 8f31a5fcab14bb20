"""License scans: alignment against brute force, recall of damaged notices, and hard texts."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from exprflow.llm import licenses
from exprflow.llm.arrowtext import split_words

RNG = np.random.default_rng(3)


def best_score(template, text):
    """The best score of a template in a text, by all cells."""
    row = [0] * (len(text) + 1)
    for x in template:
        new = [row[0] - 1]
        for j, y in enumerate(text, 1):
            new.append(max(row[j] - 1, row[j - 1] + (1 if x == y else -1), new[-1] - 1))
        row = new
    return max(row)


def test_alignment_equals_brute_force():
    for _ in range(300):
        n, m = int(RNG.integers(1, 14)), int(RNG.integers(1, 30))
        a, b = RNG.integers(0, 5, n), RNG.integers(0, 5, m)
        score, hits, start, end = licenses.align(a, b, band=n + m)
        assert score == best_score(a, b)
        assert 0 <= start <= end <= m and hits <= n
        # the part between start and end holds the hits, and has this score by itself
        assert best_score(a, b[start:end]) == score


def test_the_band_holds_alignments_that_stay_in_it():
    for _ in range(100):
        t = RNG.integers(0, 1000, 40)
        w = [x for x in t.tolist() if RNG.random() > 0.08]
        for _ in range(2):
            w.insert(int(RNG.integers(len(w))), -1)
        text = np.array([-5] * int(RNG.integers(0, 12)) + w + [-6] * int(RNG.integers(0, 12)))
        assert licenses.align(t, text, band=8)[0] == best_score(t, text)


def found(texts, **options):
    templates = options.pop("templates", licenses.TEMPLATES)
    return licenses.scan(split_words(pa.array(texts, pa.string()), lower=True), templates, options.pop("min_coverage", licenses.MIN_COVERAGE))


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0", "MIT-text", "Apache-2.0-notice", "BSD-3-Clause-text", "Zlib"])
def test_recall_of_damaged_notices(name):
    """A fifth of the words replaced, but not those that decide which license and version it is."""
    body = licenses.TEMPLATES[name].split()
    free = [i for i, w in enumerate(body) if not licenses.deciding([w.strip(licenses.SIGNS).lower()]) and not any(c.isdigit() for c in w) and w.strip(licenses.SIGNS).lower() not in licenses.AFTER]
    texts = []
    for k in range(100):
        w = list(body)
        for i in RNG.permutation(free)[: len(body) // 5]:
            w[i] = f"zz{k}"
        texts.append("Some words of other kinds here. " + " ".join(w) + " And more of them after it.")
    hits = {d for d, *_ in found(texts, templates={name: licenses.TEMPLATES[name]})}
    assert len(hits) >= 90


def test_winnowing_keeps_the_smallest_of_each_window():
    h = RNG.integers(0, 1 << 60, 200).astype(np.uint64)
    kept = licenses.winnow(h, 4)
    assert all(any(i <= k < i + 4 and h[k] == h[i : i + 4].min() for k in kept) for i in range(197))
    assert licenses.winnow(h[:3], 4) == [0, 1, 2]


def test_long_repetitive_texts_take_little_time():
    text = "of the License, in a b c " * 20_000
    began = time.perf_counter()
    assert found([text]) == []
    assert time.perf_counter() - began < 20
    text = "x y z " * 30_000 + "Released under the MIT License. " + "under the terms of the " * 10_000
    got = found([text, None, "", " "])
    assert [(d, n) for d, n, *_ in got] == [(0, "MIT")] and got[0][4] == 90_000


def test_ties_repeats_and_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"{mit} {mit}", "a"), (1, f"{mit} {mit}", "a"), (None, mit, "b"), (2, None, "c"), (3, "", "d"), (4, "Released under the ISC License maybe", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.license, r.start, r.end) for r in licenses.scan_licenses(d).collect())
    n = len(mit)
    assert got == Counter({(1, "MIT", 0, n): 2, (1, "MIT", n + 1, 2 * n + 1): 2, (None, "MIT", 0, n): 1, (4, "ISC", 0, 30): 1})
