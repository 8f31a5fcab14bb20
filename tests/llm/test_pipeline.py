"""The corpus pipeline: each stage against a plain version of what it decides, and the whole of it."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from exprflow.llm import langid, mixing, neardup, quality
from exprflow.session import materialize, read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = read_table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, got)
        docs = got
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stage_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "pack_sequences"]
    columns = read_table(spark, SF, "documents").columns
    assert all(stages[n][1].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_language_stage_keeps_identified_texts(stages):
    docs, kept = stages["language_id"]
    judged = {r.doc_id: r.lang_pred != "und" and r.score >= 0.5 for r in langid.identify(docs).collect()}
    assert rows(kept) == Counter({k: n for k, n in rows(docs).items() if judged[k[0]]})
    assert 0 < kept.count() < docs.count() + 1


def test_language_of_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_quality_stage_equals_rules_by_hand(spark, stages):
    docs, kept = stages["quality_rules"]
    labels = read_table(spark, SF, "labels")
    rules = quality.fit_rules(quality.quality_stats(docs), labels)

    def good(text):
        w = words(text) if text else []
        n = max(len(w), 1)
        t = text or ""
        plain = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(plain[i : i + 8]) for i in range(len(plain) - 7))
        repeated = len({j for i in range(len(plain) - 7) if grams[tuple(plain[i : i + 8])] > 1 for j in range(i, i + 8)})
        x = {
            "n_words": len(plain), "mean_word": sum(map(len, plain)) / n, "symbols_per_word": sum(c in "#*$%&|<>" for c in t) / n,
            "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_share": repeated / n, "distinct_share": len(set(plain)) / n,
            "wordless_share": sum(not any(map(str.isalpha, p)) for p in plain) / n,
        }
        if len(plain) < 20 or 100 * repeated > 30 * len(plain):
            return False
        return not any(all((x[k] > c) == above for k, above, c in r.terms) for r in rules)

    assert rows(kept) == Counter({k: n for k, n in rows(docs).items() if good(k[1])})


def test_near_dedup_stage_equals_all_pairs(stages):
    docs, kept = stages["near_dedup"]
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items() if w}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in ids if find(i) == i} | {i for i, w in texts.items() if not w}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)


def test_mix_stage_takes_what_its_plan_says(stages):
    docs, mixed = stages["mix_sources"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_plan(docs).collect()}
    got: dict[int, list[str]] = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i, (n, size) in taken.items():
        assert sum(len(WORD.findall(t)) for t in got.get(i, [])) == n
        assert all(texts[i].startswith(t) for t in got.get(i, [])) and sum(t != texts[i] for t in got.get(i, [])) <= 1


def test_pack_stage_and_run(spark, stages):
    from tokenizers import Tokenizer

    from exprflow.llm.tokens import tokenizer_path

    docs, packed = stages["pack_sequences"]
    lib = Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, len(e) - 0, zlib.crc32(e.tobytes())) for r in docs.collect() for e in [np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")])
    got = packed.collect()
    assert sum(r.length for r in got) == sum(k[1] * n for k, n in want.items())
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert whole and not whole - want
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: Counter(tuple(r) for r in df.select(columns).collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(packed)


def test_bands_find_pairs_at_the_threshold():
    """Recall of the band search for pairs of sets at a similarity of just 0.8 or above, of any size."""
    rng = np.random.default_rng(9)
    for n in (5, 9, 40, 300, 2000):
        met = 0
        for _ in range(60):
            both = round(n * 0.8 + 0.4999)
            extra = n - both
            h = rng.integers(0, 1 << 63, both + extra, dtype=np.uint64)
            a, b = np.sort(h), np.sort(h[:both])
            assert len(b) / len(a) >= 0.8
            regs = neardup.registers(np.array([0, len(a), len(a) + len(b)]), np.concatenate((a, b)))
            keys = neardup.band_keys(regs)
            met += bool((keys[0] == keys[1]).any())
        assert met == 60


def test_every_stage_takes_an_empty_table_and_nulls(spark):
    base = read_table(spark, SF, "documents")
    odd = base.limit(0).union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (3, None, "en", None, 1)], base.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.limit(0), SF).count() == 0
        n = stage(spark, odd, SF).count()
        assert n == {"language_id": 0, "quality_rules": 0, "near_dedup": 3, "mix_sources": 3, "pack_sequences": 3}[name]
