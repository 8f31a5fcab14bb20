"""Each operator against a brute-force version, a round trip or held-out accuracy, with odd inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprflow.llm import html, langid, licenses, lmscore, mixing, neardup, packing, quality, tokenfile, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k int"
RNG = np.random.default_rng(5)


def sentence(n, lang="en"):
    parts = {"en": "the ing er th and re on", "de": "sch ung der ein ich keit ge"}[lang].split()
    return " ".join("".join(RNG.choice(parts, RNG.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        out.append((i, sentence(int(RNG.integers(30, 120)), lang), lang, f"s{i % 4}" if i % 11 else None))
    base = out[7][1].split()
    for j in range(12):
        w = list(base)
        w[int(RNG.integers(len(w)))] = f"x{j}"
        out.append((200 + j, " ".join(w), "en", "s0"))
    out += [(300, out[3][1], "de", "s1"), (301, out[3][1].upper(), "de", "s1"), (302, None, None, None), (303, "", "en", "s2"), (304, " \t\n", "en", "s2")]
    out += [(305, "one two", "en", "s2"), (306, "One  TWO", "en", "s2"), (307, "123 456 !", "en", "s3"), (308, sentence(4000), "en", "s3"), (309, "élan ’quoted’ don't re-do, O'Neill's", "en", "s3")]
    return [(a, b, c, d, len(b or ""), 0) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    t = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def test_mix_meets_targets_and_caps(docs, rows, empty):
    got = mixing.mix_plan(docs).toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"].sum() - per["target"].sum()) == pytest.approx(0)
    assert (abs(per["taken"] - per["target"]) <= 0.5).all() and (per["target"] <= 3 * per["size"] + 1e-9).all()
    again = mixing.mix_plan(docs).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.values.tolist()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert sum(n.values()) == got["taken"].sum()
    assert mixing.mix_plan(empty).count() == 0


def test_mix_counts_repeated_rows_once_each(spark):
    d = spark.createDataFrame([(1, "a b c", "x")] * 4 + [(2, "d e", "y")], "doc_id long, text string, source string")
    plan = mixing.mix_plan(d, weights=(1.0, 1.0))
    assert mixing.mix(d, weights=(1.0, 1.0)).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan.agg(F.sum("taken")).first()[0]


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    sets = {}
    for i, text, *_ in rows:
        w = words(text, True)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 6)
    base = sentence(60).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # a chain: each differs in one more word
        w = list(base)
        w[: i // 2] = [f"z{k}" for k in range(i // 2)]
        rows.append((i, " ".join([*w, f"e{i}"])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = list(range(len(rows)))
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == dict(enumerate(root))


def test_drop_near_duplicates_with_null_and_repeated_ids(spark):
    t = [sentence(40) for _ in range(5)]
    rows = [(None, t[0], "a"), (1, t[1], "a"), (5, t[1], "b"), (5, t[2], "a"), (5, t[2], "a"), (5, t[3], "a"), (None, t[3], "a"), (None, t[4], "a"), (None, t[4], "b")]
    d = spark.createDataFrame(rows + [(None, None, "a"), (5, " ", "a")], "doc_id long, text string, source string")
    got = neardup.drop_near_duplicates(d)
    assert got.columns == d.columns
    want = [(None, t[0]), (1, t[1]), (5, t[2]), (5, t[3]), (None, t[4]), (None, None), (5, " ")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    marks = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d).where("doc_id is null").collect()]
    assert sorted(map(str, marks)) == sorted(map(str, [(None, None, True)] * 4 + [(None, 5, False)]))


def test_register_estimate_is_unbiased():
    h = RNG.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(h[:600]), np.sort(h[150:750])
    regs = neardup.registers(np.array([0, 600, 1200]), np.concatenate((a, b)))
    p = neardup.chance(600)
    assert ((regs[0] == regs[1]).mean() - p) / (1 - p) == pytest.approx(450 / 750, abs=0.1)


def test_language_id_on_held_out(docs, rows, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i in (302, 303, 304, 307):
        assert got[i].lang_pred == "und" and got[i].score == 0
    for i, _, lang, *_ in rows[:120]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert not got[i].held_out or got[i].lang_pred == lang
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty).count() == 0


def test_language_id_learns_rare_languages_from_a_small_sample(spark):
    rows = [(i, sentence(12), "en") for i in range(1500)] + [(5000 + i, sentence(12, "de"), "de") for i in range(12)] + [(None, "qua zyx vox " * 3 + str(i), "la") for i in range(9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), fit_rows=30)
    assert model.languages == ["de", "en", "la"]
    import pyarrow as pa

    assert model.predict(pa.array([sentence(30, "de"), sentence(30), "vox qua zyx qua"]))[0] == ["de", "en", "la"]


def test_language_quotas_and_hash_cuts_at_any_size():
    got = langid.quotas({"a": 6_000_000, "b": 500, "c": 3}, 3000)
    assert got["b"] >= langid.LEAST_ROWS and got["c"] == 3 and sum(got.values()) <= 3000
    assert langid.quotas({"a": 20, "b": 1}, 3000) == {"a": 20, "b": 1}
    for n in (10**4, 10**10, 10**14):
        assert 50 < n * (langid.hash_cut(50, n) + 2**63) / 2**64 < 120


def test_top_k_equals_brute_force(spark):
    v = RNG.normal(size=(300, 16))
    v[5] = v[10]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")]), (1200, []), rows[50]]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    q = {i: np.floor(256 * np.array(r)).astype(int) for i, r in enumerate(v)} | {1200: np.zeros(0, int)}
    want = set()
    for i in (x for x in q if x % 50 == 0):
        s = sorted(((-int(q[i] @ q[j]) if len(q[i]) == len(q[j]) else 0, j) for j in q if j != i))
        want |= {(i, k + 1, j, -t) for k, (t, j) in enumerate(s[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_language_model_equals_brute_force(docs, rows, empty):
    texts = {i: words(t, True) for i, t, *_ in rows}
    one, two = Counter(w for t in texts.values() for w in t), Counter(p for t in texts.values() for p in zip(t, t[1:], strict=False))
    total = sum(one.values())
    got = {r.doc_id: r for r in lmscore.stupid_backoff(docs, chunk_bytes=4000).collect()}
    for i, t in texts.items():
        own, own2 = Counter(t), Counter(zip(t, t[1:], strict=False))
        s, back, unseen = [], 0, 0
        for k, w in enumerate(t):
            c1 = one[w] - own[w]
            unseen += c1 == 0
            p = np.log10(max(c1, 1) / max(total - len(t), 1)) + (0 if c1 else np.log10(0.4))
            if k:
                c2 = two[t[k - 1], w] - own2[t[k - 1], w]
                back += c2 == 0
                p = np.log10(c2 / (one[t[k - 1]] - own[t[k - 1]])) if c2 else p + np.log10(0.4)
            s.append(p)
        r = got[i]
        assert (r.n_words, r.n_backoff, r.n_unseen) == (len(t), back, unseen)
        assert r.score is None if not t else r.score == pytest.approx(np.mean(s))
    assert lmscore.stupid_backoff(empty).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_longer_language_models_equal_brute_force(docs, rows, order):
    from exprflow.llm import queries

    assert "op5_lm_score_trigrams" in queries.queries()
    texts = {i: words(t, True) for i, t, *_ in rows}
    grams = lambda t: Counter(tuple(t[a : a + k]) for k in range(1, order + 1) for a in range(len(t) - k + 1))
    every = sum((grams(t) for t in texts.values()), Counter())
    total = sum(map(len, texts.values()))
    got = {r.doc_id: r for r in lmscore.stupid_backoff(docs, chunk_bytes=4000, order=order).collect()}
    for i, t in texts.items():
        own = grams(t)
        c = lambda g: every[g] - own[g]  # noqa: B023, E731

        def p(g):
            if len(g) == 1:
                return (c(g) or 0.4) / max(total - len(t), 1)  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) else 0.4 * p(g[1:])  # noqa: B023

        longest = [tuple(t[max(0, k - order + 1) : k + 1]) for k in range(len(t))]
        assert (got[i].n_words, got[i].n_backoff) == (len(t), sum(len(g) > 1 and not c(g) for g in longest))
        assert got[i].score is None if not t else got[i].score == pytest.approx(np.mean([np.log10(p(g)) for g in longest]))


def encoded(rows, end):
    """By the library itself, with its defaults."""
    from tokenizers import Tokenizer

    from exprflow.llm.tokens import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x, *_ in rows}


@pytest.mark.parametrize("min_cut", [1, 64])
def test_pack_holds_each_id_once(docs, rows, empty, min_cut):
    want = encoded(rows, 1)
    got = packing.pack(docs, min_cut=min_cut).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(want[i]) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(want[i][a : a + n].tobytes()) == c for a, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    assert set(got["doc_id"]) == set(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
        assert min_cut > 1 or g["length"].sum() & (g["length"].sum() - 1) == 0
    assert packing.pack(empty).count() == 0


def test_pack_without_min_cut_pads_and_cuts_little(spark, docs, rows, empty):
    want = encoded(rows, 1)
    got = packing.pack(docs.withColumn("class", F.lit("x")).withColumn("place", F.lit(1))).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(want[i]) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(want[i][a : a + n].tobytes()) == c for a, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    assert set(got["doc_id"]) == set(want)
    used = got.groupby("sequence_id")["length"].sum()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    assert 2048 * len(used) - used.sum() < 2048 + 0.03 * used.sum() and len(got) < 3 * len(rows)
    assert packing.pack(empty).count() == 0
    same = spark.createDataFrame([(None, "a b")] * 3 + [(None, None), (4, "a b")], "doc_id long, text string")
    assert sorted(r.length for r in packing.pack(same).collect()) == [1, 3, 3, 3, 3]


def test_reciprocal_cuts_fill_sequences_of_each_class():
    n = np.arange(1, 5000)
    d, start, size = packing.cut_reciprocal(n, 2048, 64)
    assert (np.bincount(d, size) == n).all() and (size > 0).all() and (size <= 2048).all()
    assert (start == np.concatenate([np.cumsum(size[d == i]) - size[d == i] for i in range(len(n))])).all()
    k = 2048 // size
    assert (2048 - k * size <= np.maximum(64, k)).all()
    seq, offset = packing.first_fit(np.array([1000, 30, 2048, 1048, 30, 5, 1000]), 2048)
    assert seq.tolist() == [1, 2, 0, 1, 2, 2, 2] and offset.tolist() == [1048, 1000, 0, 0, 1030, 1060, 0]


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = RNG.integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    assert (tokenfile.unpack_bits(tokenfile.pack_bits(ids, bits), bits, len(ids)) == ids).all()


@pytest.mark.parametrize("vocabulary", [49_408, 1 << 17])
def test_token_files_round_trip(spark, docs, rows, empty, tmp_path, vocabulary):
    want, at = encoded(rows, 2), 0
    folder = f"file://{tmp_path}/t"
    tokenfile.write_tokens(docs, folder, vocabulary=vocabulary)
    got = {r.doc_id: r for r in tokenfile.read_digests(spark, folder).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), zlib.crc32(want[i].tobytes()))
        at += len(want[i])
    import pyarrow as pa

    first = spark.read.parquet(f"{folder}/manifest").orderBy("shard").first()
    reader = tokenfile.ShardReader(pa.OSFile(f"{tmp_path}/t/{first.file}"))
    k = len(reader.doc_ids) // 2
    assert (reader.document(k) == want[reader.doc_ids[k].as_py()]).all()
    assert tokenfile.token_digests(empty).count() == 0


def test_token_files_keep_null_and_repeated_ids(spark):
    texts = {t: encoded([(0, t)], 2)[0] for t in [f"t{i} word" for i in range(40)] + [None, "<|endoftext|> x", "İ."]}
    rows = [(None, t) for t in list(texts)[:30]] + [(7, t) for t in list(texts)[20:]] + [(i, "a b") for i in (9, 3)] + [(None, "t1 word")] * 2
    texts["a b"] = encoded([(0, "a b")], 2)[0]
    got = tokenfile.token_digests(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")), shards=5).collect()
    want = Counter((i, len(texts[t]), zlib.crc32(texts[t].tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[:2] == [3, 7] and ids[-33] == 9 and ids[-32:] == [None] * 32


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div><article><h1>Title &amp; more</h1>'
        "<p>First  paragraph with a fair number of words in it &eacute;.<br>Next line<p>Second <b>bold</b> paragraph, unclosed, and long enough to count.<p>Short.</p>"
        '<form>Mail <input></form><div class="comments"><p>A reader says that this is a very long comment, longer than all.</div></article><script>var t="</p>";</script>'
        "<aside>Side</aside><footer>&copy; me</footer></body></html>"
    )
    got = html.main_text(page)
    assert got == "Title & more\n\nFirst paragraph with a fair number of words in it é. Next line\n\nSecond bold paragraph, unclosed, and long enough to count.\n\nShort."
    bare = "<body><div id='menu'><a>x</a></div><div><p>" + "word " * 40 + "<p>" + "more " * 40 + "</div><div class='footer'>end</div>"
    assert html.main_text(bare) == ("word " * 40).strip() + "\n\n" + ("more " * 40).strip()
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>"), (5, "x", "plain & simple")]
    out = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (out[1].n_chars, out[2].text, out[3].text, out[4].text, out[5].text) == (len(got), "", "", "", "plain & simple")


def test_html_without_article_and_with_wrappers():
    lead, body = "A lead of some words that opens it. " * 3, "The body goes on with many more words than that. " * 20
    lead, body = lead.strip(), body.strip()
    menu = "<div><a href=x>One page</a> <a href=y>Another page</a> <a href=z>A third page</a></div>"
    post = f"<body>{menu}<div class=post><h1>Head</h1><div class=lead><p>{lead}</div><div class=body><p>{body}</div></div><div class=site-footer>end</div>"
    assert html.main_text(post) == f"Head\n\n{lead}\n\n{body}"
    for inner in ("section", "blockquote"):
        assert html.main_text(f"<body>{menu}<div><h1>Head</h1><p>{lead}</p><{inner}><p>{body}</{inner}><p>{lead}</div>") == f"Head\n\n{lead}\n\n{body}\n\n{lead}"
    want = f"{lead}\n\n{body}"
    aside = "<div class='sidebar'><p>Beside it</div>"
    assert html.main_text(f"<div class='content has-sidebar'><article class='post no-comments'><p>{lead}<p>{body}</article>{aside}</div>") == want
    assert html.main_text(f"<div class='content has-sidebar'><p>{lead}<p>{body}{aside}</div>") == want
    assert html.main_text(f"<div class='widget'><article><p>{lead}<p>{body}</article>{aside}</div>") == want
    assert html.main_text(f"<div class='widget'><p>{lead}<p>{body}</div>{aside}") == want
    assert html.main_text(f"<article><p>{lead}<p>{body}</article><div class=comments><article><p>{lead}</article></div>") == want


def test_license_scan(spark, empty):
    gpl = licenses.TEMPLATES["GPL-3.0-notice"]
    damaged = gpl.replace("redistribute it", "share").replace("Foundation,", "Foundation, plainly")
    rows = [(1, f"a b c\n{gpl.upper()} d"), (2, f"{sentence(50)} {damaged} x"), (3, "Released under the MIT License. y. Released under the MIT License."), (4, sentence(200)), (5, None), (6, "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    one = got[(got["doc_id"] == 1) & (got["license"] == "GPL-3.0-notice")].iloc[0]
    assert one["coverage"] == 1 and rows[0][1][one["start"] : one["end"]] == gpl.upper()
    assert 0.8 <= got[(got["doc_id"] == 2) & (got["license"] == "GPL-3.0-notice")]["coverage"].iloc[0] < 1
    assert (got["doc_id"] == 3).sum() == 2 and set(got["doc_id"]) == {1, 2, 3}
    assert licenses.scan_licenses(empty).count() == 0


def test_license_scan_tells_versions_and_variants_apart(spark):
    notice, gnu = licenses.TEMPLATES, "This work is licensed under the GNU {}General Public License, version {}."
    cases = {
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 1.0.": None,
        gnu.format("", 2): "GPL-2.0", gnu.format("", 3): "GPL-3.0", gnu.format("", 9): None, gnu.format("Lesser ", 3): "LGPL-3.0", gnu.format("Affero ", 3): "AGPL-3.0",
        "Licensed under the Apache License, Version 1.1.": None,
    } | {notice[k]: k for k in ("MIT", "Apache-2.0-notice", "BSD-2-Clause-text", "BSD-3-Clause-text", "MPL-2.0-notice", "ISC-text", "Unlicense", "CC0-1.0-notice", "LGPL-2.1-notice")}
    texts = [f"Some words before. {t} And after it." for t in cases]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {t: got.get(i) for i, t in enumerate(cases)} == {t: k and [k] for t, k in cases.items()}


def test_quality_rules(spark, docs, empty):
    good = [(i, sentence(60), 1) for i in range(300)]
    bad = [(1000 + i, " | ".join(sentence(60).split()), 0) for i in range(100)]
    salad = [(2000, "same eight words here again and again ok " * 8, 1), (2001, "too short", 1), (2002, None, None), (2003, "a\na\n\n \na b # $\n", 0)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad + salad], "doc_id long, text string")
    lab = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(d, lab).collect()}
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in bad)
    assert got[2000].base_failed and got[2000].n_repeat_words == got[2000].n_words and got[2001].base_failed and got[2002].n_words == 0
    assert (got[2003].n_dup_lines, got[2003].n_symbols, got[2003].word_chars) == (1, 2, 6)
    assert quality.filter_documents(d, lab).count() == sum(r.kept for r in got.values())
    assert quality.judge(empty, lab).count() == 0 and quality.judge(d, lab.limit(0)).where("kept").count() == 400


def plain_stats(text):
    """STATS by plain Python."""
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct_words": len(set(w)), "n_wordless": sum(not any(map(str.isalpha, x)) for x in w),
    }


def odd_texts():
    pieces = ["a", "b", "été", "##", "$5", "<x>", "\n", "\n\n", " ", "\t", "\x0b", "\u00a0", "中文", "the same eight words in a row here", "1", "a\na", "\r\n", "😀"]
    return [None, "", " ", "\n"] + [" ".join(RNG.choice(pieces, RNG.integers(1, 60))) for _ in range(300)] + ["".join(RNG.choice(pieces, 30)) for _ in range(100)] + ["lorem ipsum " * 30_000]


def test_quality_statistics_equal_plain_counts(spark):
    texts = odd_texts()
    d = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[7])], "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = Counter((r.doc_id, *(r[c] for c in quality.STATS)) for r in quality.quality_stats(d).collect())
    rows = [*enumerate(texts), (3, texts[7])]
    assert got == Counter((i, *(plain_stats(t)[c] for c in quality.STATS)) for i, t in rows)


def test_decision_list_of_columns_equals_plain_rules(spark):
    rules = [quality.Rule([("symbols_per_word", True, 0.2), ("n_words", False, 30.0)]), quality.Rule([("mean_word", True, 4.0)]), quality.Rule([("dup_line_share", True, 0.5)])]
    texts = odd_texts()
    stats = quality.quality_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.ok for r in stats.select("doc_id", quality.rules_column(rules).alias("ok")).collect()}
    for i, t in enumerate(texts):
        s = plain_stats(t)
        n = max(s["n_words"], 1)
        hit = (s["n_symbols"] / n > 0.2 and s["n_words"] <= 30) or s["word_chars"] / n > 4 or s["n_dup_lines"] / max(s["n_lines"], 1) > 0.5
        assert got[i] == (not hit)
    assert spark.range(1).select(quality.rules_column([])).first()[0] is True


def test_quality_sample_is_bounded_at_any_size(spark):
    rows = [(i, sentence(25), i % 5 > 0) for i in range(400)] + [(7, "one text again and again", 1)] * 300 + [(None, "x", 0)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(q)) for i, _, q in rows] + [(3, None)], "doc_id long, quality int")
    seen = {}

    def spy(x, bad, **_):
        seen["n"] = len(bad)
        return []

    real, quality.learn_rules = quality.learn_rules, spy
    try:
        quality.fit_rules(quality.quality_stats(d), lab, fit_rows=50)
    finally:
        quality.learn_rules = real
    assert 20 <= seen["n"] <= 140
    for n in (10**6, 10**11, 10**14):
        assert 20_000 < n * (langid.hash_cut(20_000, n) + 2**63) / 2**64 < 21_000


def test_filter_keeps_what_judge_keeps_with_clashing_columns(spark):
    d = spark.createDataFrame([(i, sentence(40) if i % 3 else " | ".join(sentence(40).split()), 5, "k") for i in range(120)] + [(None, None, 1, "z"), (4, "x", 2, None)], "doc_id long, text string, n_words int, kept string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    got = quality.filter_documents(d, lab)
    assert got.columns == d.columns and got.schema == d.schema
    kept = {r.doc_id for r in quality.judge(d, lab).where("kept").collect()}
    assert {(r.doc_id, r.n_words, r.kept) for r in got.collect()} == {(i, 5, "k") for i in kept} and kept == {i for i in range(120) if i % 3}
