"""Anomalous values among the samples of a group: six signals without labels, flags, and the nearest clean sibling of each.

A group is an experiment, a value the label that one of its samples bears. Values repeat, so all work is on distinct values of a group and how
many samples bear them; vectors are those of operators.labelvectors in place of a language model's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .labelvectors import label_vectors, word_ngrams
from .quantiles import exact_quantiles, join_groups, same_keys

UNSPECIFIED = "Not Specified"
SIGNALS = ("consensus", "evidence", "knn_ood", "length_z", "punct_z", "ngram_div")
#: Neighbours, deviations that count as 1, least characters of a span.
NEIGHBOURS, CAP, SPAN = 5, 3.0, 3
#: Fixed values of the flags: quantile and least suspicion, flags of a group, least similarity of a sibling and of a cluster's members, signals named.
QUANTILE, LEAST, FLAGS, SIBLING, CLUSTER, NAMED = 0.70, 0.30, 25, 0.35, 0.85, 3
#: Distinct values in a block of a group.
BLOCK = 1024


def spans(text: Column) -> Column:
    """Distinct pieces of a text of three characters or more: lines, parts between semicolons and commas, and what follows ``key:`` in a part."""
    parts = F.transform(F.split(text, r"[;\n]"), F.trim)
    values = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"^([A-Za-z_][A-Za-z0-9_ ]{0,30})\s*:\s*(.+)", 2)))
    pieces = F.flatten(F.array(F.transform(F.split(text, "\n"), F.trim), parts, values, F.transform(F.split(text, ","), F.trim)))
    found = F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= SPAN))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def _trigrams(text: Column) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    return F.when(F.length(whole) < 3, F.array(whole)).otherwise(F.transform(F.sequence(F.lit(1), F.length(whole) - 2), lambda i: F.substring(whole, i, 3)))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _neighbours(k: int):
    """Of two blocks of a group's values: for each value of the first the counted similarities with those of the second that can matter."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, copies = right["value_id"].to_numpy(), right["n"].to_numpy()
            term = np.concatenate([np.asarray(t) for t in right["terms"]])
            owner = np.repeat(np.arange(len(right)), [len(t) for t in right["terms"]])
            weight = np.concatenate([np.asarray(w, float) for w in right["weights"]])
            order = np.argsort(term, kind="stable")
            term, owner, weight = term[order], owner[order], weight[order]
            for value, n, terms, weights in zip(left["value_id"], left["n"], left["terms"], left["weights"], strict=True):
                score = np.zeros(len(right))  # postings of each term, added into one dense array
                for t, w in zip(terms, weights, strict=True):
                    a, b = np.searchsorted(term, t, "left"), np.searchsorted(term, t, "right")
                    score[owner[a:b]] += w * weight[a:b]
                count = copies - (ids == value)  # a sample is no neighbour of itself, its copies are
                best = np.lexsort((ids, -score))
                best = best[count[best] > 0]
                upto = np.cumsum(count[best])
                best = best[: int(np.searchsorted(upto, k)) + 1]
                out.append((value, n, ids[best].tolist(), score[best].tolist(), count[best].tolist()))
        return pd.DataFrame(out, columns=["value_id", "n", "others", "sims", "counts"])

    return run


def _siblings(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of flagged values and a block of their group: the nearest value that has a clean sample, and how many samples lie in the value's cluster."""
    out = []
    if len(left) and len(right):
        ids, copies, clean = right["value_id"].to_numpy(), right["n"].to_numpy(), right["clean"].to_numpy()
        where: dict[int, list] = {}
        for i, (terms, weights) in enumerate(zip(right["terms"], right["weights"], strict=True)):
            for t, w in zip(terms, weights, strict=True):
                where.setdefault(t, []).append((i, w))
        for value, terms, weights in zip(left["value_id"], left["terms"], left["weights"], strict=True):
            score = np.zeros(len(right))
            for t, w in zip(terms, weights, strict=True):
                for i, v in where.get(t, ()):
                    score[i] += w * v
            at = np.flatnonzero(clean > 0)
            best = at[np.lexsort((ids[at], -score[at]))[:1]]
            size = int(copies[score > CLUSTER].sum())
            out.append((value, int(ids[best[0]]) if len(best) else None, float(score[best[0]]) if len(best) else None, size))
    return pd.DataFrame(out, columns=["value_id", "sibling", "sim", "size"]).astype({"sibling": "Int64"})


def _by_blocks(left: DataFrame, right: DataFrame, by: list[str], kernel, schema: str) -> DataFrame:
    """Runs ``kernel`` on each pair of blocks of a group; pairs of values stay inside it."""
    blocks = right.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    null_safe = lambda df, name: join_groups(df, blocks, by).withColumn(name, F.pmod(F.xxhash64("value_id", F.lit(3)), F.col("_blocks")))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias(name)
    keys = [F.xxhash64(*by, F.lit(7)).alias("_group")] if by else [F.lit(0).cast("long").alias("_group")]
    a = null_safe(left, "_a").select("*", every("_b"), *keys).drop("_blocks", *by)
    b = null_safe(right, "_b").select("*", every("_a"), *keys).drop("_blocks", *by)
    a = a.select(*[F.col(c).alias(c) for c in a.columns])
    return a.groupBy("_group", "_a", "_b").cogroup(b.groupBy("_group", "_a", "_b")).applyInPandas(kernel, schema)


def value_vectors(values: DataFrame) -> DataFrame:
    """(value, terms, weights) of the distinct values of a table with columns value and n, with IDF over all of its groups."""
    repeated = values.select("value")
    long = label_vectors(repeated, "value")
    term = F.xxhash64("term")
    return long.groupBy(F.col("label").alias("value")).agg(F.sort_array(F.collect_list(F.struct(term.alias("t"), F.col("weight").alias("w")))).alias("p")).select(
        "value", F.transform("p", lambda p: p["t"]).alias("terms"), F.transform("p", lambda p: p["w"]).alias("weights")
    )


def anomaly_signals(samples: DataFrame, by: list[str], key: str, value: str, text: str) -> DataFrame:
    """``by``, ``key``, value, the six signals from 0 to 1 and their greatest, ``suspicion``, of each sample.

    consensus: distance from the mean vector of the group's samples. evidence: distance of the value from the nearest span of the sample's own text, 1 without text.
    knn_ood: distance from the mean of its five nearest other samples. length_z, punct_z: absolute z-scores of length and share of signs, three deviations being 1.
    ngram_div: Jensen-Shannon divergence of its character trigrams from those of its siblings, as a share of the group's greatest.

    A null or empty value is "Not Specified". Alone in its group a sample has consensus and knn_ood 0 and ngram_div 1. Null groups are groups. No pairs of
    values leave a task; sums of a group are partial sums. Repeated keys keep a row each.
    """
    names, by = by, [f"_by{i}" for i in range(len(by))]
    clean = F.coalesce(F.when(F.col(f"`{value}`") != "", F.col(f"`{value}`")), F.lit(UNSPECIFIED))
    rows = samples.select(*[F.col(f"`{c}`").alias(b) for c, b in zip(names, by, strict=True)], F.col(f"`{key}`").alias("_key"), clean.alias("value"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = materialize(rows, "anomaly-samples")
    values = rows.groupBy(*by, "value").agg(F.count("*").alias("n"))
    vectors = materialize(value_vectors(rows), "anomaly-vectors")
    values = values.join(vectors, "value", "left").withColumn("value_id", F.xxhash64(*by, "value"))
    # a value of signs or blanks alone has no n-gram and the vector 0
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    values = materialize(values.select(*by, "value", "n", "value_id", empty("terms", "bigint"), empty("weights", "double")), "anomaly-values")

    sizes = values.groupBy(*by).agg(F.sum("n").alias("size"))
    flat = values.select(*by, "value_id", "n", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select(*by, "value_id", "n", "p.terms", "p.weights")
    sums = flat.groupBy(*by, "terms").agg(F.sum(F.col("n") * F.col("weights")).alias("s"))
    length = sums.groupBy(*by).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    inner = flat.alias("l").join(sums.alias("r"), same_keys("l", "r", [*by, "terms"])).groupBy("l.value_id").agg(F.sum(F.col("l.weights") * F.col("r.s")).alias("dot"))

    near = _by_blocks(values.select(*by, "value_id", "n", "terms", "weights"), values.select(*by, "value_id", "n", "terms", "weights"), by, _neighbours(NEIGHBOURS), "value_id long, n long, others array<long>, sims array<double>, counts array<long>")
    pairs = near.select("value_id", F.explode(F.arrays_zip("sims", "counts", "others")).alias("p")).select("value_id", "p.sims", "p.counts", "p.others")
    before = F.coalesce(F.sum("counts").over(Window.partitionBy("value_id").orderBy(F.desc("sims"), "others").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = pairs.withColumn("use", F.greatest(F.lit(0), F.least(F.col("counts"), NEIGHBOURS - before)))  # five of each block at most
    ood = used.groupBy("value_id").agg((F.sum(F.col("use") * F.col("sims")) / F.sum("use")).alias("mean_sim"))

    gram = values.select(*by, "value_id", "n", F.explode(_trigrams(F.col("value"))).alias("g")).groupBy(*by, "value_id", "n", "g").agg(F.count("*").alias("c"))
    pool = gram.groupBy(*by, "g").agg(F.sum(F.col("n") * F.col("c")).alias("pc"))
    total = pool.groupBy(*by).agg(F.sum("pc").alias("pt"))
    own = F.sum("c").over(Window.partitionBy("value_id"))
    both = gram.withColumn("own", own).alias("l").join(pool.alias("r"), same_keys("l", "r", [*by, "g"])).select("l.*", F.col("r.pc"))
    both = join_groups(both, total, by)
    p, q = F.col("c") / F.col("own"), (F.col("pc") - F.col("c")) / F.greatest(F.col("pt") - F.col("own"), F.lit(1))
    m = (p + q) / 2
    # n-grams that the value lacks add half of their share among the siblings, so only its own are looked at
    part = p * F.log2(p / m) / 2 + F.when(q > 0, q * F.log2(q / m) / 2).otherwise(0.0)
    js = both.groupBy("value_id").agg(F.sum(part).alias("js"), F.sum(q).alias("q"), F.first(F.col("pt") > F.col("own")).alias("some"))
    js = js.select("value_id", _clip(F.col("js") + F.when(F.col("some"), (1 - F.col("q")) / 2).otherwise(0.0)).alias("js"))

    punct = F.length(F.regexp_replace("value", r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length("value"), F.lit(1))
    scored = values.select(*by, "value", "value_id", "n", F.length("value").cast("double").alias("len"), punct.alias("punct"))
    scored = join_groups(join_groups(scored, sizes, by), length, by).join(inner, "value_id", "left").join(ood, "value_id", "left").join(js, "value_id", "left")
    total_n, mean = F.sum("n"), lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    stats = scored.groupBy(*by).agg(total_n.alias("_n"), mean("len").alias("len_m"), mean("punct").alias("punct_m"), F.max("js").alias("js_m"))
    scored = join_groups(scored, stats, by)
    square = lambda c: F.sum(F.col("n") * F.pow(F.col(c) - F.col(f"{c}_m"), 2)) / F.sum("n")
    scored = join_groups(scored, scored.groupBy(*by).agg(F.sqrt(square("len")).alias("len_s"), F.sqrt(square("punct")).alias("punct_s")), by)
    z = lambda c: _clip(F.abs(F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-9) / CAP)
    alone = F.col("size") < 2
    by_value = scored.select(
        "value_id",
        F.when(alone, 0.0).otherwise(_clip(1 - F.coalesce("dot", F.lit(0.0)) / (F.coalesce("length", F.lit(0.0)) + 1e-9 * F.col("size")))).alias("consensus"),
        F.when(alone, 0.0).otherwise(_clip(1 - F.coalesce("mean_sim", F.lit(0.0)))).alias("knn_ood"),
        z("len").alias("length_z"), z("punct").alias("punct_z"),
        F.when(F.col("js_m") > 1e-9, F.col("js") / F.col("js_m")).otherwise(F.col("js")).alias("ngram_div"),
    )

    # spans meet their own value alone; the weights of terms are those of the values
    row = rows.withColumn("value_id", F.xxhash64(*by, "value"))
    seen = row.groupBy("value", "text").agg(F.count("*").alias("n")).where(F.length("text") > 0).withColumn("pair", F.xxhash64("value", "text"))
    piece = seen.select("pair", "value", F.posexplode(spans(F.col("text"))).alias("s", "span"))
    term = piece.select("pair", "value", "s", F.explode(word_ngrams(F.col("span"))).alias("term")).groupBy("pair", "value", "s", "term").agg(F.count("*").alias("tf"))
    df = row.groupBy("value").agg(F.count("*").alias("n")).select("n", F.explode(F.array_distinct(word_ngrams(F.col("value")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    n_all = row.agg(F.count("*").alias("all"))
    w = F.col("tf") * (F.log((1 + F.col("all")) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    term = term.join(df, "term", "left").crossJoin(F.broadcast(n_all)).select("pair", "value", "s", F.xxhash64("term").alias("t"), w.alias("w"))  # one row
    known = vectors.select("value", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("value", F.col("p.terms").alias("t"), F.col("p.weights").alias("v"))
    met = term.join(known, ["value", "t"], "left").groupBy("pair", "s").agg((F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("sim"))
    best = met.groupBy("pair").agg(F.max("sim").alias("sim"))
    gap = F.when(F.length("text") == 0, 1.0).otherwise(_clip(1 - F.coalesce("sim", F.lit(0.0)))).alias("evidence")
    out = row.withColumn("pair", F.xxhash64("value", "text")).join(best, "pair", "left").join(by_value, "value_id").select(*by, "_key", "value", gap, *[s for s in SIGNALS if s != "evidence"])
    named = [F.col(b).alias(c) for c, b in zip(names, by, strict=True)]
    return out.select(*named, F.col("_key").alias(key), "value", *SIGNALS, F.greatest(*SIGNALS).alias("suspicion"))


def flag_anomalies(signals: DataFrame, by: list[str], key: str) -> DataFrame:
    """``by``, ``key``, value, suspicion, rank, nearest_sibling, nearest_sim, cluster_size, top_signals of the flagged samples of ``anomaly_signals``.

    Flagged are those above both the group's 70 % quantile of suspicion and 0.30, the 25 most suspicious of a group (ties to the smaller key). The nearest
    sibling is the most similar value of an unflagged sample (ties to the smaller hash), null below 0.35; cluster_size counts samples with a similarity
    above 0.85, the sample included; top_signals names the three greatest signals, ties in the order of SIGNALS.
    """
    names, by = by, [f"_by{i}" for i in range(len(by))]
    own = [F.col(f"`{c}`").alias(b) for c, b in zip(names, by, strict=True)]
    signals = materialize(signals.select(*own, F.col(f"`{key}`").alias("_key"), "value", *SIGNALS, "suspicion"), "anomaly-signals")
    cut = exact_quantiles(signals, by, "suspicion", [QUANTILE]).select(*by, F.greatest(F.col("q")[0], F.lit(LEAST)).alias("cut"))
    above = join_groups(signals, cut, by).where(F.col("suspicion") > F.col("cut"))
    order = Window.partitionBy(*by).orderBy(F.desc("suspicion"), "_key")
    flagged = materialize(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FLAGS).drop("cut"), "anomaly-flags")  # limit pushed below the exchange
    vectors = value_vectors(signals)
    n_flagged = flagged.groupBy(*by, "value").agg(F.count("*").alias("f"))
    values = signals.groupBy(*by, "value").agg(F.count("*").alias("n"))
    values = values.alias("l").join(n_flagged.alias("r"), same_keys("l", "r", [*by, "value"]), "left").select("l.*", (F.col("n") - F.coalesce("f", F.lit(0))).alias("clean"))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    values = values.join(vectors, "value", "left").select(*by, "value", "n", "clean", F.xxhash64(*by, "value").alias("value_id"), empty("terms", "bigint"), empty("weights", "double"))
    values = materialize(values, "anomaly-flag-values")
    wanted = values.alias("l").join(n_flagged.alias("r"), same_keys("l", "r", [*by, "value"]), "left_semi")
    found = _by_blocks(wanted.select(*by, "value_id", "terms", "weights"), values.drop("value"), by, _siblings, "value_id long, sibling long, sim double, size long")
    # each block answers for its own values
    best = found.groupBy("value_id").agg(F.max_by(F.struct("sim", "sibling"), F.struct(F.col("sim"), (-F.col("sibling")).alias("s"))).alias("b"), F.sum("size").alias("cluster_size"))
    named = best.join(values.select(F.col("value_id").alias("sib"), F.col("value").alias("sibling")), F.col("b.sibling") == F.col("sib"), "left")
    near = F.coalesce(F.col("b.sim"), F.lit(0.0))
    named = named.select("value_id", F.when(near >= SIBLING, F.col("sibling")).alias("nearest_sibling"), near.alias("nearest_sim"), "cluster_size")
    ranked = F.array_sort(F.array(*[F.struct((-F.col(s)).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(SIGNALS)]))
    top = F.transform(F.slice(ranked, 1, NAMED), lambda r: r["name"]).alias("top_signals")
    return flagged.withColumn("value_id", F.xxhash64(*by, "value")).join(named, "value_id").select(
        *[F.col(b).alias(c) for c, b in zip(names, by, strict=True)], F.col("_key").alias(key), "value", "suspicion", "rank", "nearest_sibling", "nearest_sim", "cluster_size", top
    )
