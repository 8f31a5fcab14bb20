"""Nearest vectors by cosine, in blocks: a task holds a block of queries and one of vectors and keeps the best of each query; no pair is a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a block; the number of blocks follows from the tables' sizes.
QUERY_BLOCK, BASE_BLOCK = 2048, 8192


def _unit(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and whether each has a direction; shorter ones are filled up with zeros."""
    rows = [np.asarray(v, float) for v in lists]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    fine = np.isfinite(length) & (length > 0)
    return out / np.where(fine, length, 1.0)[:, None], fine


def _block(k: int, least: float):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(base):
            x, fine = _unit(base["bv"])
            q, real = _unit(queries["qv"])
            width = min(x.shape[1], q.shape[1])
            ids, kinds = base["id"].to_numpy(), base["kind"].to_numpy()
            for own, v, ok, kind in zip(queries["query_id"], q, real, queries["qkind"], strict=True):
                if not ok:
                    continue
                sims = np.einsum("ij,j->i", x[:, :width], v[:width])  # a row's sum is the same in every block
                at = np.flatnonzero(fine & (ids != own) & (sims >= least) & ((kinds == kind) | (kind is None)))
                if len(at) > k:
                    at = at[sims[at] >= np.partition(sims[at], len(at) - k)[len(at) - k]]
                out += [(own, ids[i], sims[i]) for i in at[np.lexsort((ids[at], -sims[at]))[:k]]]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    return run


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int, least: float = 0.0, category: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): of each query (id, vector) the ``k`` vectors of ``base`` (id, vector) of highest cosine, at least ``least``; ties to the smaller id.

    With ``category``, a column of both, a query meets vectors of its own category alone, or all if its category is null or no vector has it. A query never meets its
    own id. Vectors without a direction (null, all zero, not finite) take no part. Queries go once to each block of the base, and a block once to each block of
    queries.
    """
    c = F.col(category).cast("string") if category else F.lit(None).cast("string")
    q = queries.where("vector is not null").select(F.col("id").alias("query_id"), F.col("vector").alias("qv"), c.alias("qkind"))
    b = base.where("vector is not null").select("id", F.col("vector").alias("bv"), c.alias("kind"))
    if category:  # a row a category
        q = q.join(b.select(F.col("kind").alias("qkind")).distinct(), "qkind", "left_semi").unionByName(
            q.join(b.select(F.col("kind").alias("qkind")).distinct(), "qkind", "left_anti").withColumn("qkind", F.lit(None).cast("string"))
        )
    of = lambda n, size: max(1, -(-n // size))
    q_blocks, b_blocks = of(queries.count(), QUERY_BLOCK), of(base.count(), BASE_BLOCK)
    deal = lambda col, n, seed: F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("i", deal("query_id", q_blocks, 1)).withColumn("j", every(b_blocks))
    b = b.withColumn("j", deal("id", b_blocks, 2)).withColumn("i", every(q_blocks))
    q = q.select(*[F.col(x).alias(x) for x in q.columns])
    kind = dict(q.dtypes)["query_id"], dict(b.dtypes)["id"]
    best = q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(_block(k, least), f"query_id {kind[0]}, id {kind[1]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


#: Least similarity of a label that is found, and how many are.
FOUND, LABELS = 0.72, 10


def semantic_search(queries: DataFrame, labels: DataFrame, least: float = FOUND, k: int = LABELS) -> DataFrame:
    """(query_id, rank, id, similarity) of labels (id, vector, and optionally col) for queries (id, vector, other, col): by the vector of the text and by that of the text without
    its prefix (``other``, null where it has none), of each label the better similarity; a query finds labels of its own ``col`` alone, where both have that column."""
    by = "col" if "col" in queries.columns and "col" in labels.columns else None
    meta = [by] if by else []
    both = queries.select("id", "vector", *meta, F.lit(0).alias("form")).unionByName(queries.where("other is not null").select("id", F.col("other").alias("vector"), *meta, F.lit(1).alias("form")))
    # ids of queries are apart from those of labels, so that none is taken for itself
    asked = both.select(F.concat_ws("|", F.lit("q"), "form", F.col("id").cast("string")).alias("id"), "vector", *meta)
    found = nearest_vectors(asked, labels.select(F.col("id").cast("string").alias("id"), "vector", *meta), k, least, by)
    merged = found.groupBy(F.substring_index("query_id", "|", -1).alias("query_id"), "id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
