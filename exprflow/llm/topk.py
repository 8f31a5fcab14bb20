"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks; every pair of a query block and a candidate block is
one group. In a group the candidates are an inverted index, term by term (candidate, weight); each term of
each sparse query row scatters its weighted postings into the query's dense array of scores. A
partition selection leaves each query's k best of the block, and a window merges the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192


def _postings(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero terms of an array column."""
    column = values.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    some = flat != 0
    return row[some], term[some], flat[some]


def _block_top(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q_id, c_id = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        by_id = np.argsort(c_id, kind="stable")
        row, term, weight = _postings(candidates["terms"])
        row = np.argsort(by_id)[row]
        c_id = c_id[by_id]
        order = np.argsort(term, kind="stable")
        row, weight = row[order], weight[order]
        ends = np.searchsorted(term[order], np.arange(term.max() + 2 if len(term) else 1))
        lists = [(row[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        dense = [len(r) == len(c_id) for r, _ in lists]  # then in candidate order, once each
        for t, whole in enumerate(dense):
            if whole:
                r, w = lists[t]
                lists[t] = (r, w[np.argsort(r)])
        q_row, q_term, q_weight = _postings(queries["terms"])
        bounds = np.searchsorted(q_row, np.arange(len(q_id) + 1))
        out: list[tuple[np.ndarray, ...]] = []
        for i, own in enumerate(q_id):
            scores = np.zeros(len(c_id), np.int64)
            for t, w in zip(q_term[bounds[i] : bounds[i + 1]], q_weight[bounds[i] : bounds[i + 1]], strict=True):
                if t < len(lists):
                    rows, weights = lists[t]
                    if dense[t]:
                        scores += w * weights
                    else:
                        scores[rows] += w * weights
            other = np.flatnonzero(c_id != own)
            s = scores[other]
            if len(s) > k:  # all above the k-th score, and of those at it the smallest ids
                at = np.partition(s, len(s) - k)[len(s) - k]
                above, level = np.flatnonzero(s > at), np.flatnonzero(s == at)
                other = other[np.concatenate((above, level[: k - len(above)]))]
            out.append((np.full(len(other), own), c_id[other], scores[other]))
        cols = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return run


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component x, as double, of the vectors that take part.

    Left out: a null vec_id, a null vector, one that holds null, NaN or an infinity.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("terms"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the k best other rows by integer inner
    product: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Vectors of unequal length multiply over the components that both have. Rows alike in vec_id and vector
    count once; rows that share only the vec_id are no candidates of each other. An empty vector scores 0. A
    query without candidates has no rows. Scores are exact while sums stay below 2**63.
    """
    rows = materialize(integer_vectors(vectors, scale).distinct(), "topk-vectors")
    n = rows.count()
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    q_blocks, c_blocks = math.ceil(n_queries / QUERY_BLOCK) or 1, math.ceil(n / CANDIDATE_BLOCK) or 1
    deal = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks))
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = (
        rows.where(F.col("vec_id") % every == 0)
        .withColumn("q", deal(q_blocks, 1))
        .withColumn("c", every_block(c_blocks))
    )
    candidates = rows.withColumn("c", deal(c_blocks, 2)).withColumn("q", every_block(q_blocks))
    part = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(
        _block_top(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        part.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
