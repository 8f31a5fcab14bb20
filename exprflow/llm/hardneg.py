"""Hard negatives by a GNAT-style multiway hyperplane tree over all vectors.

A vector x of norm at most M gets one more component, sqrt(M^2 - |x|^2); then the distance of an anchor q (with 0 there) to it is
sqrt(|q|^2 + M^2 - 2 q.x), so that a window of inner products is an annulus of distances. Each node of the tree has split points, and a row goes to
the subtree of its nearest one (the hyperplanes between them); each split point keeps the least and the greatest distance to the rows of every sibling subtree.
A search drops a sibling when, by the triangle inequality, no distance in that range can lie in its annulus. Leaves are cut into blocks of
bounded size and scanned exactly, in integers, by groups of a block of anchors and a block of rows.

Split points come from a bounded sample; every row is indexed, and what the sample is like changes cost, never results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Split points of a node, most levels, rows a leaf should have, and rows that the split points are chosen from.
FAN, MAX_LEVELS, LEAF_ROWS, SAMPLE_ROWS = 16, 3, 4096, 20_000
#: Rows of a leaf's block, anchors of a group, and anchors whose scores are held at once.
BLOCK_ROWS, ANCHOR_ROWS, AT_ONCE = 8192, 2048, 128
#: Share of M by which distances are widened before a subtree is dropped; covers the rounding of doubles.
SLACK = 1e-6


def _matrix(lists: Iterable, width: int | None = None) -> np.ndarray:
    """Integer rows of a list column, filled up with zeros."""
    rows = [np.asarray(x, np.int64) for x in lists]
    out = np.zeros((len(rows), width if width is not None else max(map(len, rows), default=0)), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; by doubles where those are exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


@dataclass
class Node:
    """Split points (rows of ``points``, with their last component), their subtrees and the ranges[i, j] of distances from point i to subtree j."""

    points: np.ndarray
    number: int
    children: list["Node"] = field(default_factory=list)
    ranges: np.ndarray | None = None


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(1)))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)))


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those taken; fewer where rows repeat."""
    taken = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    far = _distances(x, x[taken])[:, 0]
    while len(taken) < min(k, len(x)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


def _grow(sample: np.ndarray, levels: int, numbers: Iterator[int]) -> Node:
    node = Node(_spread(sample, FAN), next(numbers))
    near = _distances(sample, node.points).argmin(1)
    for i in range(len(node.points)):
        own = sample[near == i]
        node.children.append(_grow(own, levels - 1, numbers) if levels > 1 and len(own) > 1 else Node(own[:0], next(numbers)))
    return node


def _place(node: Node, x: np.ndarray, ranges: dict[int, np.ndarray]) -> np.ndarray:
    """The leaf of each row; widens the ranges of the nodes on the way."""
    leaf = np.full(len(x), node.number)
    if node.children and len(x):
        d = _distances(x, node.points)
        near = d.argmin(1)
        k = len(node.points)
        seen = ranges.setdefault(node.number, np.stack((np.full((k, k), np.inf), np.full((k, k), -np.inf))))
        for j, child in enumerate(node.children):
            own = near == j
            if own.any():
                seen[0, :, j] = np.minimum(seen[0, :, j], d[own].min(0))
                seen[1, :, j] = np.maximum(seen[1, :, j], d[own].max(0))
                leaf[own] = _place(child, x[own], ranges)
    return leaf


def _reachable(node: Node, q: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, slack: float, out: dict[int, list[np.ndarray]]) -> None:
    """Adds to ``out`` by leaf the numbers ``at`` of the anchors whose annulus [low, high] can meet it."""
    if not node.children:
        out.setdefault(node.number, []).append(at)
        return
    d = _distances(q[at], node.points)
    for j, child in enumerate(node.children):
        near, far = node.ranges[0][:, j], node.ranges[1][:, j]
        if near[0] > far[0]:
            continue  # no row came here
        least = np.maximum(0.0, np.maximum(d - far, near - d)).max(1) - slack
        most = (d + far).min(1) + slack
        some = at[(least <= high[at]) & (most >= low[at])]
        if len(some):
            _reachable(child, q, low, high, some, slack, out)


@dataclass
class Index:
    """Rows with their leaf and block, the tree, the bound M of norms, the width of vectors and the blocks of each leaf."""

    rows: DataFrame
    tree: Node
    norm: float
    width: int
    leaves: DataFrame

    def reach(self, anchors: DataFrame, low: str | None, high: str | None) -> DataFrame:
        """``anchors`` times the leaves that rows with an inner product from ``low`` to ``high`` can lie in (null: unbounded)."""
        tree, norm, width = self.tree, self.norm, self.width
        names = [*anchors.columns, "leaf"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _matrix(pdf["terms"], width).astype(float)
                q, square = np.column_stack((x, np.zeros(len(x)))), (x**2).sum(1) + norm**2
                bound = lambda c, other: np.sqrt(np.maximum(0.0, square - 2 * pdf[c].fillna(other).to_numpy(float))) if c else None
                near = bound(high, -np.inf) if high else np.zeros(len(x))
                far = bound(low, -np.inf) if low else np.full(len(x), np.inf)
                if high:  # a null bound above is no bound
                    near = np.where(pdf[high].isna(), 0.0, near)
                out: dict[int, list[np.ndarray]] = {}
                _reachable(tree, q, near, far, np.arange(len(x)), SLACK * max(norm, 1.0), out)
                for leaf, parts in out.items():
                    yield pdf.iloc[np.concatenate(parts)].assign(leaf=leaf)[names]

        return anchors.mapInPandas(run, f"{_ddl(anchors)}, leaf long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def integer_rows(vectors: DataFrame, scale: int = 256, shift_every: int | None = 7, labels: int = 10) -> DataFrame:
    """(rid, vec_id, label, terms) of the rows that take part: a number for each row, and floor(scale * x) of each component x, as double.

    Left out: a null vec_id, label or vector, one that holds null, NaN or an infinity. Where vec_id is divisible by ``shift_every`` the label is
    (label + 1) % ``labels``.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    if shift_every:
        label = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label)
    live = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return live.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("terms"))


def build_index(spark: SparkSession, rows: DataFrame, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index of a written table of (rid, vec_id, label, terms).

    The driver gets a sample of ``sample_rows`` rows by hash, the ranges of the nodes (FAN * FAN numbers for each of some hundred nodes) and the counts of the leaves.
    """
    squares = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t.cast("double") * t.cast("double"))
    n, most, width = rows.agg(F.count("*"), F.max(squares), F.max(F.size("terms"))).head()
    norm, width = math.sqrt(most or 0.0) * (1 + 1e-12), width or 0
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log(max(n / leaf_rows, 1.0), FAN))))
    sample = rows.select("terms").orderBy(F.xxhash64("rid"), "rid").limit(sample_rows).toPandas()
    numbers = iter(range(1 << 30))
    tree = _grow(_lift(_matrix(sample["terms"], width), norm), levels, numbers) if len(sample) else Node(np.zeros((0, width + 1)), next(numbers))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = _place(tree, _lift(_matrix(b.column("terms").to_numpy(zero_copy_only=False), width), norm), {})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "leaf"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # as many numbers as the tree has
        for b in batches:
            _place(tree, _lift(_matrix(b.column("terms").to_numpy(zero_copy_only=False), width), norm), seen)
        cells = [(node, i, j, r[0, i, j], r[1, i, j]) for node, r in seen.items() for i in range(r.shape[1]) for j in range(r.shape[2]) if r[0, i, j] <= r[1, i, j]]
        cols = list(zip(*cells, strict=True)) if cells else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "i", "j", "near", "far"])

    placed = materialize(rows.mapInArrow(place, f"{_ddl(rows)}, leaf long"), "hardneg-rows")
    found = rows.mapInArrow(spans, "node long, i long, j long, near double, far double").groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far")).toPandas()

    def settle(node: Node) -> None:
        k = len(node.points)
        node.ranges = np.stack((np.full((k, k), np.inf), np.full((k, k), -np.inf)))
        own = found[found["node"] == node.number]
        node.ranges[0, own["i"], own["j"]], node.ranges[1, own["i"], own["j"]] = own["near"], own["far"]
        for child in node.children:
            settle(child)

    settle(tree)
    # one row for each leaf, and so for each node of the tree at most
    leaves = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    placed = placed.join(F.broadcast(leaves), "leaf").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).drop("blocks")
    return Index(placed, tree, norm, width, leaves)


def _grouped(index: Index, anchors: DataFrame, anchor_rows: int):
    """Groups of anchors and of rows by leaf, block of the leaf and block of the anchors that reach it."""
    reached = anchors.groupBy("leaf").agg(F.ceil(F.count("*") / anchor_rows).alias("parts"))
    sizes = F.broadcast(reached.join(index.leaves, "leaf"))  # one row for each leaf
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = anchors.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("anchor", F.lit(1)), F.col("parts"))).withColumn("block", up_to("blocks"))
    right = index.rows.join(sizes.select("leaf", "parts"), "leaf").withColumn("part", up_to("parts"))
    left, right = left.drop("parts", "blocks"), right.drop("parts")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own: both sides come from one table
    return left.groupBy("leaf", "block", "part").cogroup(right.groupBy("leaf", "block", "part"))


def _best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best that fit, higher scores and then smaller ids first."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        level = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= level]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _positives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            x, rid, ids, label = _matrix(rows["terms"]), rows["rid"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for a in range(0, len(anchors), AT_ONCE):
                some = anchors.iloc[a : a + AT_ONCE]
                for anchor, own, s in zip(some["anchor"], some["label"], _products(_matrix(some["terms"]), x), strict=True):
                    out += [(anchor, ids[i], rid[i], s[i]) for i in _best(s, ids, (label == own) & (rid != anchor), k)]
        return pd.DataFrame(out, columns=["anchor", "positive_id", "positive", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            x, ids, label = _matrix(rows["terms"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for a in range(0, len(anchors), AT_ONCE):
                some = anchors.iloc[a : a + AT_ONCE]
                for anchor, own, positives, s in zip(some["anchor"], some["label"], some["positives"], _products(_matrix(some["terms"]), x), strict=True):
                    other = np.flatnonzero(label != own)
                    score, own_ids = s[other], ids[other]
                    for p in sorted(set(int(v) for v in positives)):
                        # integers: low * p <= 100 * score <= high * p
                        least, most = -((-low * p) // 100), (high * p) // 100
                        out += [(anchor, p, own_ids[i], score[i]) for i in _best(score, own_ids, (score >= least) & (score <= most), k)]
        return pd.DataFrame(out, columns=["anchor", "positive_score", "negative_id", "negative_score"])

    return run


def mine_hard_negatives(
    vectors: DataFrame, every: int = 50, k_positives: int = 5, k_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    shift_every: int | None = 7, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor (vec_id divisible by ``every``).

    Positives: the ``k_positives`` other rows of the anchor's label with the highest integer inner products; negatives of each: the first ``k_negatives``
    rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``; higher scores first, ties by smaller
    vec_id. Rows are told apart by number, not by vec_id: repeated rows are candidates of each other, and repeated anchors have results each.
    Anchors without positives, and positives without negatives, have no rows. A null vec_id takes no part; other columns are ignored. Vectors of unequal length multiply
    over the components that both have. Scores are exact while sums stay below 2**63.

    An anchor first meets the rows of its nearest leaf; its worst positive there bounds the distance of better ones, so only leaves in
    reach are visited then. Negatives are sought in the annulus of all windows of an anchor.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_rows(vectors, scale, shift_every), "hardneg-vectors")
    index = build_index(spark, rows, block_rows, leaf_rows, sample_rows)
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "terms", "leaf")
    kind = "anchor long, positive_id long, positive long, positive_score long"
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    first = lambda df: df.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k_positives)

    home = materialize(first(_grouped(index, anchors, anchor_rows).applyInPandas(_positives(k_positives), kind)).drop("_k"), "hardneg-home")
    worst = home.groupBy("anchor").agg(F.when(F.count("*") >= k_positives, F.min("positive_score")).alias("least"))
    bounded = anchors.withColumnRenamed("leaf", "home").join(worst, "anchor", "left")
    away = index.reach(bounded, "least", None).where(F.col("leaf") != F.col("home")).drop("home", "least")
    found = _grouped(index, away, anchor_rows).applyInPandas(_positives(k_positives), kind)
    positives = materialize(first(home.unionByName(found)).drop("_k"), "hardneg-positives")

    # lists of k_positives scores
    windows = positives.groupBy("anchor").agg(F.collect_set("positive_score").alias("positives"))
    least, most = F.array_min(F.transform("positives", lambda p: F.floor(p * low / 100))), F.array_max(F.transform("positives", lambda p: F.ceil(p * high / 100)))
    seeking = anchors.drop("leaf").join(windows.withColumns({"least": least, "most": most}), "anchor")
    reached = index.reach(seeking, "least", "most").drop("least", "most")
    negatives = _grouped(index, reached, anchor_rows).applyInPandas(_negatives(k_negatives, low, high), "anchor long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negatives)
    named = positives.join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.join(ranked, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid, c.vec_id, list_sum(list_transform(list_zip(a.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.rid <> c.rid
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, rid) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.rid ORDER BY s.score DESC, s.vec_id, s.rid)::INT AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""
