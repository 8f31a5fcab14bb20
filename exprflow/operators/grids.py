"""Density clusters (DBSCAN) of points in few dimensions by a grid: no table of distances, no pairs of points as rows.

Cells are so small that any two points of one lie within ``eps``: a cell of ``least`` points has core points alone, and only the points of sparser cells
need their neighbours counted, in the cells that can hold any. Clusters are components of the cells with core points; two such cells are
linked if core points of theirs lie within ``eps``, which mostly shows by the few that lie outermost towards the other cell.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Points of a block, and most dimensions: a cell has some (2 * ceil(sqrt(d)) + 1) ** d neighbours.
BLOCK, MOST_DIMENSIONS = 4096, 4


def neighbour_offsets(d: int) -> list[tuple[int, ...]]:
    """Offsets of cells of width eps / sqrt(d) that can hold a point within eps, the cell's own included."""
    reach = math.ceil(math.sqrt(d))
    gap = lambda o: sum(max(0, abs(x) - 1) ** 2 for x in o)  # noqa: E731  in squares of the width; eps is sqrt(d) of them
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if gap(o) <= d]


def _shifted(cell: Column, offsets: list[tuple[int, ...]], d: int) -> Column:
    return F.array(*[F.array(*[cell[i] + F.lit(o[i]) for i in range(d)]) for o in offsets])


def _close(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which of the rows of ``a`` and ``b`` lie within ``eps``; differences, so equal in every block."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out <= eps * eps


def _points(pdf: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))


def _met(df: DataFrame, points: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs ``kernel`` on the rows of ``df`` that look at a cell and on each block of that cell's points."""
    sizes = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    looking = df.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    # many rows may look at one cell: they are dealt out too, and so the cell's points once for each share
    shares = looking.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    looking = looking.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shares"))).drop("shares")
    held = points.join(sizes, "cell").join(shares, "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("cell", "block", "share", "id", "x")
    looking = looking.select(*[F.col(c).alias(c) for c in looking.columns])
    return looking.groupBy("cell", "block", "share").cogroup(held.groupBy("cell", "block", "share")).applyInPandas(kernel, schema)


def _neighbour_counts(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        b, counts = _points(right), []
        for a in range(0, len(left), 256):
            counts.append(_close(_points(left.iloc[a : a + 256]), b, eps).sum(1))
        return pd.DataFrame({"id": left["id"].to_numpy(), "n": np.concatenate(counts)})

    return run


def _nearest_core(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            b, ids = _points(right), right["id"].to_numpy()
            for i, x in zip(left["id"], left["x"], strict=True):
                gap = ((b - np.asarray(x, float)) ** 2).sum(1)
                best = np.lexsort((ids, gap))[0]
                if gap[best] <= eps * eps:
                    out.append((i, gap[best], ids[best]))
        return pd.DataFrame(out, columns=["id", "gap", "core"]).astype({"id": "int64", "gap": float, "core": "int64"})

    return run


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component; ``links`` are (a, b) in any direction, to known nodes.

    Each round takes the smallest root among neighbours and then the root of the root, so a chain of length n takes some log n rounds. Rounds are written
    tables: what is lost is read again.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "grid-links")
    roots = materialize(nodes.select("node", F.col("node").alias("root")), "grid-roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        step = roots.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("over"))
        new = materialize(step.join(jump, F.col("root") == F.col("at")).select("node", F.least("root", "over").alias("root"), "was"), "grid-roots")
        changed = new.where("root <> was").head(1)
        discard(roots)
        roots = new.select("node", "root")
        roots._scratch = new._scratch
        if not changed:
            return roots


def dbscan(points: DataFrame, key: str, vector: str, eps: float, least: int) -> DataFrame:
    """(key, cluster, is_core): clusters of density; a point with ``least`` points within ``eps``, itself included, is core.

    Core points within ``eps`` of each other share a cluster, which is numbered by the order of its smallest key from 0; any other point within ``eps`` of a core
    point belongs to the nearest one's cluster (ties to the smaller key), the rest is noise, -1. Vectors have one to four components; null ones and those
    with null or non-finite components take no part. Keys are unique whole numbers.
    """
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = points.where(finite).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    spread = rows.agg(F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("low")).head()
    d = spread.d or 1
    if d > MOST_DIMENSIONS or (spread.low or d) != d or spread.low == 0:
        raise ValueError(f"vectors of one length, from 1 to {MOST_DIMENSIONS}, are wanted")
    width, offsets = eps / math.sqrt(d) * (1 - 1e-12), neighbour_offsets(d)  # so that rounding leaves no pair of a cell beyond eps
    cells = rows.withColumn("cell", F.transform("x", lambda v: F.floor(v / width)))
    cells = materialize(cells, "grid-points")
    full = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell")
    thin = cells.join(full, "cell", "left_anti")
    looks = thin.select("id", "x", F.explode(_shifted(F.col("cell"), offsets, d)).alias("cell"))
    counts = _met(looks, cells, _neighbour_counts(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core_ids = counts.where(F.col("n") >= least).select("id")
    core = materialize(cells.join(full, "cell", "left_semi").unionByName(thin.join(core_ids, "id", "left_semi").select(*cells.columns)), "grid-core")

    # cells with core points, named by their smallest one
    nodes = materialize(core.groupBy("cell").agg(F.min("id").alias("node")), "grid-cells")
    ahead = [o for o in offsets if o > (0,) * d]  # each pair once
    number = F.posexplode(_shifted(F.col("cell"), ahead, d)).alias("o", "there")
    pairs = nodes.select("cell", "node", number).join(nodes.select(F.col("cell").alias("there"), F.col("node").alias("other")), "there")
    pairs = materialize(pairs.select("cell", "node", "there", "other", "o"), "grid-pairs")
    along = lambda o, sign: sum((F.col("x")[i] * float(sign * o[i]) for i in range(d)), F.lit(0.0))
    outer = core.groupBy("cell").agg(*[F.max_by("x", F.struct(along(o, s), F.col("id"))).alias(f"e{i}_{s}") for i, o in enumerate(ahead) for s in (1, -1)])
    out = outer.select("cell", F.array(*[F.col(f"e{i}_1") for i in range(len(ahead))]).alias("forth"), F.array(*[F.col(f"e{i}_-1") for i in range(len(ahead))]).alias("back"))
    tried = pairs.join(out.select("cell", "forth"), "cell").join(out.select(F.col("cell").alias("there"), "back"), "there")
    gap = F.aggregate(F.zip_with(F.col("forth")[F.col("o")], F.col("back")[F.col("o")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    tried = materialize(tried.select("cell", "there", "node", "other", (gap <= eps * eps).alias("near")), "grid-tried")
    open_ = tried.where("not near").select("cell", "there", "node", "other")
    asking = open_.join(core, "cell").select("id", "x", F.col("there").alias("cell"), F.col("node").alias("other"))
    found = _linked(asking, core, eps)
    links = tried.where("near").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(found)
    roots = connected(nodes.select("node"), links)
    core_root = core.join(nodes, "cell").join(roots, "node").select("id", "root")
    border = cells.join(core.select("id"), "id", "left_anti")
    near_core = _met(border.select("id", "x", F.explode(_shifted(F.col("cell"), offsets, d)).alias("cell")), core, _nearest_core(eps), "id long, gap double, core long")
    best = near_core.groupBy("id").agg(F.min(F.struct("gap", "core")).alias("b")).select("id", F.col("b.core").alias("core"))
    edge = best.join(core_root.select(F.col("id").alias("core"), "root"), "core").select("id", "root")
    placed = core_root.withColumn("is_core", F.lit(True)).unionByName(edge.withColumn("is_core", F.lit(False)))
    # the smallest key of a cluster may be that of a border point; numbers follow the smallest core key
    clusters = placed.select("root").distinct().withColumn("part", F.shiftright("root", 16))
    return _numbered(rows, placed, clusters, key)


def _linked(asking: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """(a, b): pairs of cells of which core points lie within ``eps``."""
    named = core.groupBy("cell").agg(F.min("id").alias("b"))  # b travels with the question
    flat = asking.join(named, "cell").select("id", "x", "cell", F.col("other").alias("a"), "b")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y = _points(right)
            low, high = y.min(0), y.max(0)
            for (a, b), own in left.groupby(["a", "b"]):
                x = _points(own)
                x = x[((np.maximum(0, low - x) + np.maximum(0, x - high)) ** 2).sum(1) <= eps * eps]
                if any(_close(x[i : i + 256], y, eps).any() for i in range(0, len(x), 256)):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return _met(flat, core, run, "a long, b long").distinct()


def _numbered(rows: DataFrame, placed: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Clusters numbered by their roots: counts of ranges of roots first, then ranks within a range."""
    sizes = clusters.groupBy("part").agg(F.count("*").alias("n"))
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for 65,536 keys
    ranked = clusters.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("root"))).join(start, "part")
    numbers = ranked.select("root", (F.col("start") + F.col("k") - 1).alias("cluster"))
    out = rows.select("id").join(placed.join(numbers, "root"), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
