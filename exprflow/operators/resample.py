"""Percentile intervals of any statistic under the bootstrap: a mergeable state for each replicate, never a row for each draw.

In a replicate a row counts as often as a Poisson(1) draw from a hash of its key and the replicate says, so every task makes the same draws,
replicates need no second pass, and runs agree. Sums of a group are arrays with a place for each replicate, merged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_quantiles, join_groups

#: Rows whose draws are held at once, and how many deviations of its rank a median's bracket spans.
ROWS, DEVIATIONS = 512, 8.0
# The distribution function of Poisson(1) at 0 to 10.
POISSON = np.array([0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080, 0.99999887480, 0.99999988858, 0.99999998995])


def draws(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row (a 64-bit hash) counts in each replicate: rows by replicates."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * (1.0 / (1 << 53)), "right").astype(np.int64)


def _sums(replicates: int):
    """Partial sums of a partition: of each group the counts, sums and sums of squares in every replicate."""

    def rows(state: dict[int, np.ndarray]) -> pd.DataFrame:
        parts = list(state.values())
        return pd.DataFrame({"_key": list(state), **{c: [p[i] for p in parts] for i, c in enumerate(("_w", "_s1", "_s2"))}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, own in pdf.groupby("_key", sort=False):
                for a in range(0, len(own), ROWS):
                    x = own["_x"].to_numpy(float)[a : a + ROWS]
                    part = np.stack((np.ones(len(x)), x, x * x)) @ draws(own["_h"].to_numpy()[a : a + ROWS], replicates)
                    state[g] = state[g] + part if g in state else part
            if len(state) > 1000:
                yield rows(state)
                state = {}
        if state:
            yield rows(state)

    return run


PARTIAL = "_key long, _w array<double>, _s1 array<double>, _s2 array<double>"
CLOSED = "_key long, n long, estimate double, lower double, upper double"


#: Statistics of the sums (count, sum, sum of squares) of values that are measured from their group's mean; arrays over replicates.
STATISTICS: dict[str, Callable] = {
    "mean": lambda w, s1, s2: s1 / w,
    "variance": lambda w, s1, s2: (s2 - s1 * s1 / w) / (w - 1),
    "sd": lambda w, s1, s2: np.sqrt((s2 - s1 * s1 / w) / (w - 1)),
}
_SHIFTED = {"mean"}


def _live(rows: DataFrame, by: list[str], key: str, value: str, seed: int) -> DataFrame:
    x = F.col(f"`{value}`").cast("double")
    keys = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    # groups travel through tasks as a number
    live = rows.select(*keys, F.xxhash64(F.col(f"`{key}`"), F.lit(seed)).alias("_h"), x.alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    return live.withColumn("_key", F.xxhash64(*[f"_g{i}" for i in range(len(by))], F.lit(1)))


def _ends(values: np.ndarray, level: float) -> tuple[float | None, float | None]:
    """Percentile interval over replicates; those where the statistic is undefined are left out."""
    v = values[np.isfinite(values)]
    return tuple(float(q) for q in np.quantile(v, [(1 - level) / 2, (1 + level) / 2])) if len(v) else (None, None)


def bootstrap(
    rows: DataFrame, by: list[str], key: str, statistic: str | Callable = "mean", value: str = "value", replicates: int = 1000, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """``by``, n, estimate, lower, upper of each group: the statistic of its values and its percentile interval.

    ``statistic`` is mean, variance, sd, median, or a function of arrays (count, sum, sum of squares of the values less their group's mean) with a place for
    each replicate. Nulls and NaN take no part; a group of one value has an estimate but no interval. Null keys of a
    group are a group; rows alike in ``key`` are drawn alike.
    """
    if statistic == "median":
        return _bootstrap_median(rows, by, key, value, replicates, level, seed)
    f, own = STATISTICS[statistic] if isinstance(statistic, str) else statistic, [f"_g{i}" for i in range(len(by))]
    live = _live(rows, by, key, value, seed)
    centre = materialize(live.groupBy(*own, "_key").agg(F.count("*").alias("_n"), F.avg("_x").alias("_mean"), F.var_pop("_x").alias("_var")), "bootstrap-centres")
    moved = live.join(centre.select("_key", "_mean"), "_key").select("_key", "_h", (F.col("_x") - F.col("_mean")).alias("_x"))
    added = moved.mapInPandas(_sums(replicates), PARTIAL).select("_key", F.posexplode(F.arrays_zip("_w", "_s1", "_s2")).alias("_r", "_p"))
    added = added.groupBy("_key", "_r").agg(*[F.sum(f"_p.{c}").alias(c) for c in ("_w", "_s1", "_s2")])
    lists = added.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_r", "_w", "_s1", "_s2"))).alias("_p"))  # a place for each replicate
    lists = centre.join(lists, "_key", "left").select("_key", "_n", "_mean", "_var", *[F.col(f"_p.{c}").alias(c) for c in ("_w", "_s1", "_s2")])
    shift = isinstance(statistic, str) and statistic in _SHIFTED

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, mean, var, w, s1, s2 in zip(pdf["_n"], pdf["_mean"], pdf["_var"], pdf["_w"], pdf["_s1"], pdf["_s2"], strict=True):
                with np.errstate(all="ignore"):
                    move = mean if shift else 0.0
                    whole = np.asarray(f(np.array([float(n)]), np.zeros(1), np.array([var * n])), float)[0] + move
                    low, high = _ends(np.asarray(f(np.asarray(w), np.asarray(s1), np.asarray(s2)), float) + move, level) if n > 1 else (None, None)
                out.append((n, float(whole) if np.isfinite(whole) else None, low, high))
            told = pd.DataFrame(out, columns=["n", "estimate", "lower", "upper"]).astype({"estimate": float, "lower": float, "upper": float})
            yield told.assign(_key=pdf["_key"].to_numpy())

    closed = lists.mapInPandas(close, CLOSED).join(centre.select("_key", *own), "_key")
    return closed.select(*[F.col(c).alias(b) for c, b in zip(own, by, strict=True)], "n", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("estimate", "lower", "upper")])


def _bootstrap_median(rows: DataFrame, by: list[str], key: str, value: str, replicates: int, level: float, seed: int) -> DataFrame:
    """The median in each replicate: counts below a bracket around the group's median as sums, and the few values inside it, exactly.

    A replicate's median lies within some DEVIATIONS / (2 sqrt n) of the median in rank, so a bracket holds a share of a group that falls with its size; a
    replicate whose median lies outside is an error, never a guess.
    """
    own = [f"_g{i}" for i in range(len(by))]
    live = materialize(_live(rows, by, key, value, seed), "bootstrap-rows")
    centre = exact_quantiles(live, own, "_x", [0.5]).select(*own, "n", F.col("q")[0].alias("_median"))
    half = F.least(F.lit(0.5), DEVIATIONS / (2 * F.sqrt(F.col("n"))))
    grid = [i / 256 for i in range(257)]
    marks = live.groupBy(*own).agg(F.percentile_approx("_x", grid, 20_000).alias("_marks"))
    at = lambda c: F.col("_marks")[c.cast("int")]
    bounds = join_groups(centre, marks, own).withColumn("_key", F.xxhash64(*own, F.lit(1))).withColumn("_a", F.floor((F.lit(0.5) - half) * 256) - 1).withColumn("_b", F.ceil((F.lit(0.5) + half) * 256) + 1)
    bounds = materialize(
        bounds.select(*own, "_key", "n", "_median", F.when(F.col("_a") > 0, at(F.greatest(F.col("_a"), F.lit(0)))).otherwise(float("-inf")).alias("_lo"), F.when(F.col("_b") < 256, at(F.least(F.col("_b"), F.lit(256)))).otherwise(float("inf")).alias("_hi")),
        "bootstrap-brackets",
    )
    placed = live.join(bounds.select("_key", "_lo", "_hi"), "_key")
    # of every group the draws of all rows and of those below its bracket: two sums a replicate
    counted = placed.select("_key", "_h", F.when(F.col("_x") < F.col("_lo"), 1.0).otherwise(0.0).alias("_x"))
    partial = counted.mapInPandas(_sums(replicates), PARTIAL).select("_key", F.posexplode(F.arrays_zip("_w", "_s1")).alias("_r", "_p"))
    added = partial.groupBy("_key", "_r").agg(F.sum("_p._w").alias("_w"), F.sum("_p._s1").alias("_s1"))
    lists = added.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_r", "_w", "_s1"))).alias("_p"))
    head = bounds.join(lists, "_key").select(F.col("_key").alias("key"), "n", "_median", F.col("_p._w").alias("_w"), F.col("_p._s1").alias("_s1"))
    inside = placed.where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).select("_key", "_h", "_x")

    def close(top: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(top):
            t = top.iloc[0]
            values = values.sort_values(["_x", "_h"])
            x, total, below = values["_x"].to_numpy(float), np.asarray(t["_w"]), np.asarray(t["_s1"])
            stats = np.full(replicates, np.nan)
            for a in range(0, replicates, ROWS):  # some replicates at once, all values of the bracket
                keys = values["_h"].to_numpy()
                upto = np.cumsum(_some_draws(keys, a, min(replicates, a + ROWS)), axis=0)
                for i in range(upto.shape[1]):
                    r = a + i
                    if total[r] < 1:
                        continue
                    ranks = np.array([np.floor((total[r] - 1) / 2), np.ceil((total[r] - 1) / 2)]) - below[r]
                    if ranks[0] < 0 or ranks[1] >= (upto[-1, i] if len(upto) else 0):
                        raise ValueError("a replicate's median lies outside its bracket")
                    stats[r] = x[np.searchsorted(upto[:, i], ranks, "right")].mean()
            low, high = _ends(stats, level) if t["n"] > 1 else (None, None)
            out.append((t["key"], int(t["n"]), float(t["_median"]), low, high))
        return pd.DataFrame(out, columns=["_key", "n", "estimate", "lower", "upper"]).astype({"lower": float, "upper": float})

    closed = head.groupBy("key").cogroup(inside.groupBy("_key")).applyInPandas(close, CLOSED).join(bounds.select("_key", *own), "_key")
    return closed.select(*[F.col(c).alias(b) for c, b in zip(own, by, strict=True)], "n", "estimate", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("lower", "upper")])


def _some_draws(keys: np.ndarray, first: int, last: int) -> np.ndarray:
    """``draws`` of the replicates from ``first`` to before ``last``."""
    with np.errstate(over="ignore"):
        moved = keys.astype(np.int64).view(np.uint64) + np.uint64(first) * np.uint64(0x9E3779B97F4A7C15)
    return draws(moved.view(np.int64), last - first)
