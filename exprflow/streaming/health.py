"""Stages that stop a run when too many of their rows fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Fixed value: the share of failed rows above which a run stops.
LIMIT = 0.25


class TooManyFailures(RuntimeError):
    """A stage failed on more rows than it may."""


def guarded(stage: DataFrame, failed: Column, name: str, limit: float = LIMIT) -> DataFrame:
    """The rows of a stage, written once; TooManyFailures if ``failed`` is true of more than ``limit`` of them.

    Both counts are taken by the job that writes the rows, so nothing is read twice, and the next stage never starts on a bad one.
    A null in ``failed`` is no failure; a stage without rows is fine.
    """
    counts = Observation(name)
    seen = stage.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(failed, F.lit(False))).alias("bad"))
    out = materialize(seen, f"stage-{name}")
    n, bad = counts.get["n"], counts.get["bad"]
    if bad > limit * n:
        discard(out)
        raise TooManyFailures(f"stage {name}: {bad} of {n} rows failed, more than {limit:.0%}")
    return out
