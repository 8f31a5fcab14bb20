"""Streaming forms: windowed aggregates with late data, and a durable message bus as a keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value per window and type; works on a batch or a stream, where ``late`` bounds the state."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean"
    )


def deliver(messages: DataFrame) -> DataFrame:
    """At-least-once bus: rows (recipient, message_id, kind) with kind post, ack or nack, in arrival order.

    State is the set of open messages of a recipient; each trigger returns how many are open and how often the
    most tried one was delivered. A message that is posted twice is one message; an ack of an unknown one is ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, tries = (list(x) for x in state.get) if state.exists else ([], [])
        open_ = dict(zip(ids, tries, strict=True))
        for pdf in batches:
            for m, kind in zip(pdf["message_id"], pdf["kind"], strict=True):
                if kind == "post":
                    open_.setdefault(m, 1)
                elif kind == "ack":
                    open_.pop(m, None)
                elif m in open_:
                    open_[m] += 1
        state.update((list(open_), list(open_.values())))
        yield pd.DataFrame({"recipient": [key[0]], "n_open": [len(open_)], "most_tries": [max(open_.values(), default=0)]})

    return messages.groupBy("recipient").applyInPandasWithState(
        step, "recipient string, n_open long, most_tries long", "ids array<long>, tries array<long>", "update", GroupStateTimeout.NoTimeout
    )
