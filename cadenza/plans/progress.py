"""Counts that come with a result, in place of a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _counts(accepted: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.count_if(accepted).alias("accepted"), F.count_if(~F.coalesce(accepted, F.lit(False))).alias("rejected")]


def observed(rows: DataFrame, name: str, accepted: Column) -> tuple[DataFrame, Observation]:
    """rows, and what `.get` tells once an action has run over them: rows,
    accepted and rejected (a null is rejected)."""
    counts = Observation(name)
    return rows.observe(counts, *_counts(accepted)), counts


class Progress(StreamingQueryListener):
    """Sums of a stream's counts by name, batch by batch: add it with
    spark.streams.addListener() and mark the stream with `marked()`."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            so_far = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                so_far[k] = so_far.get(k, 0) + v
            self.batches[name] = self.batches.get(name, 0) + 1


def marked(stream: DataFrame, name: str, accepted: Column) -> DataFrame:
    return stream.observe(name, *_counts(accepted))
