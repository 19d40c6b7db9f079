"""Monitors by group, with their state in Spark: a count for each open window of each group, and how the last one ended.

A window of a group is over when the watermark passes its end, which a timer of that group tells; so a group that falls
quiet is heard as well: the window after its last one counts 0, and further ones would end alike. Each call to the state
store is a round trip, so a group has one entry and one timer, for the next window to end, and a batch asks for a group's
state once, however many windows it touches. State lies in Spark's
state store, dealt by group and kept with the query's checkpoint, so nothing passes the driver, a lost executor's groups
go on from the last batch, and a batch that is repeated starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators.fields import LeafFields, View
from larkspur.operators.monitors import COMPARISONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVERY = {"processingTime": "5 seconds"}


class _Watch(StatefulProcessor):
    def __init__(self, keys: list[str], window_ms: int, comparison: str, threshold: int):
        self.keys, self.window_ms, self.comparison, self.threshold = keys, window_ms, comparison, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "windows array<long>, counts array<long>, last long, heard boolean, breached boolean")

    def _state(self) -> tuple[dict[int, int], int | None, bool, bool]:
        """Counts of the open windows, the last window that is over, whether that one had rows, and how it ended."""
        found = self.state.get()
        if found is None:
            return {}, None, False, False
        windows, counts, last, heard, breached = found
        return dict(zip(windows or (), counts or ())), last, heard, breached

    def _due(self, counts: dict[int, int], last: int | None, heard: bool) -> int | None:
        """The next window to end: the first open one, or the quiet one after the last that had rows."""
        first = min(counts, default=None)
        quiet = last + self.window_ms if heard else None
        return quiet if first is None else first if quiet is None else min(first, quiet)

    def _keep(self, counts: dict[int, int], last: int | None, heard: bool, breached: bool) -> None:
        self.state.update((list(counts), list(counts.values()), last, heard, breached))
        if (due := self._due(counts, last, heard)) is not None:
            self.handle.registerTimer(due + self.window_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, last, heard, breached = self._state()
        for part in rows:
            windows, places = np.unique(part["window_ms"].to_numpy(), return_inverse=True)
            for window, n in zip(windows.tolist(), np.bincount(places, part["fits"].to_numpy()).tolist()):
                if last is None or window > last:  # else its end was told already
                    counts[window] = counts.get(window, 0) + int(n)
        self._keep(counts, last, heard, breached)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All windows that are over, in order, at the first timer that says so; others of the group then find nothing."""
        counts, last, heard, breached = self._state()
        watermark, news, told = timerValues.getCurrentWatermarkInMs(), [], False
        while (window := self._due(counts, last, heard)) is not None and window + self.window_ms <= watermark:
            last, heard, told = window, window in counts, True
            n = counts.pop(window, 0)
            now = bool(COMPARISONS[self.comparison](n, self.threshold))
            if now and not breached:
                news.append((*key, window, n))
            breached = now
        if told:
            self._keep(counts, last, heard, breached)
        if news:
            yield pd.DataFrame(news, columns=[*self.keys, "window_ms", "n"])

    def close(self) -> None:
        pass


def group_alerts(
    rows: DataFrame,
    by: dict[str, Callable[[View], Column]],
    window_ms: int,
    comparison: str,
    threshold: int,
    lateness: str = "0 seconds",
    predicate: Callable[[View], Column] | None = None,
) -> DataFrame:
    """A stream of (group columns, window_ms, n): a group's finished windows that cross the threshold when the one before
    didn't. Every row counts towards its group's windows, those that the predicate fits towards their numbers. Groups are
    texts; a row that lacks one is in no group."""
    view = View(rows, LeafFields())
    groups = {name: column(view).cast("string") for name, column in by.items()}
    fits = F.lit(True) if predicate is None else predicate(view)
    start = F.col("ts_ms") - F.pmod("ts_ms", F.lit(window_ms))
    columns = [c.alias(n) for n, c in groups.items()]
    marked = view.df.select(*columns, start.alias("window_ms"), fits.cast("int").alias("fits"), F.timestamp_millis("ts_ms").alias("at"))
    marked = marked.na.drop(subset=list(groups)).withWatermark("at", lateness)
    schema = ", ".join(f"`{n}` string" for n in groups) + ", window_ms long, n long"
    watch = _Watch(list(groups), window_ms, comparison, threshold)
    return marked.groupBy(*groups).transformWithStateInPandas(watch, schema, "append", "eventTime")


def monitor_groups(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write group_alerts() as files below `path`, each alert once."""
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = alerts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or EVERY)).start()


def alerts_of(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{n}` string" for n in by) + ", window_ms long, n long").parquet(path)
