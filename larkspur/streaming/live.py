"""Live tail, and windows that late events correct."""

from __future__ import annotations

import heapq
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators.fields import LeafFields, View
from larkspur.plans.filters import Filter, everything, newest_page
from larkspur.sources.folder import Folder
from larkspur.sources.store import StoredView

EVERY = {"processingTime": "1500 milliseconds"}
KEPT = 10
SHOWN = ("ts_ms", "seq", "message", "source", "raw", "index")


class LiveTail:
    """The newest `limit` events that a search fits: those that a store has already, then those that a stream brings.

    Spark drops an event that comes again within `lateness`; events of one time are told apart by their text. The buffer
    holds `limit` events and each batch brings at most as many, so a long run or a burst takes no more memory. After a
    restart the stream goes on from its checkpoint and the buffer is filled from the store again.
    """

    def __init__(self, limit: int = 500):
        self.limit = limit
        self._lock = threading.Lock()
        self._rows: dict[tuple[int, int], Row] = {}

    def _add(self, rows: list[Row]) -> None:
        with self._lock:
            every = self._rows | {(r["ts_ms"], r["seq"]): r for r in rows}
            self._rows = {k: every[k] for k in heapq.nlargest(self.limit, every)}

    def rows(self) -> list[Row]:
        """Newest first."""
        with self._lock:
            return [self._rows[k] for k in sorted(self._rows, reverse=True)]

    def backfill(self, view: StoredView, what: Filter | None = None, **scope) -> None:
        hits, _ = newest_page(view, what, self.limit, **scope)
        stamp = F.unix_millis(F.to_timestamp("timestamp")).alias("ts_ms")
        index = F.element_at(F.split("partition", "/"), 1).alias("index")
        self._add(hits.select(stamp, "seq", "message", "source", "raw", index).collect())  # at most limit rows

    def follow(
        self, rows: DataFrame, checkpoint: str, what: Filter | None = None, lateness: str = "10 minutes", trigger: dict | None = None
    ) -> StreamingQuery:
        view = View(rows, LeafFields())
        found = view.df.filter((what or everything()).predicate(view)).withColumn("at", F.timestamp_millis("ts_ms"))
        fresh = found.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["ts_ms", "seq"]).select(*SHOWN)

        def show(batch: DataFrame, number: int) -> None:
            self._add(batch.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(self.limit).collect())

        return fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(show).trigger(**(trigger or EVERY)).start()


def corrected_windows(
    rows: DataFrame,
    window_ms: int,
    lateness_ms: int,
    path: str,
    checkpoint: str,
    predicate: Callable[[View], Column] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Counts of matching rows in windows, shown at once and corrected by what comes later.

    Each batch adds what it brings to each window, under its number: a batch that Spark repeats writes the same again, and
    `windows_of` adds up what all batches brought. A row whose window ended `lateness_ms` or more before the latest time
    of the batches before it came too late: it is set aside whole in `too_late` and counts nowhere.
    """
    spark, at = rows.sparkSession, Folder(rows.sparkSession, path)
    view = View(rows, LeafFields())
    found = view.df.withColumn("fits", F.lit(True) if predicate is None else predicate(view))

    def latest_before(number: int) -> int | None:
        done = sorted(int(f.rsplit("/", 1)[1][:-5]) for f, _, _ in at.files("_latest"))
        done = [x for x in done if x < number]
        for x in done[:-KEPT]:  # Spark repeats the last batch only
            at.delete(f"_latest/{x}.json")
        return at.read(f"_latest/{done[-1]}.json")["ms"] if done else None

    def add(batch: DataFrame, number: int) -> None:
        latest, seen = latest_before(number), Observation()
        window = F.col("ts_ms") - F.pmod("ts_ms", F.lit(window_ms))
        late = F.lit(False) if latest is None else window + window_ms <= latest - lateness_ms
        marked = batch.withColumns({"window_ms": window, "late": late})
        watched = marked.observe(seen, F.max("ts_ms").alias("ms"))
        counts = watched.groupBy("window_ms").agg(F.count_if(F.col("fits") & ~F.col("late")).alias("n"), F.count_if("late").alias("late"))
        counts.write.mode("overwrite").parquet(f"{at.path}/windows/batch={number}")
        if latest is not None:
            aside = marked.filter("late and fits").drop("fits", "late")
            aside.write.mode("overwrite").parquet(f"{at.path}/late/batch={number}")
        now = max(x for x in (seen.get["ms"], latest, 0) if x is not None)
        at.delete(f"_latest/{number}.json")
        at.put(f"_latest/{number}.json", {"ms": now})

    writer = found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def windows_of(spark: SparkSession, path: str) -> DataFrame:
    """window_ms, n, batches: each window's count as of now, and in how many batches rows of it came."""
    schema = "window_ms long, n long, late long, batch long"
    read = spark.read.schema(schema).option("basePath", f"{path}/windows").parquet(f"{path}/windows").filter("n > 0")
    return read.groupBy("window_ms").agg(F.sum("n").alias("n"), F.count("*").alias("batches"))


def too_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the window they are missing from."""
    return spark.read.option("basePath", f"{path}/late").parquet(f"{path}/late")
