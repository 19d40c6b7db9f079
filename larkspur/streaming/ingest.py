"""Continuous ingest, monitors and live tail as Structured Streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators.fields import LeafFields, View
from larkspur.operators.monitors import COMPARISONS
from larkspur.sources import events, formats, store

EVERY = {"processingTime": "5 seconds"}
ALERTS = "window_ms bigint, n bigint"


def text_files(spark: SparkSession, path: str, files_a_trigger: int = 1000, only: str | None = None) -> DataFrame:
    """Lines of files as they appear; each file is read once, gzip and other codecs by its name. only: a glob of names."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_trigger)
    return (reader.option("pathGlobFilter", only) if only else reader).text(path)


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = formats.ndjson,
    trigger: dict | None = None,
    counted: Callable[[int, dict[str, int]], None] | None = None,
    **row_options,
) -> StreamingQuery:
    """Lines to the event store, exactly once: a batch that Spark repeats has the name of a commit that exists.

    Events without a time get the day their batch is stored on. counted(batch, outcome) hears how many rows of each batch
    were stored, and how many not for each reason.
    """
    name = f"stream-{hash_of(checkpoint)}"

    def add(batch: DataFrame, number: int) -> None:
        rows = events.rows(parse(batch), int(time.time() * 1000), **row_options)
        outcome = store.append(rows, path, commit=f"{name}-{number}")
        if counted:
            counted(number, outcome)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return writer.trigger(**(trigger or EVERY)).start()


def hash_of(text: str) -> str:
    return f"{abs(int.from_bytes(text.encode(), 'big')) % ((1 << 61) - 1):x}"


def routed(rules: list[tuple[str, str, str, str]], default: str) -> Column:
    """The index of the first rule (field, equals|contains|regex, value, index) that fits."""
    out = None
    for field, how, value, index in rules:
        c = F.get_json_object("event", f"$.{field}")
        fits = {"equals": c == value, "contains": F.contains(c, F.lit(value)), "regex": c.rlike(value)}[how]
        out = F.when(fits, index) if out is None else out.when(fits, index)
    return F.lit(default) if out is None else out.otherwise(default)


def window_counts(rows: DataFrame, window: str, lateness: str, predicate: Callable[[View], Column] | None = None) -> DataFrame:
    """Counts of matching rows in tumbling windows of event time, final once `lateness` has passed."""
    view = View(rows, LeafFields())
    found = view.df.filter(predicate(view)) if predicate else view.df
    timed = found.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n"))
    return counts.select(F.unix_millis("window.start").alias("window_ms"), "n")


def monitor(
    rows: DataFrame,
    window: str,
    window_ms: int,
    comparison: str,
    threshold: int,
    alerts: str,
    checkpoint: str,
    lateness: str = "0 seconds",
    predicate: Callable[[View], Column] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the finished windows that cross the threshold when the one before didn't to `alerts`: (window_ms, n).

    Every row counts towards the windows' times and those that the predicate fits towards their numbers, so a window
    without a matching row is a window of 0. Windows between two that have rows are 0 as well. The state is the last
    window's number and outcome in a folder beside the alerts, written for each batch under its number: it survives a
    restart, and a batch that Spark repeats starts from the state before it and writes the same alerts in the same place.
    """
    spark = rows.sparkSession
    fits = (lambda v: F.lit(True)) if predicate is None else predicate
    view = View(rows, LeafFields())
    marked = view.df.withColumn("fits", fits(view)).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    counts = marked.groupBy(F.window("at", window)).agg(F.count_if("fits").alias("n"))
    counts = counts.select(F.unix_millis("window.start").alias("window_ms"), "n")
    at = store.Folder(spark, alerts)

    def state_before(number: int) -> dict:
        done = sorted(int(f.rsplit("/", 1)[1][:-5]) for f, _, _ in at.files("_state"))
        done = [x for x in done if x < number]
        return at.read(f"_state/{done[-1]}.json") if done else {"window_ms": None, "breached": False}

    def act(batch: DataFrame, number: int) -> None:
        state, news = state_before(number), []
        for r in batch.orderBy("window_ms").toLocalIterator():  # one row a window
            before, test = state["window_ms"], COMPARISONS[comparison]
            quiet = range(before + window_ms, r["window_ms"], window_ms) if before is not None else ()
            for w, n in [*((w, 0) for w in (quiet[:1] if len(quiet) else ())), (r["window_ms"], r["n"])]:  # quiet ones are alike
                breached = test(n, threshold)
                if breached and not state["breached"]:
                    news.append((w, n))
                state = {"window_ms": r["window_ms"], "breached": breached}
        spark.createDataFrame(news, ALERTS).coalesce(1).write.mode("overwrite").parquet(f"{at.path}/batch={number}")
        at.delete(f"_state/{number}.json")
        at.put(f"_state/{number}.json", state)

    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(act)
    return writer.trigger(**(trigger or EVERY)).start()


def alerts_of(spark: SparkSession, alerts: str) -> DataFrame:
    """window_ms, n of all alerts of a monitor."""
    return spark.read.schema(ALERTS + ", batch bigint").option("basePath", alerts).parquet(alerts).select("window_ms", "n")


def tail(view: View, since_ms: int, seen: set[tuple[int, str]], limit: int = 500) -> list:
    """Rows from since_ms on that weren't seen before, oldest first; the cursor is inclusive, so equal times aren't lost.

    What was seen before the cursor is forgotten, so `seen` stays as small as what lies behind the cursor. For a tail that
    goes on see live.LiveTail.
    """
    seen -= {x for x in seen if x[0] < since_ms}
    rows = view.df.filter(F.col("ts_ms") >= since_ms).orderBy("ts_ms", "seq").limit(limit + len(seen)).collect()
    new = [r for r in rows if (r["ts_ms"], r["raw"]) not in seen][:limit]
    seen |= {(r["ts_ms"], r["raw"]) for r in new}
    return new
