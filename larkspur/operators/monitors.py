"""Threshold monitors: the count of a query over a sliding window, with an alert when it first crosses."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.values import bucket, iso
from larkspur.operators.fields import View
from larkspur.operators.search import in_window, page

COMPARISONS: dict[str, Callable] = {
    "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq, "neq": operator.ne,
}


EVIDENCE = 5  # newest rows that an alert shows


def check(view: View, comparison: str, threshold: int, now_ms: int, window_ms: int, breached_before: bool = False) -> dict:
    """One run: the count in [now - window, now], if it breaches, and if that is news."""
    found = view.where(in_window(view, now_ms - window_ms, now_ms))
    n = found.df.count()
    breached = COMPARISONS[comparison](n, threshold)
    out = {"count": n, "breached": breached, "alert": breached and not breached_before}
    if out["alert"]:
        summary = f"{n} events from {iso(now_ms - window_ms)} to {iso(now_ms)}"
        out |= {"title": f"count {comparison} {threshold}", "summary": summary, "evidence": page(found, EVIDENCE).collect()}
    return out


def replay(view: View, comparison: str, threshold: int, window_ms: int, start_ms: int, end_ms: int) -> DataFrame:
    """window_ms, n, breached, alert of every window from start to end, alerts only where the one before was fine."""
    found = view.df.filter(in_window(view, start_ms, end_ms))
    counts = found.groupBy(bucket(F.col("ts_ms"), window_ms).alias("w")).agg(F.count("*").alias("n"))
    every = view.df.sparkSession.range(start_ms // window_ms * window_ms, end_ms + 1, window_ms).withColumnRenamed("id", "w")
    rows = every.join(counts, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    breached: Column = COMPARISONS[comparison](F.col("n"), F.lit(threshold))
    # one row a window, so the sequence is short however many events there are
    before = F.lag("breached", 1, False).over(Window.partitionBy(F.lit(0)).orderBy("w"))
    rows = rows.withColumn("breached", breached).withColumn("alert", F.col("breached") & ~before)
    return rows.select(F.col("w").alias("window_ms"), "n", "breached", "alert")
