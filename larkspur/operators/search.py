"""Searches over log views: predicates, pages of hits, histograms and top values."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import glob_regex, matches, whole_value
from larkspur.functions.values import bucket, label, number_text
from larkspur.operators.fields import View

TEXT_FIELDS = ("message", "raw", "timestamp")
CORE = ("source", "index")


def term(view: View, value: str, field: str | None = None, quoted: bool = False) -> Column:
    """A word, phrase or pattern, anywhere in the event's text or in one field."""
    if field is None:
        return matches(F.col("message"), value, quoted) | matches(F.col("raw"), value, quoted) | whole_value(F.col("source"), value)
    field = field.lower()
    if field in ("message", "raw"):
        return matches(F.col(field), value, quoted)
    if field == "source":
        return whole_value(F.col("source"), value)
    if field in ("timestamp", "dynamic"):
        return F.lit(False)
    return view.fields.term(field, value)


def compare(view: View, field: str, op: str, bound: str) -> Column:
    if field.lower() in ("message", "raw", "source", "timestamp", "dynamic"):
        return F.lit(False)
    return view.fields.compare(field, op, bound)


def either(predicates: Iterable[Column]) -> Column:
    """An OR that the scan sees."""
    return reduce(operator.or_, predicates)


def index_fits(pattern: str) -> Column:
    return F.lower("index").rlike(glob_regex(pattern.lower()))


def listed(partitions: str) -> list[tuple[str, str, str]]:
    """`env/index/day,env/index/day` as (env, index, day)."""
    out = [tuple(x.strip().split("/")) for x in partitions.split(",") if x.strip()]
    if bad := [x for x in out if len(x) != 3]:
        raise ValueError(f"not env/index/day: {'/'.join(bad[0])}")
    return out


def partitions_in_scope(
    env: str | None = None,
    index: Sequence[str] = (),
    start_ms: int | None = None,
    end_ms: int | None = None,
    allowed: Iterable[tuple[str, str]] | None = None,
    explicit: Iterable[tuple[str, str, str]] | None = None,
) -> Column:
    """A predicate on the partition columns, which Spark prunes by: environment, index patterns, days, permissions,
    listed partitions."""
    out = (F.col("env") == env) if env else ~F.col("env").startswith("_")
    if index:
        out = out & either(index_fits(p) for p in index)
    if start_ms is not None:
        out = out & (F.col("day") >= F.to_date(F.timestamp_millis(F.lit(start_ms))))
    if end_ms is not None:
        out = out & (F.col("day") <= F.to_date(F.timestamp_millis(F.lit(end_ms))))
    if allowed is not None:
        rule = F.lit(False)
        for e, i in allowed:
            rule = rule | ((F.lit(e == "*") | (F.lower("env") == e.lower())) & index_fits(i))
        out = out & rule
    if explicit is not None:
        out = out & F.concat_ws("/", "env", "index", F.col("day").cast("string")).isin(["/".join(map(str, x)) for x in explicit])
    return out


def in_window(view: View, start_ms: int | None, end_ms: int | None) -> Column:
    """Both ends included. A stored timestamp gets a bound of its own, which reaches the scan."""
    out = F.lit(True)
    if view.ts:
        kind = dict(view.df.dtypes)[view.ts]
        at = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
        if start_ms is not None:
            out = out & (F.col(view.ts) >= at(start_ms))
        if end_ms is not None:
            out = out & (F.col(view.ts) < at(end_ms + 1))
    if start_ms is not None:
        out = out & (F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        out = out & (F.col("ts_ms") <= end_ms)
    return out


def page(view: View, limit: int = 50, offset: int = 0) -> DataFrame:
    """Hits, newest first: timestamp, message, source, partition, raw. A limit of 0 is taken as 1."""
    rows = view.df.orderBy(F.desc("ts_ms"), "seq").offset(offset).limit(max(1, limit))
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    partition = F.concat_ws("/", "index", F.col("day").cast("string")).alias("partition")
    return rows.select(stamp.alias("timestamp"), "message", "source", partition, "raw", "seq", F.lit(0.0).alias("score"))


def with_event(hits: DataFrame) -> DataFrame:
    """page() with the event itself instead of its text; null where that isn't an object."""
    event = F.try_parse_json("raw")
    kind = F.schema_of_variant(event)
    return hits.withColumn("event", F.when(kind.startswith("OBJECT"), event)).drop("raw")


def partition_list(view: View) -> DataFrame:
    return view.df.select("env", "index", "day").distinct().orderBy(F.desc("day"), "env", "index")


def histogram(view: View, span_ms: int, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Counts per epoch-aligned bucket; with both bounds every bucket of the window has a row."""
    rows = view.df.filter(in_window(view, start_ms, end_ms))
    counts = rows.groupBy(bucket(F.col("ts_ms"), span_ms).alias("bucket_ms")).agg(F.count("*").alias("n"))
    return _filled(counts, span_ms, start_ms, end_ms)


def _filled(counts: DataFrame, span_ms: int, start_ms: int | None, end_ms: int | None) -> DataFrame:
    if start_ms is None or end_ms is None:
        return counts.select("bucket_ms", label(F.col("bucket_ms"), span_ms).alias("bucket"), "n")
    every = counts.sparkSession.range(start_ms // span_ms * span_ms, end_ms + 1, span_ms).withColumnRenamed("id", "bucket_ms")
    filled = every.join(counts, "bucket_ms", "left")
    return filled.select("bucket_ms", label(F.col("bucket_ms"), span_ms).alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


HIT = ["ts_ms", "seq", "env", "index", "day", "message", "source", "raw"]
_OUT = pa.schema(
    [("ts_ms", pa.int64()), ("seq", pa.int64()), ("env", pa.string()), ("index", pa.string()), ("day", pa.date32())]
    + [(n, pa.string()) for n in HIT[5:]] + [("bucket_ms", pa.int64()), ("n", pa.int64())]
)
_FOUND = "ts_ms bigint, seq bigint, env string, index string, day date, message string, source string, raw string, bucket_ms bigint, n bigint"


def _partly(span_ms: int, wanted: int):
    """Of a task's rows the newest `wanted`, and how many lie in each bucket."""
    newest = [("ts_ms", "descending"), ("seq", "ascending")]

    def run(batches):
        best, counts = None, Counter()
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            times = rows.column("ts_ms").to_numpy()
            buckets, n = np.unique(times - times % span_ms, return_counts=True)
            counts.update(dict(zip(buckets.tolist(), n.tolist())))
            rows = rows if best is None else pa.concat_tables([best, rows])
            best = rows.take(pc.select_k_unstable(rows, wanted, newest)) if len(rows) > wanted else rows
        if best is not None:
            own = [best.column(n).combine_chunks() for n in HIT]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(best), pa.int64())] * 2], schema=_OUT)
            sums = [pa.array(x, pa.int64()) for x in (list(counts), list(counts.values()))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(counts), f.type) for f in list(_OUT)[: len(HIT)]), *sums], schema=_OUT)

    return run


def search_histogram(
    view: View, span_ms: int, start_ms: int | None = None, end_ms: int | None = None, limit: int = 50, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """page() and histogram() of one search, from one pass over its rows: each task gives its newest offset + limit rows and
    its counts by bucket, which are kept for both results and are few however many rows fit."""
    rows = view.df.filter(in_window(view, start_ms, end_ms)).select(*HIT)
    parts = rows.mapInArrow(_partly(span_ms, offset + max(1, limit)), _FOUND).persist()
    hits = View(parts.filter("n is null").drop("bucket_ms", "n"), view.fields)
    counts = parts.filter("n is not null").groupBy("bucket_ms").agg(F.sum("n").alias("n"))
    return page(hits, limit, offset), _filled(counts, span_ms, start_ms, end_ms)


def series(view: View, span_ms: int, named: dict[str, Column]) -> DataFrame:
    """One histogram per predicate, side by side, from a single pass; 0 where a series has no rows."""
    rows = view.df.filter(either(named.values())).groupBy(bucket(F.col("ts_ms"), span_ms).alias("bucket_ms"))
    return rows.agg(*(F.count_if(p).alias(n) for n, p in named.items()))


def totals(view: View, named: dict[str, Column]) -> DataFrame:
    return view.df.agg(*(F.count_if(p).alias(n) for n, p in named.items()))


def _value_labels(view: View, fields: Sequence[str]) -> Column:
    """(field, value) of each row for the given fields; fields of free text are errors, booleans have no values."""
    if bad := [f for f in fields if f in TEXT_FIELDS]:
        raise ValueError(f"no top values of {bad[0]}")
    core = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in fields if f in CORE]
    wanted = [f.lower() for f in fields if f not in CORE]
    parts = [F.filter(F.array(*core), lambda x: x.isNotNull())] if core else []
    if wanted:
        own = F.filter(view.fields.leaves(), lambda x: x.path.isin(wanted) & (x.pos == 0) & x.b.isNull())
        value = lambda x: F.coalesce(x.i.cast("string"), number_text(x.d), x.s)
        parts.append(F.transform(own, lambda x: F.struct(x.path.alias("field"), value(x).alias("value"))))
    return F.concat(*parts)


def terms(view: View, fields: Sequence[str], size: int = 10) -> DataFrame:
    """field, value, n: the most frequent values of several fields in one pass; exact, ties by value."""
    rows = view.df.select(F.explode(_value_labels(view, fields)).alias("x"))
    return _most(rows.groupBy("x.field", "x.value").agg(F.count("*").alias("n")), size)


def _most(counts: DataFrame, size: int) -> DataFrame:
    best = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).select("field", "value", "n")


def terms_sampled(view: View, fields: Sequence[str], size: int = 10, max_partitions: int = 96) -> DataFrame:
    """terms() over every n-th partition, newest first, each partition's counts scaled up and rounded."""
    keys = view.partitions or [tuple(map(str, r)) for r in partition_list(view).collect()]  # one row a partition
    keys = sorted(sorted(keys), key=lambda k: k[2], reverse=True)
    if len(keys) <= max_partitions:
        return terms(view, fields, size)
    chosen = keys[:: ceil(len(keys) / max_partitions)]
    scale = len(keys) / len(chosen)
    rows = view.where(partitions_in_scope(explicit=chosen)).df
    rows = rows.select("env", "index", "day", F.explode(_value_labels(view, fields)).alias("x"))
    counts = rows.groupBy("env", "index", "day", "x.field", "x.value").agg(F.count("*").alias("c"))
    return _most(counts.groupBy("field", "value").agg(F.sum(F.floor(F.col("c") * scale + 0.5)).cast("long").alias("n")), size)
