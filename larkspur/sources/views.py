"""Log views over the star-schema tables, straight from their Parquet columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.fields import ColumnFields, View


def _view(
    df: DataFrame,
    index: str,
    ts_ms: Column,
    source: str | None,
    message: str | None,
    seq: str,
    fields: dict[str, str],
    ts: str | None = None,
) -> View:
    none = F.lit(None).cast("string")
    core = {
        "env": F.lit("default"), "index": F.lit(index), "ts_ms": ts_ms, "message": F.col(message) if message else none,
        "source": F.col(source) if source else none, "raw": none, "seq": F.col(seq),
    }
    own = {c: F.col(c) for c in dict.fromkeys(fields.values())}
    stored = [F.col(ts).alias("stored_ts")] if ts else []
    df = df.select(*(c.alias(f"f_{n}") for n, c in own.items()), *(c.alias(n) for n, c in core.items()), *stored)
    df = df.withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))
    return View(df, ColumnFields(df, {p: f"f_{c}" for p, c in fields.items()}), "stored_ts" if ts else None)


def events(spark: SparkSession, sf_dir: str) -> View:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    fields = {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "value": "value", "props.k": "k"}
    return _view(df, "events", ts, "event_type", None, "event_id", fields, "ts")


def documents(spark: SparkSession, sf_dir: str, labels: bool = False) -> View:
    """labels: with the quality of labelled documents, absent on the others."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {"doc_id": "doc_id", "lang": "lang", "n_chars": "n_chars"}
    if labels:
        df = df.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
        fields |= {"quality": "quality", "toxic": "toxic"}
    return _view(df, "documents", F.lit(0).cast("long"), "source", "text", "doc_id", fields)


def conversations(spark: SparkSession, sf_dir: str) -> View:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("place", F.col("conv_id") * 100_000 + F.col("turn"))
    return _view(df, "conversations", F.lit(0).cast("long"), "role", "text", "place", {"conv_id": "conv_id", "turn": "turn"})
