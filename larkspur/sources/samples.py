"""Sample events to try searches on: five services over the last day, more of them the nearer to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SERVICES = ("gateway", "orders", "billing", "search", "mailer")
LEVELS = ("INFO", "INFO", "INFO", "DEBUG", "WARN", "ERROR")
PATHS = ("/", "/cart", "/checkout", "/items", "/items/{n}", "/account")
SAYINGS = ("request served", "slow answer from upstream", "retry scheduled", "cache miss", "connection refused", "job finished")


def sample_events(spark: SparkSession, n: int, end_ms: int, seed: int = 1) -> DataFrame:
    """index, event of n events; the same for the same seed."""
    draw = lambda i, of: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(of))
    pick = lambda i, of: F.get(F.array(*map(F.lit, of)), draw(i, len(of)).cast("int"))
    back = draw(1, 1_000_001) / 1_000_000
    at = F.timestamp_millis((F.lit(end_ms) - back * back * DAY_MS).cast("long"))
    path = F.replace(pick(4, PATHS), F.lit("{n}"), draw(5, 100).cast("string"))
    fields = [
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        pick(2, LEVELS).alias("level"),
        pick(3, SAYINGS).alias("message"),
        F.struct(path.alias("path"), draw(6, 900).alias("ms")).alias("http"),
        F.concat(F.lit("host-"), draw(7, 8).cast("string")).alias("host"),
    ]
    rows = spark.range(n).select(pick(8, SERVICES).alias("index"), F.to_json(F.struct(*fields)).alias("event"))
    return rows
