"""What fields a view has, and how large its partitions are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.fields import View

# Limits of discovery and the catalog.
CARDINALITY_CAP = 1000
SAMPLE, TOP, EXAMPLES = 10_000, 30, 5
LEAST_COVERAGE, LEAST_DENSITY, LEAST_CARDINALITY = 0.05, 3.0, 2
GLANCE_COVERAGE, GLANCE_CARDINALITY = 0.5, 20


def field_catalog(view: View) -> DataFrame:
    """path, kind, rows, coverage, cardinality, interesting: exact over all rows; numbers and booleans have cardinality 0.

    Values are counted before the shuffle, so it carries one row for each distinct text of a task, not one a row.
    """
    rows = view.df.select("seq", F.explode(view.fields.leaves()).alias("x")).select("seq", "x.*")
    total = view.df.count()
    kind = F.when(F.col("s").isNotNull(), "string").when(F.col("b").isNotNull(), "bool").otherwise("number")
    # by value first, so that a hot value or field is combined before the shuffle
    values = rows.filter("pos = 0").groupBy("path", kind.alias("kind"), "s").agg(F.count("*").alias("n"))
    whole = values.groupBy("path").agg(F.sum("n").alias("rows"), F.count("s").alias("cardinality"), F.min("kind").alias("kind"))
    coverage = F.col("rows") / F.lit(max(total, 1))
    interesting = F.col("cardinality").between(2, CARDINALITY_CAP) & (coverage >= 0.05)
    cardinality = F.col("cardinality").cast("long").alias("cardinality")
    return whole.select("path", "kind", "rows", coverage.alias("coverage"), cardinality, interesting.alias("interesting")).orderBy("path")


def discover(view: View, sample: int = SAMPLE, top: int = TOP) -> DataFrame:
    """The `top` fields of the newest rows of each partition, `sample` rows in all, by coverage * ln(1 + distinct values).

    kind: string, int, float, bool or mixed; groupable: frequent enough, of more than one value and LEAST_DENSITY rows a
    value; interesting: a groupable one of few values that most rows have; examples: the least EXAMPLES values.
    """
    parts = max(1, len(view.partitions) if view.partitions else view.df.select("env", "index", "day").distinct().count())
    newest = Window.partitionBy("env", "index", "day").orderBy(F.desc("ts_ms"), "seq")
    rows = view.df.withColumn("row", F.row_number().over(newest)).filter(F.col("row") <= -(-sample // parts))
    sampled = F.lit(max(1, rows.count()))
    leaves = rows.select(F.explode(view.fields.leaves()).alias("x")).select("x.*").filter("pos = 0")
    value = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"))
    kind = F.when(F.col("s").isNotNull(), "string").when(F.col("i").isNotNull(), "int").when(F.col("b").isNotNull(), "bool")
    values = leaves.groupBy("path", value.alias("value"), kind.otherwise("float").alias("kind")).agg(F.count("*").alias("n"))
    least = Window.partitionBy("path").orderBy("value")
    ranked = values.withColumn("rank", F.dense_rank().over(least))
    examples = F.array_sort(F.collect_set(F.when(F.col("rank") <= EXAMPLES, F.col("value"))))
    kinds = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed")
    figures = [F.sum("n").alias("hits"), F.max("rank").alias("distinct"), kinds.alias("kind"), examples.alias("examples")]
    fields = ranked.groupBy("path").agg(*figures)
    hits, distinct = F.col("hits"), F.least("distinct", F.lit(CARDINALITY_CAP)).cast("long")
    coverage, capped = hits / sampled, F.col("distinct") >= CARDINALITY_CAP
    groupable = ~capped & (distinct >= LEAST_CARDINALITY) & (coverage >= LEAST_COVERAGE) & (hits / distinct >= LEAST_DENSITY)
    interesting = groupable & (coverage >= GLANCE_COVERAGE) & (distinct <= GLANCE_CARDINALITY)
    out = fields.select(
        "path", "kind", coverage.alias("coverage"), distinct.alias("cardinality"), capped.alias("capped"),
        groupable.alias("groupable"), interesting.alias("interesting"), (coverage * F.log1p(distinct)).alias("score"), "examples",
    )
    return out.orderBy(F.desc("score"), "path").limit(top)


def partition_info(view: View) -> DataFrame:
    """Rows and times of every partition. For a store's files and bytes see store.partition_figures()."""
    figures = [F.count("*").alias("rows"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")]
    return view.df.groupBy("env", "index", "day").agg(*figures)


def index_info(view: View) -> DataFrame:
    """Per environment and index: rows, partitions, first and last day."""
    figures = [F.sum("rows").alias("rows"), F.count("*").alias("partitions")]
    figures += [F.min("day").alias("first_day"), F.max("day").alias("last_day")]
    return partition_info(view).groupBy("env", "index").agg(*figures)
