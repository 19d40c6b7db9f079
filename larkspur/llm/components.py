"""Connected components of a graph by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize, release


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (a, b): the component is its smallest node. Null ends are ignored.

    The result is a table of its own, which the caller may release().
    """
    now = edges.filter("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge now points to a smaller node
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        both_ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(lowest, "a").select(F.explode(both_ends).alias("e"))
        new = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        release(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    release(now)
    return out
