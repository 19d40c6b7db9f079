"""Aggregations over log views and the table operations that may follow them.

A `Table` is a DataFrame with named columns and the order of its rows, given by sort expressions whose last ones
make it total: Spark's sort isn't stable, so a new sort puts its column before the ones that held.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.values import MISSING, bucket, label, number_text, round4
from larkspur.operators.fields import View

QUANTILES = {"p50": 0.5, "median": 0.5, "p95": 0.95, "p99": 0.99}
KINDS = {"mean": "avg", "median": "p50"}


@dataclass(frozen=True)
class Agg:
    """count (of rows, or of a field's numbers), sum, avg, min, max, p50, p95, p99, or earliest or latest of timestamp."""

    kind: str
    field: str | None = None
    alias: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "kind", KINDS.get(self.kind, self.kind))
        if self.kind in ("earliest", "latest"):
            if (self.field or "").lower() != "timestamp":
                raise ValueError(f"{self.kind} takes timestamp")
        elif self.kind not in ("count", "sum", "avg", "min", "max", *QUANTILES) or not (self.field or self.kind == "count"):
            raise ValueError(f"not an aggregate: {self.kind!r} of {self.field!r}")

    @property
    def name(self) -> str:
        return self.alias or (self.kind if self.field is None else f"{self.kind}({self.field})")


@dataclass(frozen=True)
class Table:
    """columns: (name, column of df) in order; a name may be given away while its column still orders the rows."""

    df: DataFrame
    columns: tuple[tuple[str, str], ...]
    order: tuple[tuple[str, bool], ...]  # column of df, descending

    def _by(self) -> list[Column]:
        return [F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_first() for c, down in self.order]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.columns)

    def rows(self) -> DataFrame:
        """The table in its order."""
        return self.df.orderBy(*self._by()).select(*(F.col(f"`{c}`").alias(n) for n, c in self.columns))

    def column(self, name: str) -> str:
        if name not in self.names:
            raise ValueError(f"no column {name!r}")
        return dict(self.columns)[name]

    def where(self, name: str, op: str, value: str | float) -> Table:
        """Numbers only equal numbers, texts compare ignoring case; missing values only differ."""
        at = self.column(name)
        column, kind = F.col(f"`{at}`"), dict(self.df.dtypes)[at]
        numeric = kind in ("bigint", "int", "double")
        if isinstance(value, str):
            if op not in ("=", "==", "!="):
                raise ValueError("texts have no order")
            same = F.lower(column.cast("string")) == value.lower() if not numeric else number_text(column) == value
        elif not numeric:
            same = F.lit(False)
            if op not in ("=", "==", "!="):
                return replace(self, df=self.df.filter(F.lit(False)))
        elif op in (">", ">=", "<", "<="):
            test = {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]
            return replace(self, df=self.df.filter(test))
        else:
            same = column == value
        same = F.coalesce(same, F.lit(False))
        return replace(self, df=self.df.filter(~same if op == "!=" else same))

    def keep(self, names: Sequence[str]) -> Table:
        return replace(self, columns=tuple((n, dict(self.columns)[n]) for n in names if n in self.names))

    def drop(self, names: Sequence[str]) -> Table:
        return replace(self, columns=tuple((n, c) for n, c in self.columns if n not in names))

    def rename(self, **new: str) -> Table:
        """old=new, all at once, so two columns may swap their names. Names that aren't there change nothing."""
        return self.renamed(new)

    def renamed(self, new: dict[str, str]) -> Table:
        columns = tuple((new.get(n, n), c) for n, c in self.columns)
        if len({n for n, _ in columns}) < len(columns):
            raise ValueError("two columns of one name")
        return replace(self, columns=columns)

    def sort(self, name: str, descending: bool = False) -> Table:
        """A column that isn't there changes nothing. Missing values come first, as the smallest."""
        if name not in self.names:
            return self
        return replace(self, order=((self.column(name), descending), *self.order))

    def head(self, n: int = 50) -> Table:
        return replace(self, df=self.df.orderBy(*self._by()).limit(n))

    def tail(self, n: int = 50) -> Table:
        """The last n rows, in the same order."""
        turned = replace(self, order=tuple((c, not down) for c, down in self.order))
        return replace(self, df=turned.head(n).df)


def stats(
    view: View, aggs: Sequence[Agg] = (Agg("count"),), by: Sequence[str] = (), span_ms: int | None = None, scan_cap: int | None = None
) -> Table:
    """Groups by the text of fields (missing: an em dash) and, with span_ms, by time; no rows give no groups.

    scan_cap: count at most so many of the newest rows of each partition; off by default, as results are then partial.
    """
    df = view.df
    if scan_cap is not None:
        newest = Window.partitionBy("env", "index", "day").orderBy(F.desc("ts_ms"), "seq")
        df = df.withColumn("__row", F.row_number().over(newest)).filter(F.col("__row") <= scan_cap)
    aggs = list(dict.fromkeys(aggs))
    keys = [label(bucket(F.col("ts_ms"), span_ms), span_ms).alias("_time")] if span_ms else []
    keys += [F.coalesce(view.fields.text(f), F.lit(MISSING)).alias(f) for f in by]
    names = (["_time"] if span_ms else []) + list(by)
    fields = list(dict.fromkeys(a.field for a in aggs if a.field and a.kind not in ("earliest", "latest")))
    rows = df.select(*keys, "ts_ms", *(view.fields.number(f).alias(f"#{f}") for f in fields))
    quoted = [F.col(f"`{n}`") for n in names]

    def column(a: Agg) -> Column:
        x = F.col(f"`#{a.field}`")
        if a.kind == "count":
            out = F.count("*") if a.field is None else F.nullif(F.count(x), F.lit(0))
        elif a.kind in ("earliest", "latest"):
            at = F.min("ts_ms") if a.kind == "earliest" else F.max("ts_ms")
            out = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        else:
            out = round4({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.kind](x))
        return out.alias(a.name)

    plain = [a for a in aggs if a.kind not in QUANTILES]
    grouped = rows.groupBy(*quoted).agg(F.count("*").alias("__n"), *(column(a) for a in plain)).filter("__n > 0")
    for field in dict.fromkeys(a.field for a in aggs if a.kind in QUANTILES):
        mine = [a for a in aggs if a.kind in QUANTILES and a.field == field]
        values = rows.select(*(c.alias(f"__k{i}") for i, c in enumerate(quoted)), F.col(f"`#{field}`").alias("__x"))
        ranks = _nearest_ranks(values, len(names), {a.name: QUANTILES[a.kind] for a in mine})
        on = [F.col(f"`{n}`") == F.col(f"__k{i}") for i, n in enumerate(names)] or [F.col("__n") > 0]
        grouped = grouped.join(ranks, on, "left").drop(*(f"__k{i}" for i in range(len(names))))
    columns = (*names, *(a.name for a in aggs))
    order = tuple((n, False) for n in names) or ((columns[0], False),)
    return Table(grouped.select(*(F.col(f"`{c}`") for c in columns)), tuple((c, c) for c in columns), order)


BINS = (64, 64 << 20)  # bins for each doubling of a value, coarse ones first


def _bin(x: Column, bins: int) -> Column:
    """A coarse order-preserving number of a double."""
    size = F.when(F.abs(x) == float("inf"), 2000 * bins).otherwise(F.floor(F.log2(F.abs(x)) * bins) + 1100 * bins)
    return F.when(F.isnan(x), 4000 * bins).when(x == 0, 0).otherwise(F.signum(x) * size).cast("long")


def _nearest_ranks(values: DataFrame, keys: int, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest ranks of __x by __k0, __k1, ...: counts of bins say in which bin a rank lies, counts of finer ones
    where in it; only the values of those are ordered.

    Counts combine before the shuffle and no group is ordered as a whole, so neither one large group nor a measure with
    any number of different values is one task's work.
    """
    by = [f"__k{i}" for i in range(keys)]
    at = {n: F.floor((F.col("__all") - 1) * q + 0.5) for n, q in quantiles.items()}
    hit = F.lit(False)
    for t in at.values():
        hit = hit | ((t < F.col("__to")) & (t >= F.col("__before")))
    counts = values.filter("__x is not null").groupBy(*by, "__x").agg(F.count("*").alias("__c"))
    names, found = by, []  # found: of the bins chosen so far, how many values the group has and how many come before
    for level, width in enumerate(BINS):
        name = f"__bin{level}"
        counts = counts.withColumn(name, _bin(F.col("__x"), width))
        bins = counts.groupBy(*names, *found, name).agg(F.sum("__c").alias("__in"))
        group = Window.partitionBy(*(names or [F.lit(0)]))
        if not found:
            bins = bins.withColumns({"__all": F.sum("__in").over(group), "__before": F.lit(0)})
        bins = bins.withColumn("__to", F.col("__before") + F.sum("__in").over(group.orderBy(name)))
        chosen = bins.withColumn("__before", F.col("__to") - F.col("__in")).filter(hit)
        names = [*names, name]
        counts = counts.drop(*found).join(chosen.select(*names, "__all", "__before"), names)
        found = ["__all", "__before"]
    inside = Window.partitionBy(*names).orderBy("__x")
    ranked = counts.withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    return ranked.groupBy(*by).agg(*(round4(F.min(F.when(F.col("__upto") > t, F.col("__x")))).alias(n) for n, t in at.items()))


def timechart(
    view: View, span_ms: int, aggs: Sequence[Agg] = (Agg("count"),), by: Sequence[str] = (), cap: int | None = None
) -> Table:
    """stats() with a time column; buckets without rows aren't filled in. cap: fail beyond so many groups, as a caller that
    takes the table to the driver may want; off by default, as groups are counted and ordered in many tasks."""
    table = stats(view, aggs, by, span_ms)
    if cap is not None and table.df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} groups: take a longer span or fewer fields")
    return table


def top(view: View, field: str, n: int = 10, rare: bool = False) -> Table:
    return stats(view, [Agg("count")], [field]).sort("count", descending=not rare).head(n)


def timechart_pivot(table: Table, key: str, value: str = "count", series: int = 20) -> DataFrame:
    """One column per series, the `series` largest by total; 0 where a bucket has none."""
    totals = table.df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.sum(F.col(f"`{value}`")).alias("t"))
    names = [r["k"] for r in totals.orderBy(F.desc("t"), "k").limit(series).collect()]
    wide = table.df.groupBy("_time").pivot(key, names).agg(F.sum(F.col(f"`{value}`")))
    return wide.fillna(0)
