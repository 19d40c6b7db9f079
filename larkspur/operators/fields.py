"""How a field name of a query becomes columns.

A view has the columns env, index, day, ts_ms, message, source, raw and seq, and its dynamic fields either as typed
columns (`ColumnFields`: predicates reach the Parquet scan) or as shredded leaves (`LeafFields`: any path, mixed
types, several values). Searching and aggregating resolve names differently, and both classes keep the two apart:
`term` and `compare` search, `text` and `number` aggregate.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import has_phrase, sure
from larkspur.functions.values import as_integer, as_number, number_of_text

CORE = ("env", "index", "day", "ts_ms", "message", "source", "raw", "seq")
COMPARE: dict[str, Callable[[Column, float], Column]] = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
PROMOTED = "struct<t:string,i:bigint,d:double,b:boolean>"
PROMOTED_N = "promoted"  # how many fields have columns of their own in a row's file; null in files without any
LEAF_TYPES = {"i": "long", "d": "double", "b": "boolean", "s": "string"}


def promoted_column(k: int) -> str:
    return f"f_{k}"


def _typed_term(column: Column, kind: str, value: str) -> Column:
    """kind: i, d, b or s."""
    i, d = as_integer(value), as_number(value)
    if kind == "s":
        return has_phrase(column, value)
    if kind == "i" and i is not None:
        return sure(column == i)
    if kind == "d" and d is not None:
        return sure(column == d)
    if kind == "b" and value in ("true", "false"):
        return sure(column == (value == "true"))
    return F.lit(False)


def whole_compare(column: Column, op: str, v: float) -> Column:
    """A comparison of whole numbers with any number, as one with a whole number, which reaches the scan."""
    if math.isnan(v):
        return F.lit(False)
    if abs(v) >= 1 << 63:
        return F.lit((v > 0) == (op in ("<", "<="))) & column.isNotNull()
    bound = math.floor(v) if op in (">", "<=") else math.ceil(v)
    if bound == 1 << 63:  # of numbers just below
        return F.lit(op in ("<", "<=")) & column.isNotNull()
    return COMPARE[op](column, F.lit(bound).cast("long"))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def core_text(field: str) -> Column | None:
    if field in ("index", "message", "source", "raw"):
        return F.col(field)
    if field == "timestamp":
        return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    return None


class ColumnFields:
    """Dynamic fields that are columns of the view; `columns` maps lower-case paths to column names."""

    def __init__(self, df: DataFrame, columns: dict[str, str]):
        kinds = {"bigint": "i", "int": "i", "smallint": "i", "tinyint": "i", "double": "d", "float": "d", "boolean": "b", "string": "s"}
        types = dict(df.dtypes)
        self.columns = {p.lower(): (c, kinds[types[c]]) for p, c in columns.items()}

    def paths(self, name: str) -> list[str]:
        name = name.lower()
        return [p for p in self.columns if p == name or ("." not in name and p.rsplit(".", 1)[-1] == name)]

    def term(self, name: str, value: str) -> Column:
        found = [self.columns[p] for p in self.paths(name)]
        return _any([_typed_term(F.col(f"`{column}`"), kind, value) for column, kind in found])

    def compare(self, name: str, op: str, bound: str) -> Column:
        column, kind = self.columns.get(name.lower(), (None, ""))
        v = as_number(bound)
        return sure(COMPARE[op](F.col(f"`{column}`"), v)) if kind in ("i", "d") and v is not None else F.lit(False)

    def text(self, name: str) -> Column:
        if (core := core_text(name)) is not None:
            return core
        column, _ = self.columns.get(name.lower(), (None, ""))
        return F.col(f"`{column}`").cast("string") if column else F.lit(None).cast("string")

    def number(self, name: str) -> Column:
        column, kind = self.columns.get(name.lower(), (None, ""))
        if not column:
            return F.lit(None).cast("double")
        value = F.col(f"`{column}`")
        return number_of_text(value) if kind == "s" else (value.cast("int") if kind == "b" else value).cast("double")

    def leaves(self) -> Column:
        """The fields as an array of leaves, for discovery."""
        each = []
        for path, (column, kind) in self.columns.items():
            value = F.col(f"`{column}`")
            typed = [(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in LEAF_TYPES.items()]
            each.append(F.when(value.isNotNull(), F.struct(F.lit(path).alias("path"), F.lit(0).alias("pos"), *typed)))
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    def plain(self, df: DataFrame) -> DataFrame:
        """The core columns and the fields under their own names, as a table for SQL."""
        own = [F.col(f"`{c}`").alias(p) for p, (c, _) in self.columns.items() if p not in CORE]
        return df.select(*(c for c in CORE if c in df.columns), *own)


class LeafFields:
    """Dynamic fields in the column `leaves`: array of (path, pos, i, d, b, s); raw is the event's JSON text."""

    def term(self, name: str, value: str) -> Column:
        name = name.lower()
        here = (lambda x: x.path == name) if "." in name else (lambda x: (x.path == name) | x.path.endswith("." + name))
        return sure(F.exists("leaves", lambda x: here(x) & _any([_typed_term(x[k], k, value) for k in "idbs"])))

    def compare(self, name: str, op: str, bound: str) -> Column:
        v = as_number(bound)
        if v is None:
            return F.lit(False)
        first = lambda x: (x.path == name.lower()) & (x.pos == 0)  # noqa: E731 - further values of a field aren't compared
        return sure(F.exists("leaves", lambda x: first(x) & (sure(whole_compare(x.i, op, v)) | sure(COMPARE[op](x.d, v)))))

    def text(self, name: str) -> Column:
        """The value at a path in the event, names in any case: the whole name at the top, else name by name."""
        if (core := core_text(name)) is not None:
            return core
        step = lambda json, key: F.get(
            F.filter(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.lower(e.key) == key.lower()), 0
        )["value"]
        at, parts = F.col("raw"), name.split(".")
        for part in parts:
            at = step(at, part)
        return F.coalesce(step(F.col("raw"), name), at) if len(parts) > 1 else at

    def number(self, name: str) -> Column:
        flag = F.element_at(F.filter("leaves", lambda x: (x.path == name.lower()) & x.b.isNotNull() & (x.pos == 0)), 1)
        flag = F.when(F.exists("leaves", lambda x: (x.path == name.lower()) & x.b.isNotNull()), flag.b.cast("int").cast("double"))
        return F.coalesce(flag, number_of_text(self.text(name)))

    def promoted(self, path: str) -> Column:
        """What a column of its own keeps of a field: its text, and its first whole number, double and flag."""
        first = lambda k: F.get(F.filter("leaves", lambda x: (x.path == path) & (x.pos == 0) & x[k].isNotNull()), 0)[k]
        return F.struct(self.text(path).alias("t"), *(first(k).alias(k) for k in "idb"))

    def leaves(self) -> Column:
        return F.col("leaves")

    def plain(self, df: DataFrame) -> DataFrame:
        """The core columns, and the leaves as they are."""
        return df.select(*(c for c in CORE if c in df.columns), "leaves")


class PromotedFields(LeafFields):
    """Leaves, and columns beside them for some paths: in all files for the first `everywhere` of these, in some for others."""

    def __init__(self, paths: list[str], everywhere: int):
        self.places, self.everywhere = {p: k for k, p in enumerate(paths)}, everywhere

    def _either(self, name: str, own: Callable[[Column], Column], leaf: Callable[[], Column]) -> Column:
        k = self.places.get(name.lower())
        if k is None or core_text(name) is not None:
            return leaf()
        column = F.col(promoted_column(k))
        return own(column) if k < self.everywhere else F.when(F.col(PROMOTED_N) > k, own(column)).otherwise(leaf())

    def compare(self, name: str, op: str, bound: str) -> Column:
        v, k = as_number(bound), self.places.get(name.lower())
        if v is None or k is None:
            return super().compare(name, op, bound)
        i, d = (F.col(promoted_column(k))[x] for x in "id")
        own = (i.isNotNull() & whole_compare(i, op, v)) | (d.isNotNull() & COMPARE[op](d, v))  # never null, and reaches the scan
        if k < self.everywhere:
            return own
        n = F.col(PROMOTED_N)
        return (n.isNotNull() & (n > k) & own) | ((n.isNull() | (n <= k)) & super().compare(name, op, bound))

    def text(self, name: str) -> Column:
        return self._either(name, lambda c: c.t, lambda: LeafFields.text(self, name))

    def number(self, name: str) -> Column:
        own = lambda c: F.coalesce(c.b.cast("int").cast("double"), number_of_text(c.t))
        return self._either(name, own, lambda: LeafFields.number(self, name))


class View:
    """A log view: a DataFrame with the core columns, and how its fields are found.

    ts: a stored timestamp column that ts_ms is made of, so that time windows can skip row groups. partitions: (env,
    index, day) of all partitions where they are known without reading rows.
    """

    def __init__(
        self,
        df: DataFrame,
        fields: ColumnFields | LeafFields,
        ts: str | None = None,
        partitions: list[tuple[str, str, str]] | None = None,
    ):
        self.df, self.fields, self.ts, self.partitions = df, fields, ts, partitions

    def where(self, predicate: Column) -> View:
        return View(self.df.filter(predicate), self.fields, self.ts, self.partitions)
