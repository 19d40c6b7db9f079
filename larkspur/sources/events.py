"""JSON events as rows: core fields, text and shredded leaves.

Known names of the core fields are taken from the event's top level, in order, the first that is usable; whatever is left
is shredded into leaves with lower-case dotted paths. Events without a usable time get ts_ms 0 and the day they arrive
on. No event stops the others: a text that isn't a JSON object, or is nested too deep to read, becomes a row that says so
in `bad` (`json`), as does an event that can't be shredded (`value`); the store leaves these out and counts them. Times
beyond the years 1 to 9999 are no times, numbers beyond a double are infinite, halves of surrogate pairs become U+FFFD.
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of core fields in the order they are tried.
TIME_NAMES = ("timestamp", "ts", "time", "@timestamp", "Timestamp", "eventTime", "datetime", "@t", "asctime")
MESSAGE_NAMES = ("message", "msg", "Body", "body", "event", "Msg", "log.body", "@m", "@mt")
SOURCE_NAMES = ("source", "log.source", "_source")
CONTAINERS = ("Attributes", "Resource", "attributes", "resource")
DEPTH, ELEMENTS = 16, 1000
PIECE = 4 << 20  # characters of events that a Python worker takes apart at a time
LAYOUTS = (
    "%d/%b/%Y:%H:%M:%S %z",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M:%S,%f",
)

LEAF = "struct<path:string,pos:int,i:bigint,d:double,b:boolean,s:string>"
ROW = f"ts_ms bigint, timed boolean, message string, source string, raw string, target string, bad string, leaves array<{LEAF}>"
TEXTS = ("message", "source", "raw", "target", "bad")
_LEAF = [("path", pa.string()), ("pos", pa.int32()), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_()), ("s", pa.string())]
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999
_HALVES = re.compile("[\ud800-\udfff]")
_FIELD = re.compile(r"\{\{(.+?)\}\}")
_CONTAINERS, _EPOCH, _MS = frozenset(CONTAINERS), datetime(1970, 1, 1, tzinfo=timezone.utc), datetime.resolution * 1000


_compact = json.JSONEncoder(separators=(",", ":"), sort_keys=True).encode
_encoded = json.JSONEncoder(separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode


def epoch_ms(value: object) -> int | None:
    """Milliseconds of a time given as a number of seconds, ms, us or ns, or as text in a usual layout."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        size = abs(value)
        if not size < 1e22:
            return None
        ms = value * 1000 // 1 if size < 1e10 else value if size < 1e13 else value // 1e3 if size < 1e16 else int(value) // 1_000_000
        return int(ms) if FIRST_MS <= ms <= LAST_MS else None
    if not isinstance(value, str):
        return None
    at = None
    try:
        at = datetime.fromisoformat(value)
        at = at if "T" in value and at.tzinfo else None
    except ValueError:
        pass
    for layout in LAYOUTS if at is None else ():
        try:
            at = datetime.strptime(value, layout)
            break
        except ValueError:
            continue
    if at is None:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - _EPOCH) // _MS


def _double(value: float) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def leaves(event: dict) -> list[tuple]:
    """(path, pos, i, d, b, s) of scalars under their lower-case dotted path; elements of a list share one path and are
    numbered per type."""
    out: list[tuple] = []
    seen: dict[tuple[str, str], int] = {}

    def walk(path: str, value: object, depth: int) -> None:
        kind = type(value)
        if depth > DEPTH and (kind is dict or kind is list):
            value, kind = _compact(value), str
        if kind is str:
            n = seen[path, "s"] = seen.get((path, "s"), -1) + 1
            out.append((path, n, None, None, None, value))
        elif kind is int and -(1 << 63) <= value < 1 << 63:
            n = seen[path, "i"] = seen.get((path, "i"), -1) + 1
            out.append((path, n, value, None, None, None))
        elif kind is float or kind is int:
            n = seen[path, "d"] = seen.get((path, "d"), -1) + 1
            out.append((path, n, None, _double(value), None, None))
        elif kind is bool:
            n = seen[path, "b"] = seen.get((path, "b"), -1) + 1
            out.append((path, n, None, None, value, None))
        elif kind is dict:
            for k, v in value.items():
                walk(f"{path}.{k.lower()}", v, depth + 1)
        elif kind is list:
            for v in value[:ELEMENTS]:
                walk(path, v, depth + 1)

    for k, v in event.items():
        walk(k.lower(), v, 1)
    return out


@lru_cache(4096)
def _name_part(text: str) -> str:
    return re.sub(r"[^a-z0-9_-]", "-", text.lower()).strip("-")[:64] or "unknown"


def index_name(template: str, event: dict) -> str:
    """`app-{{field}}` with the event's values, cleaned for use in a path; `unknown` for missing ones."""
    if "{{" not in template:
        return template

    def value(m: re.Match) -> str:
        at: object = event
        name = m[1].strip()
        if name in event:
            at = event[name]
        else:
            for part in name.split("."):
                at = at.get(part) if isinstance(at, dict) else None
        if at is None or isinstance(at, (dict, list)):
            return "unknown"
        text = json.dumps(at) if not isinstance(at, str) else at
        return _name_part(text) if len(text) < 256 else _name_part.__wrapped__(text)  # long texts aren't kept

    return _FIELD.sub(value, template)


def _first_text(names: tuple[str, ...], event: dict) -> str | None:
    """The first of the names that is a text with something in it."""
    for n in names:
        if n in event and isinstance(event[n], str) and event[n]:
            return n
    return None


def row(event: dict, default_source: str | None, template: str) -> dict:
    raw = _encoded(event)
    target = index_name(template, event)
    rest = dict(event)
    if not _CONTAINERS.isdisjoint(rest):
        for name in CONTAINERS:
            if isinstance(rest.get(name), dict):
                rest = {**rest.pop(name), **rest}
    ts = None
    for name in TIME_NAMES:
        if name in rest and (ts := epoch_ms(rest[name])) is not None:
            del rest[name]
            break
    message, source = _first_text(MESSAGE_NAMES, rest), _first_text(SOURCE_NAMES, rest)
    return {
        "ts_ms": ts or 0, "timed": ts is not None, "message": rest.pop(message) if message else None,
        "source": rest.pop(source) if source else default_source, "raw": raw, "target": target, "bad": None, "leaves": leaves(rest),
    }


def _shred(text: str | None, default_source: str | None, template: str) -> dict:
    """row() of an event's text, or a row that says what is wrong with it."""
    bad = {"ts_ms": 0, "timed": False, "message": None, "source": None, "raw": text, "target": "", "leaves": []}
    try:
        event = json.loads(text or "")
    except (ValueError, RecursionError):
        return bad | {"bad": "json"}
    if not isinstance(event, dict):
        return bad | {"bad": "json"}
    try:
        return row(event, default_source, template)
    except (ValueError, OverflowError, RecursionError):
        return bad | {"bad": "value"}


def _whole(text: str | None) -> str | None:
    return _HALVES.sub("\ufffd", text) if text is not None and not text.isascii() else text


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array(list(map(_whole, values)), pa.string())


def _batch(found: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r["ts_ms"] for r in found], pa.int64()), pa.array([r["timed"] for r in found], pa.bool_())]
    columns += [_texts([r[t] for r in found]) for t in TEXTS]
    ends = [0]
    for r in found:
        ends.append(ends[-1] + len(r["leaves"]))
    flat = list(zip(*(x for r in found for x in r["leaves"]))) or [()] * len(_LEAF)
    parts = [_texts(list(c)) if n in ("path", "s") else pa.array(c, t) for c, (n, t) in zip(flat, _LEAF)]
    leaf = pa.StructArray.from_arrays(parts, names=[n for n, _ in _LEAF])
    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf))
    return pa.RecordBatch.from_arrays(columns, names=["ts_ms", "timed", *TEXTS, "leaves"])


def rows(
    events: DataFrame, arrived_ms: int | Column, default_source: str | None = None, template: str = "main", env: str | Column = "default"
) -> DataFrame:
    """Rows of a log view from a column `event` of JSON texts, and `bad` for those that aren't events.

    arrived_ms decides the day of events without a time; a stream gives each batch its own. env: of all events, or an
    expression of the row's own columns, so that events of several environments are stored by one append.
    """

    def shred(batches):
        for batch in batches:
            found, size = [], 0
            for text in batch.column(0):
                event = text.as_py()
                found.append(_shred(event, default_source, template))
                size += len(event or "")
                if size >= PIECE:  # long texts don't wait for a whole batch of them
                    yield _batch(found)
                    found, size = [], 0
            yield _batch(found)

    out = events.select("event").mapInArrow(shred, ROW)
    arrived = arrived_ms if isinstance(arrived_ms, Column) else F.lit(arrived_ms)
    day = F.to_date(F.timestamp_millis(F.when(F.col("timed"), F.col("ts_ms")).otherwise(arrived)))
    index = F.when(F.col("bad").isNull(), F.col("target")).alias("index")
    core = [(env if isinstance(env, Column) else F.lit(env)).alias("env"), index, day.alias("day"), "ts_ms", "message", "source", "raw", F.xxhash64("raw").alias("seq")]
    return out.select(*core, "leaves", "bad")


def good(rows_: DataFrame) -> DataFrame:
    """Only the rows of events, for views without a store between."""
    return rows_.filter("bad is null").drop("bad")


def bad_lines(rows_: DataFrame) -> DataFrame:
    """reason, raw of the texts that rows() couldn't take as events."""
    return rows_.filter("bad is not null").select(F.col("bad").alias("reason"), "raw")
