"""Push bodies to (index, event): one row per request body in the column `body`.

A spoilt record doesn't take the others with it: readers yield it as `Spoilt`, and `unpacked` gives it a row of its own
that says so in `bad`. A body that can't be read at all is one such row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources import telemetry


PIECE, EACH = 4 << 20, 100  # characters of events that a Python worker keeps before it hands them on, and what one adds
ERRORS = (ValueError, AttributeError, TypeError, KeyError, IndexError, RecursionError)


@dataclass
class Spoilt:
    """What couldn't be read as an event."""

    text: str


Found = Iterator[tuple[str, "dict | Spoilt"]]


def _each(items: object, index: str, read: Callable[[object], Iterable]) -> Found:
    """What read() gives of every item; one that it can't read is spoilt, and the next ones are read."""
    for item in items if isinstance(items, list) else [] if items is None else [Spoilt]:
        try:
            found = list(read(items if item is Spoilt else item))
        except ERRORS:
            found = [(index, Spoilt(json.dumps(items if item is Spoilt else item)))]
        yield from found


def _whole_number(value: object) -> int | None:
    try:
        return int(value) if not isinstance(value, (bool, float)) else None
    except (TypeError, ValueError):
        return None


def collector_events(body: str, index: str) -> Found:
    """JSON objects one after another; each is an envelope with `event`, or the event itself."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(body):
        if body[at].isspace():
            at += 1
            continue
        try:
            item, at = decoder.raw_decode(body, at)
        except ValueError:
            yield index, Spoilt(body[at:])  # nothing after a malformed value can be trusted
            return
        if not isinstance(item, dict):
            yield index, Spoilt(json.dumps(item))
            continue
        if "event" not in item:
            yield index, item
            continue
        inner = item["event"]
        event = dict(inner) if isinstance(inner, dict) else {"message": inner if isinstance(inner, str) else json.dumps(inner)}
        extra = dict(item["fields"]) if isinstance(item.get("fields"), dict) else {}
        extra |= {"timestamp": item["time"]} if "time" in item else {}
        extra |= {k: item[k] for k in ("host", "source", "sourcetype") if isinstance(item.get(k), str)}
        yield (item.get("index") if isinstance(item.get("index"), str) and item["index"] else index), {**extra, **event}


def _attribute(value: object) -> object:
    if not isinstance(value, dict):
        return value
    for kind in ("stringValue", "intValue", "boolValue", "doubleValue"):
        if kind in value:
            whole = _whole_number(value[kind]) if kind == "intValue" else None
            return value[kind] if whole is None else whole
    return json.dumps(value, separators=(",", ":"), sort_keys=True)


def _attributes(items: object) -> dict:
    return {a["key"]: _attribute(a["value"]) for a in items or [] if isinstance(a, dict) and isinstance(a.get("key"), str) and "value" in a}


def telemetry_logs(body: str, index: str) -> Found:
    """OTLP JSON: attributes of the resource and the record side by side, then the record's own fields."""

    def group(g: dict) -> Found:
        base = _attributes((g.get("resource") or {}).get("attributes"))

        def record(r: dict) -> Found:
            event = base | _attributes(r.get("attributes"))
            if "body" in r:
                event["message"] = _attribute(r["body"])
            at = _whole_number(r.get("timeUnixNano", r.get("observedTimeUnixNano")))
            if at is not None:
                event["timestamp"] = at
            own = {"severity": r.get("severityText"), "traceId": r.get("traceId"), "spanId": r.get("spanId")}
            yield index, {k: v for k, v in own.items() if isinstance(v, str)} | event

        return _each(g.get("scopeLogs"), index, lambda scope: _each(scope.get("logRecords"), index, record))

    return _each(json.loads(body).get("resourceLogs"), index, group)


def label_streams(body: str, index: str) -> Found:
    """Streams of (time, line, metadata): lines that are objects give fields; labels fill what is missing."""

    def stream(s: dict) -> Found:
        labels = s.get("stream") if isinstance(s.get("stream"), dict) else {}

        def entry(e: list) -> Found:
            if not isinstance(e, list):
                raise TypeError("not an entry")
            line = e[1] if len(e) > 1 and isinstance(e[1], str) else None
            try:
                parsed = json.loads(line) if line is not None else {}
            except ValueError:
                parsed = None
            event = parsed if isinstance(parsed, dict) else {"message": line}
            at = _whole_number(e[0]) if e else None
            metadata = e[2] if len(e) > 2 and isinstance(e[2], dict) else {}
            yield index, metadata | labels | ({} if at is None else {"timestamp": at}) | event

        return _each(s.get("values"), index, entry)

    return _each(json.loads(body).get("streams"), index, stream)


def bulk_pairs(body: str, index: str) -> Found:
    """Action lines, each followed by its document line unless it deletes. Lines are told apart by their place alone, so a
    document may look like an action; lines that aren't JSON, documents that aren't objects and other actions are spoilt."""
    waiting: tuple[str, bool] | None = None
    for line in filter(str.strip, body.splitlines()):
        try:
            item = json.loads(line)
        except ValueError:
            yield index, Spoilt(line)
            continue
        if waiting:
            (target, update), waiting = waiting, None
            event = item.get("doc", item) if update and isinstance(item, dict) else item
            yield target, event if isinstance(event, dict) else Spoilt(line)
        elif isinstance(item, dict) and (action := next(iter(item), None)) in ("index", "create", "update"):
            about = item[action] if isinstance(item[action], dict) else {}
            target = about.get("_index")
            waiting = (target if isinstance(target, str) and target else index), action == "update"
        elif not (isinstance(item, dict) and next(iter(item), None) == "delete"):
            yield index, Spoilt(line)


Reader = Callable[[str, str], Found]
READERS: dict[str, Reader] = {"collector": collector_events, "otlp": telemetry_logs, "streams": label_streams, "bulk": bulk_pairs}


def unpacked(bodies: DataFrame, kind: str, default_index: str = "main") -> DataFrame:
    """index, event, bad of the bodies, texts or for `otlp_binary` bytes; bad: `record` or `body`, whose text event is then."""
    read, binary = (telemetry.records, True) if kind == "otlp_binary" else (READERS[kind], False)

    def one(body: str | bytes | None) -> Iterator[tuple[str, str, str | None]]:
        try:
            for i, e in read(body or (b"" if binary else ""), default_index):
                yield (i, e.text, "record") if isinstance(e, Spoilt) else (i, json.dumps(e), None)
        except ERRORS:
            if body:
                yield default_index, body.decode("utf-8", "replace") if binary else body, "body"

    def packed(found: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["index", "event", "bad"])

    def run(batches):
        for batch in batches:
            found, size = [], 0
            for body in batch.column(0):
                for x in one(body.as_py()):
                    found.append(x)
                    size += len(x[1]) + EACH
                    if size >= PIECE:  # a batch of bodies holds any number of events
                        yield packed(found)
                        found, size = [], 0
            yield packed(found)

    return bodies.select(F.col("body").cast("binary" if binary else "string")).mapInArrow(run, "index string, event string, bad string")


def unpack(bodies: DataFrame, kind: str, default_index: str = "main") -> DataFrame:
    """index, event of what unpacked() could read."""
    return unpacked(bodies, kind, default_index).filter("bad is null").drop("bad")
