"""OTLP log requests in their binary form, as the dictionaries that the JSON form gives.

Only the message's wire format is read: fields are numbered, a field that isn't known is passed over.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

# Field numbers of the public OTLP schema.
RESOURCE_LOGS = 1
RESOURCE, SCOPE_LOGS = 1, 2
ATTRIBUTES = 1
LOG_RECORDS = 2
TIME, SEVERITY_TEXT, BODY, RECORD_ATTRIBUTES, TRACE, SPAN, OBSERVED = 1, 3, 5, 6, 9, 10, 11
STRING, BOOL, INT, DOUBLE, LIST, MAP, BYTES = 1, 2, 3, 4, 5, 6, 7


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("varint of more than ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers for varints, bytes for everything else."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("message ends early")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _value(data: bytes) -> object:
    out: object = None
    for number, v in fields(data):
        if number == STRING:
            out = v.decode("utf-8", "replace")
        elif number == BOOL:
            out = bool(v)
        elif number == INT:
            out = v - (1 << 64) if v >> 63 else v
        elif number == DOUBLE:
            out = struct.unpack("<d", v)[0]
        elif number == LIST:
            out = [_value(x) for n, x in fields(v) if n == 1]
        elif number == MAP:
            out = _pairs(x for n, x in fields(v) if n == 1)
        elif number == BYTES:
            out = base64.b64encode(v).decode()
    return out


def _pairs(items: Iterator[bytes]) -> dict:
    out = {}
    for item in items:
        parts = dict(fields(item))
        if 2 in parts:
            out[parts.get(1, b"").decode("utf-8", "replace")] = _value(parts[2])
    return out


def records(body: bytes, index: str) -> Iterator[tuple[str, dict]]:
    """Attributes of the resource and the record side by side, then the record's own fields."""
    for group in (v for n, v in fields(body) if n == RESOURCE_LOGS):
        base: dict = {}
        for resource in (v for n, v in fields(group) if n == RESOURCE):
            base |= _pairs(v for n, v in fields(resource) if n == ATTRIBUTES)
        for scope in (v for n, v in fields(group) if n == SCOPE_LOGS):
            for record in (v for n, v in fields(scope) if n == LOG_RECORDS):
                own, found = dict(fields(record)), _pairs(v for n, v in fields(record) if n == RECORD_ATTRIBUTES)
                event = base | found
                if BODY in own:
                    event["message"] = _value(own[BODY])
                at = next((t for n in (TIME, OBSERVED) if n in own and (t := int.from_bytes(own[n], "little"))), 0)
                if at:
                    event["timestamp"] = at
                named = {"severity": own.get(SEVERITY_TEXT, b"").decode("utf-8", "replace")}
                named |= {"traceId": own.get(TRACE, b"").hex(), "spanId": own.get(SPAN, b"").hex()}
                yield index, {k: v for k, v in named.items() if v} | event
