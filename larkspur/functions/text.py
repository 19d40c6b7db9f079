"""Full-text matching of log text as native column expressions.

Tokens are runs of letters, digits, `_` and `-`, with dots between digits; a token with `_`, `-` or `.` in it is
followed by its parts. A token's place in the list is its position for phrases.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_-]*[0-9](?:\.[0-9](?:[\p{L}\p{N}_-]*[0-9])?)*\.[0-9][\p{L}\p{N}_-]*|[\p{L}\p{N}_-]+"
# the same tokens for engines that can hold on to what they matched: no run is gone over again, usual letters are asked first
_RUN = r"[a-z0-9_\p{L}\p{N}-]"
FAST_TOKEN = rf"{_RUN}++(?:(?<=[0-9])\.[0-9]{_RUN}*+)*+"
BREAKS = "[_.-]"


def _with_parts(m: Column) -> Column:
    parts = F.filter(F.split(m, BREAKS), lambda x: (x != "") & (F.length(x) != F.length(m)))
    return F.when(m.rlike(BREAKS), F.concat(F.array(m), parts)).otherwise(F.array(m))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(FAST_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.flatten(F.transform(_runs(text), _with_parts))


def token_set(text: Column) -> Column:
    """tokens(), in no order and mostly once each: only different ones are taken apart."""
    return F.flatten(F.transform(F.array_distinct(_runs(text)), _with_parts))


def tokenize(value: str) -> list[str]:
    """tokens() of one query value, on the driver."""
    out = []
    for m in regex.findall(TOKEN, value.lower()):
        out.append(m)
        if re.search(BREAKS, m):
            out += [x for x in re.split(BREAKS, m) if x and len(x) != len(m)]
    return out


def sure(predicate: Column) -> Column:
    """Missing counts as no match, so that a negation matches it."""
    return F.coalesce(predicate, F.lit(False))


def _holds(text: Column, words: list[str]) -> Column:
    """What a text with these tokens must hold as it stands; cheap, so that few texts are taken apart."""
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(text), F.lit(w))
    return out


def has_tokens(text: Column, value: str) -> Column:
    words = list(dict.fromkeys(tokenize(value)))
    if not words:
        return F.lit(False)
    if len(words) == 1:
        return sure(_holds(text, words) & F.array_contains(tokens(text), words[0]))
    return sure(_holds(text, words) & (F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, words)))) == len(words)))


def has_phrase(text: Column, value: str) -> Column:
    """The value's tokens one after another: a run of lines in the tokens written line by line."""
    words = tokenize(value)
    if len(words) < 2:
        return has_tokens(text, value)
    lines = F.concat(F.lit("\n"), F.array_join(tokens(text), "\n"), F.lit("\n"))
    return sure(_holds(text, list(dict.fromkeys(words))) & F.contains(lines, F.lit("\n" + "\n".join(words) + "\n")))


def is_glob(value: str) -> bool:
    return "*" in value or "?" in value


def glob_regex(pattern: str) -> str:
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + ")$"


def has_glob(text: Column, pattern: str) -> Column:
    """A single token that the pattern fits."""
    fits, pieces = glob_regex(pattern.lower()), [x for x in re.split(r"[*?]+", pattern.lower()) if x]
    return sure(_holds(text, pieces) & F.exists(tokens(text), lambda t: t.rlike(fits)))


def whole_value(text: Column, value: str) -> Column:
    """The whole value, ignoring case; patterns count also in quotes."""
    return sure(F.lower(text).rlike(glob_regex(value.lower())) if is_glob(value) else F.lower(text) == value.lower())


def matches(text: Column, value: str, quoted: bool) -> Column:
    if is_glob(value) and not quoted:
        return has_glob(text, value)
    return has_phrase(text, value) if quoted else has_tokens(text, value)
