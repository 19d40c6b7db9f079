"""Searches as Python values.

A `Filter` is made of words, phrases, comparisons and index patterns, joined by `&`, `|` and `~`; `find` gives the rows
of a view that it may see and that it fits. What follows a search is a call of the operators on the view found, or
Spark SQL (also its `|>` pipes) over `register`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import is_glob, tokenize
from larkspur.operators import search
from larkspur.operators.fields import View
from larkspur.sources.store import StoredView, newest


MOST_NEEDS = 64


@dataclass(frozen=True)
class Filter:
    """A predicate for any view, the index patterns that choose its partitions, and the words to highlight in hits.

    needs: sets of words; an event that fits has at least one word of each, so files without them needn't be read.
    """

    predicate: Callable[[View], Column]
    indexes: tuple[str, ...] = ()
    highlights: tuple[str, ...] = ()
    needs: tuple[frozenset[str], ...] = ()

    def _with(self, other: Filter, join: Callable[[Column, Column], Column], needs: Iterable[frozenset[str]]) -> Filter:
        shown = tuple(dict.fromkeys(self.highlights + other.highlights))
        needs = tuple(dict.fromkeys(needs))
        return Filter(lambda v: join(self.predicate(v), other.predicate(v)), self.indexes + other.indexes, shown, needs)

    def __and__(self, other: Filter) -> Filter:
        return self._with(other, lambda a, b: a & b, self.needs + other.needs)

    def __or__(self, other: Filter) -> Filter:
        """What either side needs, one of the two needs."""
        every = (a | b for a in self.needs for b in other.needs) if len(self.needs) * len(other.needs) <= MOST_NEEDS else ()
        return self._with(other, lambda a, b: a | b, every)

    def __invert__(self) -> Filter:
        """Index patterns choose partitions even here; a field that is missing fits."""
        return Filter(lambda v: ~self.predicate(v), self.indexes)


def everything() -> Filter:
    return Filter(lambda v: F.lit(True))


def _shown(text: str, field: str | None) -> tuple[str, ...]:
    text = text.lower().strip("*?")
    return (text,) if text and field != "source" and not set("*?") & set(text) else ()


def _needed(text: str, field: str | None) -> tuple[frozenset[str], ...]:
    """Words of the text, each of which a file's texts must have, or the text itself as a source."""
    field = field and field.lower()
    if field == "source":
        return () if is_glob(text) else (frozenset([text.lower()]),)
    if field not in (None, "message", "raw"):
        return ()
    whole = [text.lower()] if field is None else []
    return tuple(frozenset([w, *whole]) for w in dict.fromkeys(tokenize(text))) or (frozenset(whole),) * len(whole)


def word(text: str, field: str | None = None) -> Filter:
    """A word, number or pattern (`*`, `?`) anywhere in an event, or in one field."""
    needs = () if is_glob(text) else _needed(text, field)
    return Filter(lambda v: search.term(v, text, field), highlights=_shown(text, field), needs=needs)


def phrase(text: str, field: str | None = None) -> Filter:
    """Words one after another; `*` and `?` mean themselves."""
    needs = () if is_glob(text) and field is None else _needed(text, field)  # in quotes, a source may still be a pattern
    return Filter(lambda v: search.term(v, text, field, quoted=True), highlights=_shown(text, field), needs=needs)


def compare(field: str, op: str, bound: float | str) -> Filter:
    """field >, >=, < or <= a number."""
    return Filter(lambda v: search.compare(v, field, op, str(bound)))


def index(pattern: str) -> Filter:
    """Chooses partitions by the name of their index; as a predicate it is true."""
    return Filter(lambda v: F.lit(True), indexes=(pattern,))


def _scoped(view: View, what: Filter, scope: dict) -> tuple[View, Callable[[View], View]]:
    """The view, of a store without the files that can't have hits, and the search in it."""
    patterns = what.indexes or ((scope["index"],) if scope["index"] else ())
    start_ms, end_ms = scope["start_ms"], scope["end_ms"]
    planned = search.partitions_in_scope(scope["env"], patterns, start_ms, end_ms, scope["allowed"], scope["explicit"])
    if isinstance(view, StoredView):
        view = view.narrowed(planned, start_ms, end_ms, what.needs)
    return view, lambda v: v.where(planned & search.in_window(v, start_ms, end_ms)).where(what.predicate(v))


def find(
    view: View,
    what: Filter | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    env: str | None = None,
    index: str | None = None,
    allowed: Iterable[tuple[str, str]] | None = None,
    explicit: Iterable[tuple[str, str, str]] | None = None,
) -> View:
    """The rows a search may see and fits: partition predicates (which prune), the time window (which skips row groups)
    and the filter. index: a pattern that holds where the filter has none of its own."""
    scope = {"start_ms": start_ms, "end_ms": end_ms, "env": env, "index": index, "allowed": allowed, "explicit": explicit}
    view, run = _scoped(view, what or everything(), scope)
    return run(view)


def newest_page(
    view: StoredView,
    what: Filter | None = None,
    limit: int = 50,
    offset: int = 0,
    start_ms: int | None = None,
    end_ms: int | None = None,
    env: str | None = None,
    index: str | None = None,
    allowed: Iterable[tuple[str, str]] | None = None,
    explicit: Iterable[tuple[str, str, str]] | None = None,
) -> tuple[DataFrame, int]:
    """search.page() of what find() gives, and how many files were opened for it: from the newest on, until no other file
    can have a hit of the page."""
    scope = {"start_ms": start_ms, "end_ms": end_ms, "env": env, "index": index, "allowed": allowed, "explicit": explicit}
    view, run = _scoped(view, what or everything(), scope)
    found, opened = newest(view, run, limit, offset)
    return search.page(found, limit, offset), opened


def register(view: View, name: str) -> None:
    """The view as a table of Spark SQL: core columns and, under their own names, its typed fields."""
    view.fields.plain(view.df).createOrReplaceTempView(name)
