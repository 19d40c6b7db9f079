"""Token counts of documents without their ids: pieces are counted once per distinct pre-token.

A pre-token is what the tokenizer's own normaliser and pre-tokenizer cut a text into; the model sees one at a time, so a
document's count is the sum of its pre-tokens' pieces. `frequencies` gives each document's pre-tokens with how often it
has them, `pieces` runs the model once for each distinct one, and `count_tokens` joins the two and sums. Special strings
inside a text are tokens of their own, as the library has it by default, and what stands beside them is cut apart there.

A pre-token's key is the pre-token, or its sha256 if it is longer than KEY characters, so that no join carries long ones.
The keys that most documents have are broadcast, at most HEAD short rows whatever the corpus; the others meet the
documents by key, and none of those can be in much more than a HEAD-th of all the frequency rows. Documents meet again by the
number that their row got when the frequencies were written, so repeated rows and repeated or missing doc_ids stay rows
of their own.

Null and empty texts have 0 tokens. An empty table gives no rows. Further columns are not read. A text is cut up within
one task's memory, by slices between blanks; a text without blanks is one slice.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.encoding import encoder, shown
from larkspur.llm.shared import clears, materialize, plain, worker_for

LIMIT = 2048
HEAD = 200_000
KEY = 48
ROWS = 128
CACHE_UNITS = 200_000
SLICE_CHARS = 1_000_000
FREQUENCIES = "doc_id long, n_bytes long, n_special long, tokens array<string>, times array<long>"
_BORDER = re.compile(r" (?=\S)")
_units: dict[str, dict[str, tuple[str, ...]]] = {}
clears(_units.clear)


def _slices(text: str):
    """Parts of a long text, cut before a blank that a visible character follows."""
    at = 0
    while len(text) - at > SLICE_CHARS and (border := _BORDER.search(text, at + SLICE_CHARS)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def pre_tokens(path: str, text: str) -> tuple[Counter, int]:
    """How often a text has each pre-token, and how many special tokens' texts."""
    enc, known = encoder(path), _units.setdefault(path, {})
    if len(known) > CACHE_UNITS:
        known.clear()
    parts = enc.cut.split(text)  # text, special token, text, ...
    seen, out = Counter(), Counter()  # of units, of pre-tokens
    for part in parts[::2]:
        for piece in _slices(part):
            if enc.words:
                words, odd = enc.plain_words(piece)
                out.update(words)
                seen.update(odd)
            else:
                first, *rest = enc.units(piece)
                seen[first] += 1
                seen.update([enc.lead + u for u in rest] if enc.lead else rest)
    if not text.isascii():
        for word in [w for w in out if not w.isascii()]:
            out[shown(word)] = out.pop(word)
    for unit, times in seen.items():
        found = known.get(unit)
        if found is None:
            found = known[unit] = enc.pre_tokens(unit)
        for t in found:
            out[t] += times
    return out, len(parts) // 2


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_special, and the distinct pre-tokens of each document with how often it has them."""

    def cut(batches):
        worker_for("token counts")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                n_bytes, n_special, tokens, times, ends = [], [], [], [], [0]
                for text in rows.column(1).to_pylist():
                    found, special = pre_tokens(path, text or "")
                    n_bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
                    n_special.append(special)
                    tokens += found
                    times += found.values()
                    ends.append(len(tokens))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((tokens, pa.string()), (times, pa.int64()))]
                counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_special)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, *lists], names=["doc_id", "n_bytes", "n_special", "tokens", "times"])

    return plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, FREQUENCIES)


def pieces(tokens: DataFrame, path: str) -> DataFrame:
    """key, rows, pieces: the model's count for each row of (key, token, rows)."""

    def count(batches):
        worker_for("token counts")
        model = encoder(path).model
        for b in batches:
            n = pa.array([len(model.tokenize(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["key", "rows", "pieces"])

    return tokens.select("key", "token", "rows").mapInArrow(count, "key string, rows long, pieces long")


def _key(token: Column) -> Column:
    return F.when(F.length(token) > KEY, F.sha2(token, 256)).otherwise(token)


def _octave(rows: Column) -> Column:
    """A coarse number of a frequency: eight for each doubling."""
    return F.floor(F.log2(rows) * 8).cast("int")


def _cut(counted: DataFrame, head: int) -> int:
    """The coarse frequency from which on there are at most `head` keys; found from the counts of some hundred, unsorted."""
    counts = counted.groupBy(_octave(F.col("rows")).alias("octave")).agg(F.count("*").alias("n")).collect()
    cut, taken = 1 << 20, 0
    for r in sorted(counts, key=lambda r: -r["octave"]):
        taken += r["n"]
        if taken > head:
            break
        cut = r["octave"]
    return cut


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    numbered = frequencies(docs, path).withColumn("row", F.monotonically_increasing_id())
    table = materialize(numbered, "frequencies")
    token = table.select(F.explode("tokens").alias("token"))
    distinct = token.groupBy("token").agg(F.count("*").alias("rows")).withColumn("key", _key(F.col("token")))
    counted = materialize(pieces(distinct, path), "pieces")
    frequent = counted.filter(_octave(F.col("rows")) >= _cut(counted, head))
    each = table.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x"))
    each = each.select("row", _key(F.col("x.tokens")).alias("key"), F.col("x.times").alias("times"))
    few = F.broadcast(materialize(frequent.select("key", "pieces"), "frequent"))  # at most `head` rows of a short key and a number
    common = each.join(few, "key")
    rare = each.join(few.select("key"), "key", "left_anti")
    rare = rare.join(counted.join(few.select("key"), "key", "left_anti").select("key", "pieces").hint("merge"), "key")
    none = F.lit(None).cast("long")
    parts = [table.select("row", "doc_id", "n_bytes", F.col("n_special").alias("n"))]
    for found in (common, rare):
        sums = found.groupBy("row").agg(F.sum(F.col("pieces") * F.col("times")).alias("n"))
        parts.append(sums.select("row", none.alias("doc_id"), none.alias("n_bytes"), "n"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("row")
    total = every.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
