"""Benchmark decontamination by SimHash windows, in DataFrame functions alone.

Texts become lists of hashes of their five-word shingles (lower-cased words between blanks; fewer than five
words: one shingle of all). A window is as many shingles of a document as a benchmark item has. Windows are laid
so that each ends at a shingle that an item of that size has: a window that ends at another one, moved back by a
shingle, is at least as alike, so the first of the most alike windows is among these, in whatever order the
document holds the item's parts. Those with too few such shingles to reach the similarity are left out, which
loses none. Each window and item gets a 64-bit SimHash, every shingle voting with its number of occurrences.
Fingerprints are cut into BLOCKS blocks: two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS
bits of some block, so items are listed under all values that near to each of their blocks, and the join on (size,
block, bits) finds every window within the radius. As a fifth of all random fingerprints would meet there too, a window
looks up only those items that have one of their rarest shingles in the same document: of an item of n shingles, bags
that are alike enough share at least SIMILARITY * n, so they share one of the n - SIMILARITY * n + 1 rarest, and the gate
loses none of them. What is within the radius is verified by the exact similarity of the two bags of shingles: the sum of
the smaller counts over the sum of the larger. Bags of similarity 0.75 differ in 11 bits on average, with a deviation
of 3, so a radius of 19 finds 99.7 % of those at the threshold and more of all others (tests measure it).

A document's matches are told apart by doc_id and text, so repeated rows give one match each item. Rows of one item_id
with different texts are all looked for, and the most alike one counts; equal rows are one. Null or
blank texts and items match nothing; items without item_id are ignored; further columns are not read. A
document that is shorter than an item is one window. Only the benchmark's shingles and index are broadcast, and only
up to BROADCAST_ROWS of each; beyond that they are joined as any table.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize, plain

WIDTH = 5
SIMILARITY = 0.75
RADIUS = 19
BLOCKS = 5
BROADCAST_ROWS = 1_000_000
ITEM = ["item_id", "item_hash"]


def words(text: Column) -> Column:
    """Hashes of the text's words in order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _joined(words: Column) -> Column:
    n = F.size(words)
    shingle = lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WIDTH)))
    many = F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), shingle)
    return F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(words)))


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds `s`, the shingles of column text, and drops text."""
    return df.withColumn("words", words(F.col("text"))).withColumn("s", _joined(F.col("words"))).drop("text", "words")


def simhash(shingles: Column) -> Column:
    """64 bits: each is the majority's among the shingles' hashes, 0 at a tie."""
    one = F.lit(1).cast("long")

    def votes(i: Column) -> Column:
        vote = lambda h: F.call_function("shiftrightunsigned", h, i).bitwiseAND(one).cast("int") * 2 - 1
        return F.aggregate(shingles, F.lit(0), lambda sum_, h: sum_ + vote(h))

    set_ = lambda f, i: F.when(votes(i) > 0, f.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(f)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), set_)


def blocks(fingerprint: Column, near: int = 0, n: int = BLOCKS) -> Column:
    """(block, bits) of the n parts of the 64 bits, and all values that differ from a part in at most `near` bits."""

    def block(i: int) -> Column:
        width, at = 64 // n + (i < 64 % n), 64 // n * i + min(i, 64 % n)
        part = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        every = F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long"))
        changes = F.filter(every, lambda m: F.bit_count(m) <= near) if near else F.array(F.lit(0).cast("long"))
        return F.transform(changes, lambda m: F.struct(F.lit(i).alias("block"), part.bitwiseXOR(m).alias("bits")))

    return F.concat(*(block(i) for i in range(n)))


def values(near: int, n: int = BLOCKS) -> int:
    """How many (block, bits) blocks() gives."""
    return sum(comb(64 // n + (i < 64 % n), k) for i in range(n) for k in range(near + 1))


def indexed_items(benchmark: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(item_id, item_hash, s, n) of the items, and the gate: (h, n, item_id, item_hash), each under its rarest shingles."""
    named = plain(benchmark, "item_id", "text").filter("item_id is not null and text is not null")
    items = with_shingles(named.dropDuplicates().withColumn("item_hash", F.xxhash64("text")))
    items = items.withColumn("n", F.size("s"))
    each = items.select(*ITEM, "n", F.explode("s").alias("h"))
    rarest = F.array_sort(F.collect_list(F.struct("times", "h")))
    ordered = each.join(each.groupBy("h").agg(F.count("*").alias("times")), "h").groupBy(*ITEM, "n").agg(rarest.alias("o"))
    enough = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    gates = ordered.select("n", *ITEM, F.explode(F.array_distinct(F.slice("o.h", F.lit(1), enough))).alias("h"))
    return items, gates


def candidates(windows: DataFrame, items: DataFrame, gated: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """Windows and items that meet in the index: the window's key, item_id, item_hash and both fingerprints, f and item_f.

    gated: (doc_id, text_hash, n, item_id, item_hash), which items a document's windows of n shingles look up.
    """
    key = ["doc_id", "text_hash", "n", "start"]
    listed = items.select(*ITEM, "n", simhash(F.col("s")).alias("item_f"))
    indexed = listed.select(*ITEM, "n", "item_f", F.inline(blocks(F.col("item_f"), radius // n_blocks, n_blocks)))
    # Spark's estimate doesn't see how many rows an item becomes, so it isn't left to choose
    few = items.count() * values(radius // n_blocks, n_blocks) <= BROADCAST_ROWS
    indexed = F.broadcast(indexed) if few else indexed.hint("merge")
    hashed = windows.select(*key, simhash(F.col("w")).alias("f")).alias("a")
    pairs = gated.alias("g")
    same = (F.col("a.text_hash") == F.col("g.text_hash")) & (F.col("a.n") == F.col("g.n"))
    asked = hashed.join(pairs, same & F.col("a.doc_id").eqNullSafe(F.col("g.doc_id"))).select("a.*", *(f"g.{x}" for x in ITEM))
    return asked.select(*key, *ITEM, "f", F.inline(blocks(F.col("f"), n=n_blocks))).join(indexed, [*ITEM, "n", "block", "bits"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, n_blocks: int = BLOCKS
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, text_hash: each document's most alike window for each item it holds."""
    items, gates = indexed_items(benchmark, similarity)
    seeds = items.select("n", F.explode("s").alias("h")).distinct()
    if seeds.count() <= BROADCAST_ROWS:
        seeds, gates = F.broadcast(seeds), F.broadcast(gates)  # gates are some of the seeds' rows

    read = plain(docs, "doc_id", "text").filter("text is not null").withColumn("text_hash", F.xxhash64("text"))
    # outer: an inner explode would make Spark filter on `s` first, below the columns it is made of, and compute it anew
    exploded = with_shingles(read).select("doc_id", "text_hash", F.size("s").alias("size"), F.posexplode_outer("s").alias("pos", "h"))
    hits = materialize(exploded.join(seeds, "h"), "hits")  # what the documents share with the benchmark
    gated = hits.join(gates, ["h", "n"]).select("doc_id", "text_hash", "n", *ITEM).distinct()
    places = [F.sort_array(F.collect_set("pos")).alias("at"), F.first("size").alias("size")]
    shared = hits.groupBy("doc_id", "text_hash", "n").agg(*places)
    n, at = F.col("n"), F.col("at")
    least = F.greatest(F.lit(1), F.ceil((F.least(n, F.col("size")) + n) * (similarity / (1 + similarity)) - 1e-9).cast("int"))
    ends = F.filter(at, lambda pos, i: F.get(at, i - least + 1) > pos - n)
    starts = F.array_distinct(F.transform(ends, lambda pos: F.greatest(F.lit(0), pos - n + 1)))
    laid = shared.select("doc_id", "text_hash", "n", starts.alias("starts")).filter(F.size("starts") > 0)
    laid = laid.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n", "starts")).alias("laid"))
    laid = materialize(laid, "laid").select(F.col("doc_id").alias("laid_id"), F.col("text_hash").alias("laid_hash"), "laid")

    # doc_id may be null, which equals itself here
    held = read.join(laid, (F.col("text_hash") == F.col("laid_hash")) & F.col("doc_id").eqNullSafe(F.col("laid_id")))
    held = with_shingles(held.select("doc_id", "text_hash", "text", "laid").dropDuplicates(["doc_id", "text_hash"]))
    held = held.select("doc_id", "text_hash", "s", F.inline("laid"))
    held = held.select("doc_id", "text_hash", "s", "n", F.explode("starts").alias("start"))
    windows = held.select("doc_id", "text_hash", "n", "start", F.slice("s", F.col("start") + 1, F.col("n")).alias("w"))
    windows = materialize(windows, "windows")  # fingerprints and verification both need them

    key = ["doc_id", "text_hash", "n", "start"]
    met = candidates(windows, items, gated, radius, n_blocks)
    near = met.filter(F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))) <= radius).select(*key, *ITEM).distinct()

    window_bag = windows.select(*key, F.size("w").alias("nw"), F.explode("w").alias("h"))
    window_bag = window_bag.groupBy(*key, "nw", "h").agg(F.count("*").alias("cw"))
    item_bag = items.select(*ITEM, F.explode("s").alias("h")).groupBy(*ITEM, "h").agg(F.count("*").alias("ci"))
    a, b = near.alias("a"), window_bag.alias("b")
    same = F.col("a.text_hash") == F.col("b.text_hash")
    for k in ("n", "start"):
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    same &= F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    common = a.join(b, same).select("a.*", "b.nw", "b.h", "b.cw").join(item_bag, [*ITEM, "h"])
    common = common.groupBy(*key, *ITEM, "nw").agg(F.sum(F.least("cw", "ci")).alias("both"))
    alike = F.col("both") / (F.col("nw") + F.col("n") - F.col("both"))
    found = common.withColumn("similarity", alike).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"), "nw"))
    out = found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
    best = [(-F.col("best.first")).alias("start_word"), (F.col("best.nw") + WIDTH - 1).alias("n_words")]
    return out.select("doc_id", "item_id", *best, F.col("best.similarity").alias("similarity"), "text_hash")
