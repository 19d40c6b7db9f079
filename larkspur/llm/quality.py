"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text.

Each language's model is a character trigram model over all characters, with one more model of all trusted text for
other languages. An n-gram is a number of 21 bits a character. Counts, continuation counts, contexts and the
interpolated probabilities are Spark aggregations and joins by language and n-gram; none is collected. The
probabilities of all trigrams that documents hold are made the same way, and each document's trigrams, counted in
the document, are joined to them and summed by document. That table is broadcast only up to BROADCAST_ROWS of it.
Logarithms are whole numbers of 1 / SCALE, so sums don't depend on the order. A character no trusted text has
counts as one more symbol of its model.

Trusted text is all documents that are labelled good and not toxic. Everything else covers all documents: every
whole text is scored, and a language's threshold is the quantile of the perplexities of all its documents (to 0.1 %)
at the level 1 - CAUTION * b, where b is the share of bad labels among all labelled documents of the language (of
all, where it has none).

Null and empty texts have no perplexity and are not kept. Documents without a lang form a language of their own.
Labels that are repeated count once and as bad if any is; those of unknown documents don't count. Repeated rows
get equal results. Further columns are not read. Without trusted text every document has one perplexity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize, plain, release, worker_for

BROADCAST_ROWS = 1_000_000
SCALE = 1_000_000_000
CAUTION = 0.9
LEAST_DISCOUNT = 0.1  # small counts of counts could give 0, and unseen trigrams no probability
BITS = 21
EDGE = 0x110000  # beside the characters: the edges of a text, and what no text has
UNSEEN = EDGE + 1
LANGUAGES = 100_000  # one row a language is broadcast up to so many
ALL = ""
BINS = 1000  # bins of the logarithm of the perplexity: 0.1 % each


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts, each with two edges before and one after, and each text's number of them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    out = np.full(len(codes) + 3 * len(texts), EDGE, np.int64)
    out[np.arange(len(codes)) + 2 + 3 * np.repeat(np.arange(len(texts)), sizes)] = codes
    grams = (out[:-2] << 2 * BITS) | (out[1:-1] << BITS) | out[2:]
    keep = np.ones(len(grams), bool)
    ends = np.cumsum(sizes + 3)
    for k in (1, 2):  # trigrams that reach into the next text
        keep[ends[:-1] - k] = False
    return grams[keep], sizes + 1


def _last(g: str, n: int) -> Column:
    """The last n characters of an n-gram."""
    return F.col(g).bitwiseAND(F.lit((1 << BITS * n) - 1))


def _a_language(df: DataFrame) -> DataFrame:
    """A table of one row a language, broadcast where it is small."""
    return F.broadcast(df) if df.limit(LANGUAGES + 1).count() <= LANGUAGES else df


def _parts(batch, chars: int = 1_000_000):
    texts = batch.column("text").to_pylist()
    langs = batch.column("lang").to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield at, texts[at:end], langs[at:end]
        at = end


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 of each model, from its counts of n-grams that were seen once to four times."""
    n = counts.groupBy("lang").agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)))
    y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    n = n.withColumn("y", y)

    def discount(i: int) -> Column:
        d = F.lit(float(i)) - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}")
        return F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(LEAST_DISCOUNT), d)).otherwise(F.col("y") * i)

    return n.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))


def _interpolated(counts: DataFrame, lower: DataFrame | None, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, g, p) and (lang, ctx, gamma) of one order, from its counts (lang, g, c) and the next lower order's (lang, g, p)."""
    kind = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(_a_language(_discounts(counts)), "lang")
    rows = rows.select("lang", "g", "c", F.shiftright("g", BITS).alias("ctx"), kind.alias("d"))
    contexts = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
    rows = rows.join(contexts, ["lang", "ctx"])
    if lower is None:
        uniform = counts.groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("q"))  # one more: the unseen
        rows = rows.join(_a_language(uniform), "lang")
    else:
        lower = lower.select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
        rows = rows.withColumn("low", _last("g", order - 1)).join(lower, ["lang", "low"])
    p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")
    return rows.select("lang", "g", p.alias("p")), contexts.select("lang", "ctx", "gamma")


def kneser_ney(trigrams: DataFrame) -> list[tuple[int, DataFrame, DataFrame]]:
    """(order, probabilities of seen n-grams, weights of contexts) for orders 1 to 3, from (lang, g, c)."""
    pairs = trigrams.groupBy("lang", _last("g", 2).alias("g")).agg(F.count("*").alias("c"))
    singles = pairs.groupBy("lang", _last("g", 1).alias("g")).agg(F.count("*").alias("c"))
    out, lower = [], None
    for order, counts in ((1, singles), (2, pairs), (3, trigrams)):
        lower, contexts = _interpolated(counts, lower, order)
        lower, contexts = (materialize(x, f"{name}{order}") for name, x in (("seen", lower), ("contexts", contexts)))
        out.append((order, lower, contexts))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, g, c): every trigram of (lang, text, good) and how often the good texts have it."""

    def count(batches):
        worker_for("quality")
        for b in batches:
            good = np.array(b.column("good").to_pylist(), bool)
            for at, texts, langs in _parts(b):
                for lang in set(langs):
                    rows = [i for i, x in enumerate(langs) if x == lang and texts[i]]
                    if not rows:
                        continue
                    grams, sizes = _trigrams([texts[i] for i in rows])
                    learnt = np.repeat(good[[at + i for i in rows]], sizes)
                    for part, times in ((grams[learnt], 1), (grams[~learnt], 0)):
                        found, n = np.unique(part, return_counts=True)
                        columns = [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64) * times)]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "g", "c"])

    rows = docs.select("lang", "text", "good").mapInArrow(count, "lang string, g long, c long")
    return materialize(rows.groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")


def learn(grams: DataFrame) -> list[tuple[int, DataFrame, DataFrame]]:
    """The models of each language and of ALL, from gram_counts()."""
    seen = grams.filter("c > 0")
    whole = seen.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(ALL).alias("lang"), "g", "c")
    return kneser_ney(materialize(seen.filter(F.col("lang") != ALL).unionByName(whole), "trigrams"))


def log_probabilities(grams: DataFrame, models: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """Adds `lp`, SCALE times the logarithm of each trigram's probability, to (lang, g); languages without a model take ALL's."""
    single, whole = models[0][1], models[0][2]
    rest = single.groupBy("lang").agg(F.count("*").alias("v")).join(whole.select("lang", "gamma"), "lang")
    rest = materialize(rest.select(F.col("lang").alias("m"), (F.col("gamma") / (F.col("v") + 1)).alias("rest")), "rest")
    own = _a_language(rest.select(F.col("m").alias("lang"), F.col("m").alias("own")))
    rows = grams.join(own, "lang", "left").withColumn("m", F.coalesce("own", F.lit(ALL)))
    rows = rows.join(_a_language(rest), "m", "left").withColumn("p", F.coalesce("rest", F.lit(1.0 / UNSEEN)))
    for order, seen, contexts in models:
        rows = rows.withColumn("k", _last("g", order)).withColumn("ctx", F.shiftright("k", BITS))
        if order > 1:
            rows = rows.join(contexts.withColumnRenamed("lang", "m"), ["m", "ctx"], "left")
            rows = rows.withColumn("p", F.col("p") * F.coalesce("gamma", F.lit(1.0))).drop("gamma")
        rows = rows.join(seen.select(F.col("lang").alias("m"), F.col("g").alias("k"), F.col("p").alias("known")), ["m", "k"], "left")
        rows = rows.withColumn("p", F.coalesce("known", "p")).drop("known", "k", "ctx")
    return rows.withColumn("lp", F.round(F.log("p") * SCALE).cast("long")).drop("m", "own", "rest", "p")


def perplexities(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity of every document; table: (lang, g, lp)."""
    gram = pa.struct([("g", pa.int64()), ("n", pa.int32())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("grams", pa.list_(gram))])

    def count(batches):
        worker_for("quality")
        for b in batches:
            for at, texts, langs in _parts(b):
                found, n, ends = [], [], [0]
                filled = [x for x in texts if x]
                grams, sizes = _trigrams(filled) if filled else (np.empty(0, np.int64), np.empty(0, np.int64))
                cuts = iter(np.split(grams, np.cumsum(sizes)[:-1]) if filled else [])
                for x in texts:
                    if x:
                        one, times = np.unique(next(cuts), return_counts=True)
                        found.append(one)
                        n.append(times)
                    ends.append(ends[-1] + (len(found[-1]) if x else 0))
                counted = ((found, pa.int64()), ([y.astype(np.int32) for y in n], pa.int32()))
                flat = [pa.array(np.concatenate(x) if x else np.empty(0), t) for x, t in counted]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(gram)))
                own = [b.column(i).slice(at, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), lists], schema=schema)

    row = F.monotonically_increasing_id().alias("row")
    rows = plain(docs, "doc_id", "lang", "text").select(row, F.col("doc_id").cast("long"), "lang", "text")
    rows = rows.mapInArrow(count, "row long, doc_id long, lang string, grams array<struct<g:long,n:int>>")
    rows = rows.select("row", "doc_id", F.col("lang").alias("own"), F.coalesce("lang", F.lit(ALL)).alias("lang"), F.inline_outer("grams"))
    mean = (F.sum(F.col("lp") * F.col("n")) / F.sum("n") / SCALE).alias("mean")
    sums = rows.join(table, ["lang", "g"], "left").groupBy("row", "doc_id", "own").agg(mean)
    return sums.select("doc_id", F.col("own").alias("lang"), F.exp(-F.col("mean")).alias("perplexity"))


def labelled_good(known: DataFrame) -> DataFrame:
    """doc_id of every document that the models learn from; known: one (doc_id, quality, toxic) a document."""
    return known.filter("quality = 1 and toxic = 0").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame, caution: float = CAUTION) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every document; labels: (doc_id, quality, toxic)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = labelled_good(known).select("doc_id", F.lit(True).alias("good"))
    # labels grow with the corpus, so they are never broadcast; rows without doc_id have no label and are dealt by their text
    text = plain(docs, "doc_id", "lang", "text").filter("text is not null")
    text = text.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    text = text.join(good.withColumn("deal", F.lit(0).cast("long")).hint("shuffle_hash"), ["doc_id", "deal"], "left")
    text = text.select("text", F.coalesce("lang", F.lit(ALL)).alias("lang"), F.coalesce("good", F.lit(False)).alias("good"))
    grams = gram_counts(text)
    models = learn(grams)
    table = materialize(log_probabilities(grams.select("lang", "g"), models), "probabilities")
    release(grams, *(t for _, seen, contexts in models for t in (seen, contexts)))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)

    scored = materialize(perplexities(docs, table).withColumn("bin", F.floor(F.log("perplexity") * BINS)), "perplexities")
    bad = scored.select("doc_id", "lang").join(known, "doc_id").groupBy("lang")
    bad = materialize(bad.agg(F.sum(1 - F.col("quality")).alias("bad"), F.count("*").alias("n")), "labels")
    overall = bad.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0
    bins = scored.filter("bin is not null").groupBy("lang", "bin").count()
    up = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    share = bad.select(F.col("lang").alias("known_lang"), (F.col("bad") / F.col("n")).alias("share"))
    ranked = bins.withColumn("below", F.sum("count").over(up)).withColumn("all", F.sum("count").over(whole))
    ranked = ranked.join(_a_language(share), F.col("lang").eqNullSafe(F.col("known_lang")), "left")
    level = 1 - caution * F.coalesce("share", F.lit(overall))
    within = F.col("below") >= level * F.col("all") - 1e-9
    limit = ranked.filter(within).groupBy(F.col("lang").alias("limit_lang")).agg(F.min("bin").alias("limit"))
    limit = materialize(limit, "limits")
    out = scored.join(_a_language(limit), F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    threshold = F.exp((F.col("limit") + 1) / BINS).alias("threshold")
    kept = F.coalesce(F.col("bin") <= F.col("limit"), F.lit(False)).alias("kept")
    return out.select("doc_id", "lang", "perplexity", threshold, kept)
