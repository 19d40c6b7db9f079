"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of lower-cased words with one
blank on either side), most frequent first. A document's own most frequent n-grams are compared to each profile
by the out-of-place distance: the sum of the differences in rank, with a profile's length for n-grams it lacks.
The nearest profile wins; ties go to the language that sorts first.

n-grams are packed into 64-bit integers, so counting is sorting; counts of the training text are summed per
partition before the shuffle and only the profiles (languages x PROFILE rows) reach the driver.

Texts that are null or hold no letter get `und` and score 0, as does every text if nothing could be learned.
Documents without a lang or a doc_id teach nothing. Rows are judged one by one, so repeated rows get equal
results. Further columns of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import plain, worker_for

PROFILE = 400
HELD_OUT = 2
KEEP_KEYS = 1_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x110000)).astype(bool)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the texts, in no order, and the number of the text each comes from."""
    codes = np.frombuffer("\0".join(texts).lower().replace("\0", "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    sizes = [len(x.lower()) + 1 for x in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(codes)]
    c = np.where(_letters()[codes], codes.astype(np.uint64) + np.uint64(1), np.uint64(1))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1)  # one blank between words
    c, owner = c[keep], owner[keep]
    one = np.uint64(1)
    blank = np.array([1], np.uint64)
    c, owner = np.concatenate([blank, c, blank]), np.concatenate([owner[:1], owner, owner[-1:]])
    mid = c[1:-1] != one
    tri = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    bi = (c[:-1] << np.uint64(21)) | c[1:]
    word = (c[:-1] != one) | (c[1:] != one)
    uni = c != one
    of_bi = np.where(c[:-1] != one, owner[:-1], owner[1:])
    return np.concatenate([tri[mid], bi[word], c[uni]]), np.concatenate([owner[1:-1][mid], of_bi[word], owner[uni]])


def _slices(batches, column: int, chars: int = 1_000_000):
    """(first row, rows, texts) of bounded size; one text longer than that is a slice by itself."""
    for batch in batches:
        texts = [x or "" for x in batch.column(column).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([a[1], b[1]])).astype(np.int64)


def learn(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """lang, gram, rank: the profiles of the languages of docs (text, lang)."""

    def count(batches):
        worker_for("language_id")
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (keys, n) in sums.items():
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000]
                    columns = [pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[i : i + 100_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            sums.clear()

        for rows, texts in _slices(batches, 0):
            langs = rows.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _ = ngrams([t for t, x in zip(texts, langs) if x == lang])
                new = tuple(np.unique(grams, return_counts=True))
                sums[lang] = _merged(sums[lang], new) if lang in sums else new
            if sum(len(k) for k, _ in sums.values()) > KEEP_KEYS:
                yield from flush()
        yield from flush()

    known = plain(docs, "text", "lang").filter("lang is not null and text is not null")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= profile)  # so Spark sees the limit
    return best.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def judgement(profiles: list[tuple[str, np.ndarray]], profile: int = PROFILE):
    """A function of columns of texts that yields their languages, and with scores=True languages and scores."""
    names = [x for x, _ in profiles]
    grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for _, g in profiles)]).view(np.uint64))
    places = np.full((len(names), len(grams) + 1), -1, np.int32)  # the last column: in no profile
    for i, (_, g) in enumerate(profiles):
        places[i, np.searchsorted(grams, g.view(np.uint64))] = np.arange(len(g))

    def one(keys: np.ndarray) -> tuple[str, float]:
        own, n = np.unique(keys, return_counts=True)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        if len(own) > profile:  # only those that can be among the most frequent are ordered
            least = np.partition(n, len(n) - profile)[len(n) - profile]
            own, n = own[n >= least], n[n >= least]
        own = own[np.argsort(-n, kind="stable")[:profile]]
        at = np.searchsorted(grams, own)
        at[at == len(grams)] = 0
        at[grams[at] != own] = len(grams)
        place = places[:, at]
        away = np.where(place < 0, profile, np.abs(place - np.arange(len(own), dtype=np.int32))).sum(axis=1)
        best = int(np.argmin(away))
        return names[best], max(0.0, 1.0 - float(away[best]) / (profile * len(own)))

    def judge(columns, scores: bool = False):
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            for _, texts in _slices([batch], 0, 500_000):
                keys, owner = ngrams(texts)
                keys = keys[np.argsort(owner, kind="stable")]
                bounds = np.searchsorted(np.sort(owner), np.arange(len(texts) + 1))
                found = [one(keys[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
                yield found if scores else [x for x, _ in found]

    return judge


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]], profile: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score. profiles: (lang, its n-grams in rank order), at most `profile` each."""
    judge = judgement(profiles, profile)

    def run(batches):
        worker_for("language_id")
        for b in batches:
            found = [x for part in judge([b.column(2)], True) for x in part]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), langs, scores], names=["doc_id", "held_out", "lang_pred", "score"])

    return plain(docs, "doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def _learned(docs: DataFrame, profile: int) -> list[tuple[str, np.ndarray]]:
    rows = learn(docs, profile).orderBy("lang", "rank").collect()  # languages x profile rows
    names = sorted({r["lang"] for r in rows})
    return [(lang, np.array([r["gram"] for r in rows if r["lang"] == lang], np.int64)) for lang in names]


def identify(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Learn from the documents that are not held out (crc32 of doc_id modulo 4) and predict all."""
    share = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    marked = plain(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "text", "lang", share.alias("share"))
    profiles = _learned(marked.filter(F.col("share") != HELD_OUT), profile)
    return predict(marked.withColumn("held_out", F.coalesce(F.col("share") == HELD_OUT, F.lit(False))), profiles, profile)


def identified(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """The documents, with all their columns, whose language can be told; those that predict() calls `und` go."""
    share = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    judge = judgement(_learned(docs.filter(share != HELD_OUT), profile), profile)
    text = docs.columns.index("text")

    def keep(batches):
        worker_for("language_id")
        for b in batches:
            known = [x != UNKNOWN for part in judge([b.column(text)]) for x in part]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
