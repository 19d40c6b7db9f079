"""Document fingerprints: Merkle trees over sections, paragraphs and passages.

Lines are paragraphs; a section ends after a blank line or a paragraph whose hash says so. A paragraph's leaves are
its sentences; one of more than LONG characters is cut between words, where the letters beside the blank say so. These
borders depend on the text beside them, so an edit moves no border but its own; only passages of more than MOST
characters without one are cut by length. Every node is the hash of its children. A fingerprint is root, size, `:`,
sections: the root tests equality; each section (`;`) is its hash, `=` and its paragraphs, each paragraph (`,`) its
hash, `/` and its leaves, each leaf (`.`) its hash and length. Hashes below the root have 8 hex digits; an only child
stands for its parent. `likeness` and `differing` go down two such trees and stop at equal branches, without the texts.

Null texts count as empty, and all empty texts have one fingerprint. Equal texts have equal fingerprints.
Rows with equal doc_id are ordered by their texts' hashes; null doc_ids come last in descending order. One
document alone is its own next document. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import partitions, plain, worker_for

LONG = 48
MOST = 256
SAMPLE = 50_000  # rows of two numbers that the borders between ranges of documents are taken from
_SENTENCE = re.compile(r"(?<=[.!?|]) ")
_PASSAGE = re.compile(r"(?<=[aeiou0-9]) (?=[b-dl-psw])")  # between one in ten words or so
_LEAST = -(1 << 63)
FIELDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "n_changed": pa.int32(),
}
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_changed int"
)


def _leaves(paragraph: str) -> list[str]:
    out = []
    for s in _SENTENCE.split(paragraph):
        if len(s) <= LONG:
            out.append(s)
            continue
        for x in _PASSAGE.split(s):
            out += [x[i : i + MOST] for i in range(0, len(x), MOST)] if len(x) > MOST else [x]
    return out


def _node(hashes: list[bytes], kind: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(hashes) + kind)


def _shown(node: bytes, children: list[str], mark: str, sep: str) -> str:
    return node[:4].hex() + mark + sep.join(children) if len(children) > 1 else children[0]


def fingerprint(text: str) -> str:
    digest = xxhash.xxh3_128_digest
    sections, section, nodes, shown, size = [], [], [], [], 0

    def close():
        nodes.append(_node(section, b"s"))
        sections.append(_shown(nodes[-1], shown, "=", ","))

    for paragraph in text.split("\n"):
        leaves = _leaves(paragraph)
        hashes = [digest(x.encode("utf-8", "surrogatepass")) for x in leaves]
        node = _node(hashes, b"p%d" % len(hashes))
        section.append(node)
        size += sum(map(len, leaves)) + len(leaves)
        shown.append(_shown(node, [h[:4].hex() + f"{len(x):x}" for h, x in zip(hashes, leaves)], "/", "."))
        if not paragraph or node[0] < 32:
            close()
            section, shown = [], []
    if section:
        close()
    return f"{_node(nodes, b'r').hex()}{size:x}:{';'.join(sections)}"


def _sections(f: str) -> list[str]:
    return f.partition(":")[2].split(";")


def _paragraphs(section: str) -> list[str]:
    return section.partition("=")[2].split(",") if "=" in section else [section]


def _passages(paragraph: str) -> list[str]:
    return paragraph.partition("/")[2].split(".") if "/" in paragraph else [paragraph]


def _size(leaf: str) -> int:
    """Characters of a leaf, and one for the border after it."""
    return int(leaf[8:], 16) + 1


def _unequal(x: list[str], y: list[str], below) -> tuple[list[str], list[str]]:
    """The children of those branches that the other side lacks."""
    a, b = Counter(x), Counter(y)
    return [c for n in (a - b).elements() for c in below(n)], [c for n in (b - a).elements() for c in below(n)]


def likeness(a: str, b: str) -> float:
    """Share of the two texts' characters that lie in equal branches: 1 for equal roots, 0 without a common leaf."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _unequal(_sections(a), _sections(b), _paragraphs)
    x, y = _unequal(x, y, _passages)
    x, y = _unequal(x, y, lambda leaf: [leaf])
    total = sum(int(f[32 : f.index(":")], 16) for f in (a, b))
    return 1 - (sum(map(_size, x)) + sum(map(_size, y))) / total


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a's paragraphs that b lacks; equal sections are passed over."""
    if a[:32] == b[:32]:
        return []
    x, y = _sections(a), _sections(b)
    _, there = _unequal(x, y, _paragraphs)
    equal, left, out = Counter(y), Counter(there), []
    for i, section in enumerate(x):
        if equal[section] > 0:
            equal[section] -= 1
            continue
        for j, p in enumerate(_paragraphs(section)):
            if left[p] > 0:
                left[p] -= 1
            else:
                out.append((i, j))
    return out


def edited(text: str, following: str) -> str:
    """text with the last third of its characters replaced by the first as many (or all) of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""

    def run(batches):
        for b in batches:
            found = pa.array([fingerprint(x or "") for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["doc_id", "fingerprint"])

    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _in_ranges(rows: DataFrame, n: int) -> DataFrame:
    """Adds `bucket`: n ranges of (down, tie) or so, in ascending order, about equally full; equal rows stay together."""
    sample = rows.select("down", "tie")
    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = sorted(tuple(r) for r in (sample.sample(share, seed=1) if share < 1 else sample).collect())
    cuts = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []
    downs, ties = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def bucket(down: pd.Series, tie: pd.Series) -> pd.Series:
        d, t = down.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(downs, d, side="left"), np.searchsorted(downs, d, side="right")
        for i in np.flatnonzero(low < high):
            low[i] += np.searchsorted(ties[low[i] : high[i]], t[i], side="right")
        return pd.Series(low).astype("int32")

    return rows.withColumn("bucket", bucket("down", "tie"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, in descending doc_id.

    n_changed: the number of its paragraphs that the edited text lacks.
    """
    spark = docs.sparkSession
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    down = F.bitwise_not(F.coalesce("doc_id", F.lit(_LEAST)))  # ascends where doc_id descends
    n = partitions(spark)
    rows = _in_ranges(rows.withColumn("down", down).withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0))), 4 * n)
    # a bucket's last document needs the first of the next bucket: one document a bucket is copied there
    tops = rows.groupBy("bucket").agg(F.min(F.struct("down", "tie")).alias("top")).orderBy("bucket").collect()
    to = [(*r["top"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)]  # the first goes to the last bucket
    heads = rows.drop("bucket").join(F.broadcast(spark.createDataFrame(to, "down long, tie long, bucket int")), ["down", "tie"])
    first = Window.partitionBy("bucket").orderBy("down")
    heads = heads.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").withColumn("head", F.lit(1))
    dealt = rows.withColumn("head", F.lit(0)).unionByName(heads).select("bucket", "head", "down", "tie", "doc_id", "text")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "head", "down", "tie")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FIELDS.values())], names=list(FIELDS))

    def run(batches):
        worker_for("merkle")
        previous, out = None, []  # previous: bucket, doc_id, text, fingerprint
        for b in batches:
            for bucket_no, head, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5))):
                text = text or ""
                own = fingerprint(text)
                if previous and previous[0] == bucket_no:
                    _, before, was, f = previous
                    changed = edited(was, text)
                    fp = fingerprint(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(was), sha, f, fp, likeness(f, fp), likeness(f, own), len(differing(f, fp))))
                previous = None if head else (bucket_no, doc_id, text, own)
                if len(out) >= 256:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, SCHEMA)
