import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_packing(spark):
    odd = [(1000, None), (1001, "x " * 5000), (1001, "x"), (None, "no id"), (1002, "y <|endoftext|> z" + " w" * 300_000)]
    df = docs(spark).select("doc_id", "text").unionAll(spark.createDataFrame(odd, DOC))
    df = df.selectExpr("*", "1 as piece", "2 as length", "'s' as sequence_id", "0 as part")  # names of its own columns
    got = packing.pack(df, BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in df.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * sum(r["length"] for r in got) / 1024 + 1
    assert packing.pack(df.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_every_piece(seed):
    random.seed(seed)
    lengths = [min(1024, int(random.expovariate(1 / random.choice([20, 300, 900]))) + 1) for _ in range(4000)]
    histogram = Counter(lengths)
    rows, n = packing.plan(dict(histogram))
    covered, room = Counter(), Counter()
    for length, rank, count, sequence, _ in rows:
        for i in range(count):
            covered[length, rank + i] += 1
            room[sequence + i] += length
    assert all(v == 1 for v in covered.values()) and Counter(x for x, _ in covered) == histogram
    assert len(room) == n and max(room.values()) <= 1024 and n <= 1.01 * sum(lengths) / 1024 + 1


def test_full_and_few_lengths():
    assert packing.plan({1024: 7}) == ([(1024, 0, 7, 0, 0)], 7)
    assert packing.plan({}) == ([], 0)
    assert packing.plan({512: 10, 300: 4, 200: 4, 12: 4})[1] == 5 + 2
    assert packing.plan({700: 50, 324: 50})[1] == 50
