import random

import numpy as np
import pytest

from larkspur.llm import suffix_dedup
from larkspur.llm.suffix_array import suffix_arrays
from plain_versions import without_repeats as brute

SCHEMA = "doc_id long, text string"


def test_suffix_arrays_are_sorted():
    random.seed(1)
    for _ in range(60):
        texts = [[random.randint(1, random.choice([1, 2, 3, 6])) for _ in range(random.randint(0, 60))] for _ in range(random.randint(1, 20))]
        symbols, starts = [], [0]
        for t in texts:
            symbols += [*t, 0]
            starts.append(len(symbols))
        got = suffix_arrays(np.array(symbols), np.array(starts))
        for a, b in zip(starts, starts[1:]):
            s = symbols[a:b]
            assert [x - a for x in got[a:b]] == sorted(range(b - a), key=lambda i: s[i:])


def compare(df, **options):
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, with_text=False, **options).collect()), key=order)
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], suffix_dedup.LENGTH)
    assert got == sorted((r[:5] for r in want), key=order)
    return got


def odd_rows():
    random.seed(5)
    base = "".join(random.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, "".join(base[(o := random.randrange(2800)) : o + random.randint(10, 200)] for _ in range(random.randint(0, 8)))) for i in range(150)]
    rows += [(500, "a" * 400), (501, "a" * 300 + "b" + "a" * 60), (502, None), (503, ""), (None, base[:100]), (504, "x" * 49)]
    return rows + [(504, base[50:120] + "é" * 40), (504, base[50:120]), (504, base[50:120]), (7, rows[3][1])]


@pytest.mark.parametrize("options", [{}, {"problem": 2, "block_bytes": 2000}])
def test_equals_brute_force(spark, options):
    """Nulls, empty texts, runs of one character, repeated ids and rows, ties; also with anchors dealt to several problems."""
    assert sum(r[2] for r in compare(spark.createDataFrame(odd_rows(), SCHEMA), **options)) > 10_000


def test_documents_table(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table_and_carried_columns(spark):
    assert compare(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(1, "z" * 60, 5, "n"), (2, "z" * 60 + "!", 6, "m")], SCHEMA + ", n_bytes long, block string")
    got = suffix_dedup.remove_repeats(df, carry=("n_bytes", "block")).orderBy("doc_id").collect()
    assert [(r["kept_text"], r["carried"]["n_bytes"], r["carried"]["block"]) for r in got] == [("z" * 60, 5, "n"), ("!", 6, "m")]


def test_long_document_is_read_whole(spark):
    random.seed(2)
    long = "".join(random.choice("abcdefghijklmnop") for _ in range(2 * suffix_dedup.PIECE + 1000))
    df = spark.createDataFrame([(1, long), (2, "<" + long[suffix_dedup.PIECE - 30 : suffix_dedup.PIECE + 70] + ">"), (3, long[-60:])], SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, with_text=False).collect()}
    assert got == {1: 0, 2: 100, 3: 60}


def test_rows_without_id_keep_what_others_without_id_have(spark):
    """In several blocks: equal and overlapping texts of rows whose ids are null or equal remove nothing from each other."""
    random.seed(6)
    base = "".join(random.choice("abcdefgh ") for _ in range(2000))
    rows = [(None, base[o : o + 150]) for o in (0, 0, 0, 100, 100, 40, 900, 900, 950)] + [(3, base[60:140]), (4, base[900:960] + base[0:70])]
    rows += [(9, base[1200:1400])] * 3 + [(9, base[1250:1450])] * 2 + [(8, base[1300:1360]), (10, base[1200:1400])]
    rows += [(100 + i, "".join(random.choice("xyz") for _ in range(200))) for i in range(40)]
    for options in ({"block_bytes": 300}, {"block_bytes": 300, "problem": 1}, {}):
        compare(spark.createDataFrame(rows, SCHEMA), **options)
