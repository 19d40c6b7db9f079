import random
import zlib
from functools import reduce
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm import merkle_manifest as manifest
from larkspur.llm import queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    """The root of nodes, and for each one its siblings on every level: (those to the left, those to the right)."""
    steps, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for m in members[a + k]:
                    steps[m].append((run[:k], run[k + 1 :]))
            above.append(h("".join(run)))
            under.append(sum(members[a : a + 8], []))
        nodes, members = above, under
    return nodes[0], steps


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    sub = {n: grown([t[2] for t in sorted(trees[n], key=lambda t: t[:3])]) for n in names}
    root, top = grown([sub[n][0] for n in names]) if names else (None, [])
    out = []
    for n, above in zip(names, top):
        for t, steps in zip(sorted(trees[n], key=lambda t: t[:3]), sub[n][1]):
            r, digest = t[3], t[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                digest = leaf((*r[:4], r[4] and r[4].translate(LOWER)))
            for left, right in steps + above:
                digest = h("".join(left) + digest + "".join(right))
            proof = h("".join(x for left, right in steps + above for x in left + right))
            out.append((r[0], t[2], sub[n][0], root, proof, digest, digest == root))
    return out


def proven(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "t", 5, "d") for r in rows], DOCS)
    return sorted(map(tuple, manifest.manifest(df, **sizes).collect()), key=str)


def some_rows(n, seed=1):
    r = random.Random(seed)
    rows = [(r.choice([i, i % 7]), r.choice(["s", None, ""]), r.choice(["en", "de", "én", None, ""]), i % 3, f"Text {i % 11} É") for i in range(n)]
    return rows + [(None, None, "en", None, None), (None, None, "en", None, None), (-5, "-", "en", 0, ""), ((1 << 62) + 1, "A", None, 9, "B" * 2_000_000)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "fan": 2}, {"chunk": 64, "fan": 3}, {"chunk": 1}])
def test_proofs_are_those_of_the_plain_tree(spark, sizes):
    rows = some_rows(150)
    assert proven(spark, rows, **sizes) == sorted(plain(rows), key=str)


def test_one_row_equal_rows_and_none(spark):
    assert proven(spark, []) == []
    for rows in ([(3, "s", "en", 1, "A b")], [(1, "s", None, 1, "x")] * 20, [(i, None, str(i), 0, None) for i in range(30)]):
        assert proven(spark, rows, chunk=4, fan=2) == sorted(plain(rows), key=str)
    lone = proven(spark, [(3, "s", "en", 1, "A b")])[0]
    assert lone[1] == lone[2] == lone[3] and lone[4] == h("")


@given(st.integers(1, 600), st.randoms(use_true_random=False))
def test_merging_in_any_order_gives_the_root(n, random):
    leaves, totals = [h(str(i)) for i in range(n)], {"t": n}
    forests = [{("t", 0, i): d} for i, d in enumerate(leaves)]
    while len(forests) > 1:
        a = forests.pop(random.randrange(len(forests)))
        b = forests.pop(random.randrange(len(forests)))
        assert manifest.merge(a, b, totals) == manifest.merge(b, a, totals)
        forests.append(manifest.merge(a, b, totals))
    assert list(forests[0].values()) == [grown(leaves)[0]] and manifest.merge(forests[0], {}, totals) == forests[0]


@given(st.lists(st.integers(0, 400), min_size=2, max_size=2).map(sorted))
def test_merging_is_associative_and_neighbours_stay_small(cuts):
    totals, every = {"t": 400}, {("t", 0, i): h(str(i)) for i in range(400)}
    a, b, c = ({k: d for k, d in every.items() if x <= k[2] < y} for x, y in zip([0, *cuts], [*cuts, 400]))
    merge = lambda x, y: manifest.merge(x, y, totals)
    assert merge(merge(a, b), c) == merge(a, merge(b, c)) == reduce(merge, (c, a, b))
    assert len(merge(b, {})) <= 2 * 7 * 3


def test_the_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = duckdb.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op11_merkle_manifest']})").fetchall()
    found = queries.op11_merkle_manifest(spark, sf)
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(want)
