from collections import defaultdict

import numpy as np

from larkspur.llm import near_dedup
from larkspur.llm.components import components
from plain_versions import near_groups as brute


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    s = near_dedup.superminhash([a, b, a[:1], a[::-1].copy()])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08 and (s[0] == s[3]).all()
    # stopping early doesn't change a signature: every slot is the least of all offers
    assert (s[0] == np.minimum(near_dedup.superminhash([a[:500]])[0], near_dedup.superminhash([a[500:]])[0])).all()


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r) for r in near_dedup.near_groups(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_chain_copies_and_odd_rows(spark):
    """A chain whose ends differ, copies, short texts, case, nulls, repeated rows, clashing columns."""
    words = [f"w{i}" for i in range(400)]
    chain = [(10 + k, " ".join(words[k * 8 : k * 8 + 100])) for k in range(12)]
    rows = chain + [(90, "Hello"), (91, "hello\t"), (92, "hello you"), (93, None), (94, " \n"), (95, chain[3][1].upper()), (95, chain[3][1].upper())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rep long, bucket string")
    got = near_dedup.near_groups(df).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert {by_id[i] for i, _ in chain} == {10} and by_id[91] == 90 and by_id[93] == 93
    none = spark.createDataFrame([(None, chain[0][1]), (1, chain[0][1])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(none).collect()} == {(None, None, True), (1, 1, True)}
    assert near_dedup.near_groups(df.limit(0)).collect() == []


def test_group_of_edited_copies(spark, monkeypatch):
    """Copies of one text with few to many edits: some link with the first, some only with each other, some with none."""
    monkeypatch.setattr(near_dedup, "SPLIT", 7)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(2, 240):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 14), replace=False):
            words[at] = f"x{i}n{at}"
        rows.append((i, " ".join(words)))
        if i % 9 == 0:  # an edited copy of the edited copy
            words[int(rng.integers(150))] = f"y{i}"
            rows.append((1000 + i, " ".join(words)))
    got = {tuple(r) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    sizes = defaultdict(int)
    for _, _, component, _ in got:
        sizes[component] += 1
    assert sizes[1] > 20 and sum(n == 2 for c, n in sizes.items()) > 3 and sum(n == 1 for n in sizes.values()) > 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (45, 50), (7, 7), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(21)} | {(40, 40), (45, 40), (50, 40)}


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, "other " + long[1_000_000:]), (4, "x" * 3_000_000), (5, "x" * 3_000_000 + " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (399_996, 1) and got[2] == (400_001, 1) and got[3][1] == 3 and got[4] == (1, 4) and got[5] == (1, 4)
