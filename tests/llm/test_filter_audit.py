import re
from itertools import permutations

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur.llm import filter_audit, queries

DOCS = "doc_id long, source string, text string, part string, n int, mask string"
LABELS = "doc_id long, quality int, toxic int, good string"


def plain(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} by going through the documents."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, source, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        rows.append((source or "", d in good, d in toxic, {f for f, x in fails.items() if x}))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                gone = [r for r in mine if r[3] & set(order[:i])]
                here = [r for r in mine if f in r[3] and not r[3] & set(order[:i])]
                only = sum(r[3] == {f} for r in mine)
                figures = (len(mine) - len(gone) - len(here), len(here), sum(f in r[3] for r in gone), only)
                out[part, order, i + 1] = (*figures, sum(r[1] for r in here), sum(r[2] for r in here))
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = spark.createDataFrame([(*r, "x", 3, "m") for r in docs], DOCS)
    found = filter_audit.audit(rows, spark.createDataFrame([(*r, "g") for r in labels], LABELS)).collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \t ", LONG, LONG + " #", LONG.upper(), "ab " * 50, "ab " * 49, "É" * 30 + " X", "a\x1cb\xa0c " * 50, "|", (LONG + " ") * 40_000]


def test_every_kind_of_document(spark):
    docs = [(i, f"s{i % 2}" if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    docs += [(None, "s1", LONG), (None, None, LONG), (3, "s1", LONG), (3, "s1", LONG), (99, "s1", LONG), (50, "", LONG), (99, "s0", None)]
    labels = [(3, 1, 1), (3, 0, 0), (4, 1, 0), (99, None, 1), (None, 1, 1), (1000, 1, 1), (5, 1, None)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    found = audited(spark, [(1, None, None)], [])
    assert len(found) == 600 and {k[0] for k in found} == {""} and found == plain([(1, None, None)], [])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["a", "b", None]), st.sampled_from(TEXTS[:11])), max_size=25),
    st.lists(st.tuples(st.integers(0, 6), st.sampled_from([0, 1, None]), st.sampled_from([0, 1, None])), max_size=6),
)
def test_any_documents(spark, docs, labels):
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_the_transform_is_exact_on_large_counts(spark):
    counts = {m: (1 << 52) + m * m for m in range(32) if m != 7}
    masked = spark.createDataFrame([("p", m % 2 == 0, m % 3 == 0, m, n) for m, n in counts.items()], "part string, good boolean, toxic boolean, mask int, n long")
    sums = filter_audit.parity_sums(masked)
    by_label = {r["label"]: r["sums"] for r in sums.collect()}
    assert by_label["all"] == [sum((-1) ** bin(u & m).count("1") * n for m, n in counts.items()) for u in range(32)]
    cells = filter_audit.mask_cells(sums).first()
    assert cells["all"] == [counts.get(m, 0) for m in range(32)]
    assert cells["toxic"] == [counts.get(m, 0) if m % 3 == 0 else 0 for m in range(32)]


def test_the_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        duckdb.sql(f"create or replace view {name} as from '{sf}/{name}.parquet'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = duckdb.sql(f"select {', '.join(names)} from ({filter_audit.ORACLE_SQL})").fetchall()
    found = queries.op13_filter_audit(spark, sf)
    assert found.columns == names and sorted(map(tuple, found.collect())) == sorted(want)
