import hashlib
from collections import Counter

import pytest

from larkspur.llm import merkle

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def paragraphs(text):
    return [tuple(merkle._leaves(p)) for p in text.split("\n")]


def plain_likeness(a, b):
    """Without trees: all leaves against all leaves."""
    if a == b:
        return 1.0
    x, y = (Counter(leaf for p in paragraphs(t) for leaf in p) for t in (a, b))
    size = lambda c: sum((len(leaf) + 1) * n for leaf, n in c.items())
    return 2 * size(x & y) / (size(x) + size(y))


def plain_differing(a, b):
    return list((Counter(paragraphs(a)) - Counter(paragraphs(b))).elements()) if a != b else []


def test_merkle(spark):
    df = docs(spark).select("doc_id", "text").unionAll(spark.createDataFrame([(900, None), (901, "é. b\nc\n\nd"), (901, "x"), (902, "long " * 90_000 + "\n\n" + "x" * 9000)], DOC))
    df = df.selectExpr("*", "1 as bucket", "2 as head", "'t' as tie", "0 as down")  # names of its own columns
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: -r[0])
    got = {}
    for r in merkle.compare_with_next(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (doc_id, text) in enumerate(rows):
        if doc_id in (902, 901, 900) or rows[(i + 1) % len(rows)][0] == 901:
            continue  # ties and their neighbours stand in the order of hashes
        changed = merkle.edited(text, rows[(i + 1) % len(rows)][1])
        (r,) = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), merkle.fingerprint(text))
        assert r["edited_fingerprint"] == merkle.fingerprint(changed) and r["n_changed"] == len(plain_differing(text, changed))
        assert r["near_edited"] == pytest.approx(plain_likeness(text, changed))
        assert r["near_next"] == pytest.approx(plain_likeness(text, rows[(i + 1) % len(rows)][1]))
    assert sum(map(len, got.values())) == len(rows)
    one = merkle.compare_with_next(spark.createDataFrame([(1, "abcdef")], DOC)).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert merkle.compare_with_next(df.limit(0)).count() == 0


def test_merkle_likeness_and_differences():
    a = "\n".join(f"This is line {i}. It goes on for a while." for i in range(40))
    b = a.replace("line 20", "line twenty")
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    assert 0.9 < merkle.likeness(fa, fb) < 1 and merkle.likeness(fa, fa) == 1 and len(merkle.differing(fa, fb)) <= 3
    assert merkle.likeness(fa, merkle.fingerprint("")) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.likeness(fa, merkle.fingerprint("other words")) == 0


def test_edits_are_located():
    a = "\n".join("".join(f"word{i * j} " for j in range(60)) for i in range(300))
    b = a.replace("word7 ", "word7 inserted ", 1)
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    (at,) = merkle.differing(fa, fb)
    lines = [p for s in merkle._sections(fa)[: at[0]] for p in merkle._paragraphs(s)]
    assert "word7 " in a.split("\n")[len(lines) + at[1]] and 0.99 < merkle.likeness(fa, fb) < 1


def test_order_of_equal_ids(spark):
    """A third of all rows has one doc_id: they are dealt by their texts, and each has its own successor."""
    rows = [(i, f"text {i}") for i in range(200)] + [(77, f"other {i}") for i in range(100)]
    got = merkle.compare_with_next(spark.createDataFrame(rows, DOC)).collect()
    print_of = {merkle.fingerprint(t): t for _, t in rows}
    assert sorted((r["doc_id"], print_of[r["fingerprint"]]) for r in got) == sorted(rows)
