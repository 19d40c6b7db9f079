import zlib
from collections import Counter

import pytest

from larkspur.llm import language_id

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_held_out_accuracy(spark):
    df = docs(spark, "/root/testdata/sf0.01")
    rows = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 < r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 34 !?", "fr"), (6, "the dog", None), (None, "chat", None), (6, "the dog", None), (4, "İ" * 30_000, None)]
    df = spark.createDataFrame([(*r, True, 0.5) for r in rows], DOC + ", lang string, held_out boolean, score double")
    got = [tuple(r) for r in language_id.identify(df).collect()]
    assert len(got) == 9 and {p for i, _, p, _ in got if i in (3, 5)} == {"und"} and {p for i, _, p, _ in got if i == 6} == {"en"}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got)
    kept = language_id.identified(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 6]
    assert [r[2] for r in language_id.identify(df.withColumn("lang", df.lang.substr(99, 1)).filter("doc_id = 1").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()] == ["und"]
    assert language_id.identify(df.limit(0)).count() == 0


def plain_grams(text):
    """Counts of 1 to 3 characters of each word between blanks, by the number that orders equal counts."""
    number = lambda g: sum((1 if c == " " else ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    grams = Counter()
    for w in filter(None, words):
        grams.update(w)
        for n in (2, 3):
            grams.update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], number(x[0])))[: language_id.PROFILE]], grams


def test_predictions_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs(spark).collect()]
    rows += [(7000, "ß ÄÖ İi 日本 語", "xx"), (7001, "tie", None), (7002, "x " * 60_000, None), (7003, "", "en"), (7004, "1-2", "en"), (None, "ab", "en")]
    texts = {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            texts.setdefault(lang, Counter()).update(plain_grams(text)[1])
    number = lambda g: sum((1 if c == " " else ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    profiles = {}
    for lang in sorted(texts):
        best = sorted(texts[lang].items(), key=lambda x: (-x[1], number(x[0])))[: language_id.PROFILE]
        profiles[lang] = {g: k for k, (g, _) in enumerate(best)}

    def predict(text):
        own, _ = plain_grams(text or "")
        if not own:
            return "und", 0.0
        far = language_id.PROFILE
        away = {x: sum(abs(p[g] - k) if g in p else far for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        return best, max(0.0, 1 - away[best] / (far * len(own)))

    df = spark.createDataFrame(rows, DOC + ", lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = predict(text)
        assert (got[i]["lang_pred"], got[i]["score"]) == (lang, pytest.approx(score)), i


def test_profiles_are_limited_before_they_meet(spark):
    df = spark.createDataFrame([("some text", "en"), ("ein text", "de")], "text string, lang string")
    assert "WindowGroupLimit" in language_id.learn(df, 5)._jdf.queryExecution().toString()
