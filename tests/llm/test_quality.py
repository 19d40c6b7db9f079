import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality(spark):
    df, labels = docs(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(5001, None, "en"), (5002, "", None), (5003, "The and of", None), (5003, "The and of", None)], DOC + ", lang string")
    rows = quality.judge(df.select("doc_id", "text", "lang").unionAll(odd), labels).collect()
    assert len(rows) == 1004
    by = {r["doc_id"]: r for r in rows}
    assert by[5001]["perplexity"] is None and not by[5001]["kept"] and not by[5002]["kept"] and by[5003]["perplexity"] > 0
    known = {r["doc_id"]: r["quality"] for r in labels.filter("toxic = 0").collect()}
    good = [by[i]["kept"] for i, q in known.items() if q == 1 and i in by]
    bad = [by[i]["kept"] for i, q in known.items() if q == 0 and i in by]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)
    assert quality.judge(df.limit(0), labels).count() == 0 and quality.judge(df.limit(5), labels.limit(0)).count() == 5


def test_quality_learns_from_all_good_labels(spark):
    ids = spark.range(9000)
    df = ids.selectExpr("id as doc_id", "if(id < 4500, 'the cat and the dog', 'le chat et le chien') as text", "if(id < 4500, 'en', 'fr') as lang")
    labels = ids.selectExpr("id as doc_id", "1 as quality", "if(id % 9 = 0, 1, 0) as toxic")
    assert quality.labelled_good(labels).count() == 8000
    assert {r["kept"] for r in quality.judge(df, labels).select("kept").distinct().collect()} == {True}


def test_quality_tells_characters_apart_whatever_their_number(spark):
    random.seed(5)
    clean = [" ".join("".join(chr(0x4E00 + random.randrange(40) * 10 + k) for k in range(10)) for _ in range(20)) for _ in range(150)]
    junk = ["".join(chr(0x4E00 + random.randrange(400)) for _ in range(220)) for _ in range(20)]
    df = spark.createDataFrame([(i, x, "zh") for i, x in enumerate(clean + junk)], DOC + ", lang string")
    labels = df.selectExpr("doc_id", "int(doc_id < 150) as quality", "0 as toxic")
    by = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    assert max(by[i]["perplexity"] for i in range(150)) * 2 < min(by[i]["perplexity"] for i in range(150, 170))
    assert sum(by[i]["kept"] for i in range(150)) >= 145 and not all(by[i]["kept"] for i in range(150, 170))


class KneserNey:
    """Interpolated modified Kneser-Ney of character trigrams, written down plainly."""

    def __init__(self, texts):
        grams = Counter(g for t in texts for g in trigrams(t))
        pairs = Counter(g[1:] for g in grams)
        singles = Counter(g[1:] for g in pairs)
        self.counts = {1: singles, 2: pairs, 3: grams}
        self.d, self.total, self.kinds = {}, {}, {}
        for order, counts in self.counts.items():
            n = [sum(c == i for c in counts.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
            self.d[order] = [0, *(max(0.1, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else y * i for i in (1, 2, 3))]
            self.total[order], self.kinds[order] = Counter(), {}
            for g, c in counts.items():
                self.total[order][g[:-1]] += c
                self.kinds[order].setdefault(g[:-1], []).append(min(c, 3))

    def p(self, g):
        order, context = len(g), g[:-1]
        lower = self.p(g[1:]) if order > 1 else 1 / (len(self.counts[1]) + 1)
        if not self.total[order][context]:
            return lower
        d, c = self.d[order], self.counts[order][g]
        gamma = sum(d[k] for k in self.kinds[order][context]) / self.total[order][context]
        return max(c - d[min(c, 3)], 0) / self.total[order][context] + gamma * lower


def trigrams(text):
    t = ["<", "<", *text, "<"]
    return [tuple(t[i : i + 3]) for i in range(len(t) - 2)]


def test_perplexities_equal_brute_force(spark):
    random.seed(8)
    en = ["".join(random.choice("abcde ") for _ in range(random.randrange(1, 60))) for _ in range(40)]
    zh = ["".join(chr(0x4E00 + random.randrange(90)) for _ in range(random.randrange(1, 40))) for _ in range(40)]
    rows = [(i, x, "en" if i < 40 else "zh") for i, x in enumerate(en + zh)]
    rows += [(80, "unseen: ÿ🙂", "en"), (81, "aé中", "xx"), (82, "ab" * 40_000, None), (83, "", "en"), (84, None, "zh"), (None, "abc", "en")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], DOC + ", lang string, bin int, perplexity double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(80)] + [(3, 0, 0), (9999, 1, 0)], "doc_id int, quality int, toxic int")
    trusted = [i for i in range(80) if i % 4 and i % 7 and i != 3]
    of = {lang: KneserNey([x for i, x, y in rows if i in trusted and y == lang]) for lang in ("en", "zh")}
    everything = KneserNey([x for i, x, _ in rows if i in trusted])
    got = {(r["doc_id"], r["lang"]): r for r in quality.judge(df, labels).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        r = got[i, lang]
        if not text:
            assert r["perplexity"] is None and not r["kept"]
            continue
        logs = [math.log(of.get(lang, everything).p(g)) for g in trigrams(text)]
        assert r["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6), (i, lang)
    for lang, quantile in (("en", 1 - 0.9 * 11 / 40), ("zh", 1 - 0.9 * 10 / 40)):
        found = sorted(r["perplexity"] for (_, x), r in got.items() if x == lang and r["perplexity"] is not None)
        least = found[math.ceil(quantile * len(found) - 1e-9) - 1]
        (threshold,) = {r["threshold"] for (_, x), r in got.items() if x == lang}
        assert least <= threshold <= least * 1.0021
        assert all(r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= threshold) for (_, x), r in got.items() if x == lang)


def test_probabilities_sum_to_one(spark):
    df = docs(spark).select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.lit(True).alias("good")).limit(60)
    models = quality.learn(quality.gram_counts(df))
    chars = models[0][1].filter("lang = 'en'").select(F.col("g").alias("z"))
    some = models[1][1].filter("lang = 'en'").select(F.col("g").alias("ab")).orderBy(F.xxhash64("g")).limit(20)
    every = chars.unionAll(spark.createDataFrame([(quality.UNSEEN,)], "z long"))
    wanted = some.crossJoin(every).select(F.lit("en").alias("lang"), F.shiftleft("ab", quality.BITS).bitwiseOR(F.col("z")).alias("g"), "ab")
    sums = quality.log_probabilities(wanted, models).groupBy("ab").agg(F.sum(F.exp(F.col("lp") / quality.SCALE)).alias("p")).collect()
    assert len(sums) == 20 and all(abs(r["p"] - 1) < 1e-6 for r in sums)
