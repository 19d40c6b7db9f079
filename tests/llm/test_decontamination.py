import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontamination
from plain_versions import leaks

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_decontamination_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r["text"].split() for r in bench.filter("item_id < 4").orderBy("item_id").collect()]
    planted = [
        (9001, "x y z " * 20 + " ".join(items[0]).upper() + " q" * 30),
        (9002, " ".join(["changed", *items[1][1:]])),
        (9003, " ".join(items[2][: len(items[2]) // 2])),
        (9004, " ".join([*items[3][:1], "inserted", *items[3][1:]])),
        (9005, None), (9006, ""), (9001, "twice"),
    ]
    df = docs(spark, sf).select("doc_id", "text").unionAll(spark.createDataFrame(planted, DOC))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df.selectExpr("*", "1 as n", "2 as start"), bench).collect()}

    rows, items = ([tuple(r) for r in t.collect()] for t in (df.select("doc_id", "text"), bench.select("item_id", "text")))
    want = leaks(rows, items)
    assert got == want and {(9001, 0), (9002, 1), (9004, 3)} <= got and not any(d == 9003 for d, _ in got)
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_decontamination_finds_parts_in_another_order(spark):
    item = [f"w{i}" for i in range(60)]
    a, b, other = item[:30], item[30:], [f"o{i}" for i in range(100)]
    texts = {
        1: [*other, *b, *a, *other[::-1]],
        2: [*item[40:], *item[20:40], *item[:20]],
        3: [*other, *item[:57], "x", "y", "z", *other],
        4: [*other, *a, *other, *b],
        5: [*item, *item[::-1], *b, *a],
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in [*texts.items(), (1, texts[1])]], DOC)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    bag, want = Counter(shingles(item)), {}
    for i, w in texts.items():
        s = shingles(w)
        both = [(sum((Counter(s[k : k + 56]) & bag).values()), -k) for k in range(max(1, len(s) - 55))]
        most, first = max(both)
        nw = len(s[-first : 56 - first])
        if most / (nw + 56 - most) >= 0.75:
            want[i] = (-first, nw + 4, pytest.approx(most / (nw + 56 - most)))
    got = {r["doc_id"]: tuple(r)[2:5] for r in decontamination.find_leaks(df, bench).collect()}
    assert got == want and {1, 3, 5} <= set(want)


def test_recall_within_the_radius(spark):
    """Windows just above the threshold, from edits at random places: the radius loses few of them."""
    random.seed(9)
    items, rows, want = [], [], set()
    for k in range(60):
        item = [f"i{k}w{j}" for j in range(random.randrange(40, 160))]
        items.append((k, " ".join(item)))
        for v in range(8):
            w, bag = list(item), Counter(tuple(item[j : j + 5]) for j in range(len(item) - 4))
            for at in random.sample(range(len(w)), len(w)):
                was, w[at] = w[at], f"x{k}v{v}a{at}"
                both = sum((Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) & bag).values())
                if both / (2 * (len(w) - 4) - both) < 0.75:
                    w[at] = was
                    break
            rows.append((100 * k + v, " ".join(["before"] * 9 + w + ["after"] * 9)))
            want.add((100 * k + v, k))
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want), len(got) / len(want)
    print("recall at the threshold", len(got) / len(want))


def test_blocks_hold_every_fingerprint_within_the_radius(spark):
    random.seed(2)
    rows = []
    for _ in range(300):
        f = random.getrandbits(64)
        g = f
        for bit in random.sample(range(64), random.randrange(decontamination.RADIUS + 1)):
            g ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f, g)))
    df = spark.createDataFrame(rows, "f long, g long")
    near = decontamination.RADIUS // decontamination.BLOCKS
    met = df.withColumn("met", F.size(F.array_intersect(decontamination.blocks(F.col("f")), decontamination.blocks(F.col("g"), near))))
    assert met.filter("met = 0").count() == 0


def test_very_long_and_repeated_texts(spark):
    random.seed(4)
    item = " ".join(f"w{i}" for i in range(50))
    long = " ".join(random.choice("abcdefgh") * 3 for _ in range(200_000))
    df = spark.createDataFrame([(1, f"{long} {item}\n{long}"), (1, f"{long} {item}\n{long}"), (None, item), (2, long)], DOC)
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 2), (None, 1), (None, 2)]


def test_every_text_of_an_item_is_looked_for(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (None, a), (3, None)], "item_id long, text string")
    rows = spark.createDataFrame([(10, "u v " + a), (11, b + " w"), (12, a + " " + b), (13, "clean words only here and there")], DOC)
    got = sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in decontamination.find_leaks(rows, bench).collect())
    assert got == [(10, 1, 1.0), (10, 2, 1.0), (11, 1, 1.0), (12, 1, 1.0), (12, 2, 1.0)]


def test_few_random_pairs_are_candidates(spark):
    """Items of one size that share a common opening: windows look up the items that they may be alike, not a fifth of all."""
    random.seed(8)
    common = "as an example of this we now look at "
    texts = [common + " ".join(f"w{random.randrange(10**6)}" for _ in range(51)) for _ in range(200)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    held = [(i, "before it " + t.replace("example", "instance") + " after it") for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, t, hash(t)) for i, t in held], DOC + ", text_hash long")
    items, gates = decontamination.indexed_items(bench)
    windows = decontamination.with_shingles(rows).withColumn("n", F.lit(56))
    gated = windows.select("doc_id", "text_hash", F.explode("s").alias("h")).join(gates.drop("n"), "h").withColumn("n", F.lit(56))
    gated = gated.select("doc_id", "text_hash", "n", "item_id", "item_hash").distinct()
    windows = windows.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("s") - 56))).withColumn("w", F.slice("s", F.col("start") + 1, 56))
    pairs = decontamination.candidates(windows, items, gated).select("doc_id", "start", "item_id").distinct()
    assert pairs.filter("doc_id <> item_id").count() <= 0.01 * windows.count() * 200
    assert {r[0] for r in pairs.filter("doc_id = item_id").select("doc_id").distinct().collect()} == set(range(200))
    assert decontamination.find_leaks(rows, bench).filter("doc_id = item_id").count() == 200
