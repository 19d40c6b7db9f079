import random
from itertools import combinations

import pytest

from larkspur.llm import url_rules


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    ends = [i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)]
    host = "".join(c.lower() if c.isascii() else c for c in rest[: ends[0]])
    after = rest[ends[0] :]
    path = after[: min([i for i, c in enumerate(after) if c in "?#"] or [len(after)])]
    best = None
    for verdict, rule in url_rules.FIXED:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    bad = [f"http://shop{i}.cheap.net/buy/{i}?ref=x" for i in range(30)]
    good = [f"http://site{i}.net/read/{i}" for i in range(70)]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/en/12", "http://a.example.org/es/x?y#z", "https://x.com/fr/", "https://x.com/de/a#b", "http://org", "http://org/", "http://notcom/de/", "http://É.COM/fr/é", "a://b?c/d", "http://x\ny.com/de/"]
    urls = bad + good + odd + [bad[0]]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, i < 30) for i in range(100)] + [(0, None), (None, True), (12345, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in url_rules.judge(pages, labels, support=0.05).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = plain_verdict(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1]), u
        mined = u is not None and "cheap.net" in u
        assert got[i]["verdict"] == (rule[0] if rule else "block" if mined else "allow"), u
    assert url_rules.judge(pages.limit(0), labels).count() == 0 and url_rules.judge(pages, labels.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def brute_rules(rows, support, confidence):
    """All combinations of tokens, counted one by one; minimal ones only."""
    counts = {}
    for tokens, bad in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n = counts.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += bad
    good = {c: b / n for c, (n, b) in counts.items() if b >= support * len(rows) - 1e-9 and b / n >= confidence}
    return {c: p for c, p in good.items() if not any(good.get(c[:i] + c[i + 1 :], -1) >= p for i in range(len(c)))}


def test_mined_rules_equal_brute_force(spark):
    random.seed(3)
    rows = []
    for _ in range(400):
        t = {x for x in "abcdefg" if random.random() < 0.45}
        rows.append((sorted(t), random.random() < (0.9 if {"a", "b"} <= t else 0.95 if "c" in t and "d" not in t else 0.2)))
    df = spark.createDataFrame([(t, b, str(i)) for i, (t, b) in enumerate(rows)], "tokens array<string>, bad boolean, row string")
    want = brute_rules(rows, 0.02, 0.7)
    for width in (12, 3):  # listed, and grown
        got = {tuple(r["rule_tokens"]): r["confidence"] for r in url_rules.mine(df, 0.02, 0.7, width).collect()}
        assert got == pytest.approx(want) and any(len(c) > 1 for c in got)


def frequent_rules(rows, support, confidence):
    """brute_rules() for many tokens: combinations that enough bad pages have, one by one."""
    rows, least = [(set(t), b) for t, b in rows], support * len(rows) - 1e-9
    names = sorted({x for t, _ in rows for x in t})
    good, todo = {}, [()]
    while todo:
        c = todo.pop()
        some = [b for t, b in rows if t.issuperset(c)]
        if sum(some) < least:
            continue
        if c and sum(some) / len(some) >= confidence:
            good[c] = sum(some) / len(some)
        todo += [(*c, x) for x in names if not c or x > c[-1]]
    return {c: p for c, p in good.items() if not any(good.get(c[:i] + c[i + 1 :], -1) >= p for i in range(len(c)))}


def test_rules_of_pages_with_many_tokens(spark):
    """Twenty bundles a page: the rule of the two most frequent tokens, which are a page's last by rarity, is found."""
    random.seed(11)
    rows = []
    for _ in range(800):
        t = {x for x in "AB" if random.random() < 0.55} | {f"t{k:02}" for k in range(40) if random.random() < 0.5}
        rows.append((sorted(t), {"A", "B"} <= t or random.random() < 0.1))
    df = spark.createDataFrame([(t, b, str(i)) for i, (t, b) in enumerate(rows)], "tokens array<string>, bad boolean, row string")
    for support in (0.2, 0.1):
        got = {tuple(r["rule_tokens"]): r["confidence"] for r in url_rules.mine(df, support, 0.8).collect()}
        assert got == pytest.approx(frequent_rules(rows, support, 0.8)) and got["A", "B"] == 1.0


def test_nested_templates(spark):
    """Tokens that imply each other, neither always together nor always bad, would be 2^25 combinations."""
    rows = [([f"t{k:02}" for k in range(1 + i % 25)], i % 3 > 0 or i % 25 > 20) for i in range(500)]
    df = spark.createDataFrame([(t, b, str(i)) for i, (t, b) in enumerate(rows)], "tokens array<string>, bad boolean, row string")
    got = {tuple(r["rule_tokens"]) for r in url_rules.mine(df, 0.01, 0.75).collect()}
    bad = lambda k: [b for t, b in rows if len(t) > k]
    assert got == {(f"t{k:02}",) for k in range(25) if sum(bad(k)) / len(bad(k)) >= 0.75} and got


def test_very_long_urls(spark):
    long = "http://a.net/" + "/".join(f"p{i}" for i in range(3000)) + "?" + "&".join(f"k{i}=1" for i in range(3000))
    pages = spark.createDataFrame([(1, long), (2, "http://b.net/x"), (3, "http://" + "z" * 1_000_000)], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (2, False), (3, True)], "page_id long, bad boolean")
    assert sorted((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()) == [(1, "block"), (2, "allow"), (3, "block")]


def test_templates_of_many_tokens(spark):
    """Thirty tokens that always go together would be 2^30 combinations."""
    rows = [([f"t{k:02}" for k in range(30)], True, str(i)) for i in range(50)] + [(["x"], False, f"g{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean, row string")
    got = url_rules.mine(df, 0.01, 0.8).collect()
    assert {tuple(r["rule_tokens"]) for r in got} == {(f"t{k:02}",) for k in range(30)} and {r["confidence"] for r in got} == {1.0}
    loose = [(t[: 3 + i % 28] if b else t, b, r) for i, (t, b, r) in enumerate(rows)]
    assert url_rules.mine(spark.createDataFrame(loose, df.schema), 0.01, 0.8).count() > 0


def test_odd_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/x"), (2, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (1, False), (2, True), (7, True)], "page_id long, bad boolean")
    got = url_rules.judge(pages, labels).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "block")]
