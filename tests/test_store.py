import json
import random
import threading
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur import queries_store
from larkspur.operators import discovery
from larkspur.operators.search import page
from larkspur.operators.stats import Agg, stats
from larkspur.plans.filters import compare, find, newest_page, phrase, word
from larkspur.sources import events, store
from larkspur.sources.folder import Folder

START, DAY_MS = 1741392000, 86_400_000


def rows_of(spark, items, **options):
    return events.rows(spark.createDataFrame([(json.dumps(x),) for x in items], "event string"), START * 1000, **options)


def days(spark, n, name="x", of=3):
    return rows_of(spark, [{"ts": START + 86_400 * (i % of) + i, "msg": f"{name}{i}"} for i in range(n)])


def messages(spark, path):
    return sorted(r["message"] for r in store.read(spark, path).df.collect())


def test_one_of_two_writers_wins(spark, tmp_path):
    """A hundred rounds on a local disk: one winner each, and a file that can be read."""
    folders = [Folder(spark, str(tmp_path / "f")) for _ in range(2)]
    for i in range(100):
        ready, won = threading.Barrier(2), [None, None]

        def go(k):
            ready.wait()
            won[k] = folders[k].put(f"_log/{i:012d}.json", {"by": k, "more": "x" * 5000})

        threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sorted(won) == [False, True] and folders[0].read(f"_log/{i:012d}.json")["by"] == won.index(True)
    assert not folders[0].files("_drafts")


def test_racing_commits_all_count(spark, tmp_path):
    at = [Folder(spark, str(tmp_path / "f")) for _ in range(4)]

    def go(k):
        for i in range(8):
            name = f"w{k}-{i}"
            assert store.advance(at[k], lambda log: {"new": [{"file": name}], "name": name})
            assert not store.advance(at[k], lambda log: None if log.has(name) else {})

    threads = [threading.Thread(target=go, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = store.read_log(at[0])
    assert log.version == 32 and len(log.new) == 32 and log.last == {f"w{k}": 7 for k in range(4)}


def test_appends_during_a_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for name in "ab":
        store.append(days(spark, 6, name), path)
    first, put = [True], Folder.put

    def late(self, name, what):
        if first.pop() if first else False:
            store.append(days(spark, 6, "c"), path)  # between the compaction's reading and its commit
        return put(self, name, what)

    monkeypatch.setattr(Folder, "put", late)
    store.compact(spark, path)
    assert messages(spark, path) == sorted(f"{n}{i}" for n in "abc" for i in range(6))
    first.append(True)

    def taken(self, name, what):
        if first.pop() if first else False:
            store.retain(spark, path, date(2025, 3, 10), 1)  # takes a day that is being compacted
        return put(self, name, what)

    monkeypatch.setattr(Folder, "put", taken)
    with pytest.raises(store.Conflict):
        store.compact(spark, path)
    monkeypatch.undo()
    left = messages(spark, path)
    assert len(left) == 12 and store.compact(spark, path) and messages(spark, path) == left


def test_small_files_only_are_compacted(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(days(spark, 600, "large" * 20, 1), path)
    (large,) = store.live_files(spark, path)
    size = store.live_files(spark, path)[large]
    for name in "ab":
        store.append(days(spark, 3, name, 1), path)
    assert store.compact(spark, path, target=size) and large in store.live_files(spark, path)
    assert len(store.live_files(spark, path)) == 2 and store.compact(spark, path, target=size) == []


def test_the_list_of_files_is_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LOG_FILES", 2)
    path = str(tmp_path / "store")
    for name in "abc":
        store.append(days(spark, 6, name), path, commit=f"s-{ord(name)}")
    store.compact(spark, path)
    store.clean(spark, path, grace_s=-60)
    store.append(days(spark, 6, "d"), path, commit="other")
    log = store.read_log(Folder(spark, path))
    assert log.table and log.since == 1 and len(messages(spark, path)) == 24
    for name in ("s-98", "s-99", "other"):
        assert store.append(days(spark, 6, "z"), path, commit=name) == {"stored": 0}
    assert len(store.compact(spark, path)) == 3 and len(messages(spark, path)) == 24  # replaces files that the table lists
    assert store.retain(spark, path, date(2025, 3, 10), 1) == [("default", "main", "2025-03-08")] and len(messages(spark, path)) == 16
    got = {str(r["day"]): r for r in store.partitions(spark, path).collect()}
    assert set(got) == {"2025-03-09", "2025-03-10"} and all(r["files"] == 1 and r["rows"] == 8 for r in got.values())
    (one,) = store.indexes(spark, path).collect()
    assert (one["partitions"], one["files"], one["rows"], str(one["first_day"])) == (2, 2, 16, "2025-03-09")


def opened(view):
    return {f["file"] for f in view.files}


def test_narrowing_before_files_are_listed(spark, tmp_path):
    path = str(tmp_path / "store")
    for index in ("web", "db"):
        for env in ("default", "test"):
            store.append(rows_of(spark, [{"ts": START + 86_400 * i, "msg": "m"} for i in range(4)], template=index, env=env), path)
    v = store.read(spark, path)
    assert len(opened(v)) == 16
    for scope, n, rows in (
        ({}, 16, 16), ({"env": "test"}, 8, 8), ({"index": "w*"}, 8, 8), ({"allowed": [("test", "d*")]}, 4, 4), ({"allowed": []}, 0, 0),
        ({"start_ms": START * 1000 + 1}, 12, 12), ({"start_ms": START * 1000, "end_ms": START * 1000}, 4, 4),
        ({"explicit": [("default", "db", "2025-03-09")]}, 1, 1),
    ):
        found = find(v, **scope)
        plan = found.df._jdf.queryExecution().toString()
        assert found.df.count() == rows and (not n or f"({n} paths)" in plan), scope


def test_newest_page_opens_few_files(spark, tmp_path):
    path, random_ = str(tmp_path / "store"), random.Random(4)
    for _ in range(2):
        items = [{"ts": START + 3600 * random_.randrange(24 * 20), "msg": random_.choice(["hot", "cold"]), "n": i} for i in range(400)]
        store.append(rows_of(spark, items), path)
    v = store.read(spark, path)
    assert len(opened(v)) == 40
    for what, limit, offset in ((word("hot"), 10, 0), (word("hot"), 5, 20), (word("cold") & compare("n", "<", 100), 10, 3), (None, 1, 0)):
        got, n = newest_page(v, what, limit, offset)
        want = page(find(v, what), limit, offset).collect()
        assert got.collect() == want and n < 40, (limit, n)
    got, n = newest_page(v, None, 5)
    assert n == 8 and got.count() == 5
    for what in (word("nosuch"), word("hot") & compare("n", "<", 3)):  # fewer hits than asked for
        got, n = newest_page(v, what, 100)
        assert got.collect() == page(find(v, what), 100).collect() and n == 40
    got, n = newest_page(v, word("hot"), 3, end_ms=START * 1000 + 5 * DAY_MS)
    assert got.collect() == page(find(v, word("hot"), end_ms=START * 1000 + 5 * DAY_MS), 3).collect() and n <= 12
    got, n = newest_page(store.read(spark, str(tmp_path / "none")), None, 3)
    assert got.count() == 0 and n == 0


def test_words_keep_files_closed(spark, tmp_path):
    """Eight files of equal size: a word that is nowhere opens under a quarter of the bytes, one of one file under half."""
    path, random_ = str(tmp_path / "store"), random.Random(5)
    made = [f"w{random_.randrange(10**6)}" for _ in range(4000)]
    for i in range(8):
        items = [{"ts": START + 86_400 * i + k, "msg": " ".join(random_.choices(made, k=8))} for k in range(400)]
        items[7]["msg"] += f" only-{i} Mixed.Case_{i}"
        items[8]["source"] = f"Host {i}/x.log"
        store.append(rows_of(spark, items), path)
    v = store.read(spark, path)
    assert len(opened(find_files(v, word("only-3")))) == 8  # nothing is known yet
    assert store.index(spark, path) == 8 and store.index(spark, path) == 0
    v = store.read(spark, path)
    total = sum(f["bytes"] for f in v.files)
    for what, share in (
        (word("nowhere"), 0.25), (word("only-3"), 0.5), (word("mixed.case_5"), 0.5), (phrase("only-3 mixed.case_3"), 0.5),
        (word("only-3") | word("only-4"), 0.5), (word("only-3") & word("only-4"), 0.25), (word("only-2", "message") & ~word("x"), 0.5),
        (word("Host 6/x.log", "source"), 0.5), (word("Host 6/x.log"), 0.5),
    ):
        narrow = find_files(v, what)
        assert sum(f["bytes"] for f in narrow.files) < share * total, what.needs
        assert find(v, what).df.count() == v.where(what.predicate(v)).df.count()
    for what in (word("only-*"), ~word("nowhere"), word("only-1") | compare("ts", ">", 0), word("x", "msg"), compare("n", ">", 1)):
        assert len(opened(find_files(v, what))) == 8
    for w in random_.sample(made, 20):
        assert find(v, word(w)).df.count() == v.where(word(w).predicate(v)).df.count()
    store.append(rows_of(spark, [{"ts": START, "msg": "nowhere"}]), path)
    v = store.read(spark, path)
    assert find(v, word("nowhere")).df.count() == 1 and len(opened(find_files(v, word("nowhere")))) == 1  # not indexed, so opened
    store.compact(spark, path)
    store.index(spark, path)
    assert find(store.read(spark, path), word("only-3")).df.count() == 1


def find_files(view, what):
    return view.narrowed(F.lit(True), None, None, what.needs)


MIXED = [
    {"ts": START, "n": 5, "s": "a", "Deep": {"X": 1.5}}, {"ts": START, "n": 7.25, "s": 9}, {"ts": START, "n": "12", "s": None},
    {"ts": START, "n": [3, 8.5], "s": ["b", "c"]}, {"ts": START, "n": True, "deep": {"x": -2}}, {"ts": START, "n": {"m": 1}},
    {"ts": START, "N": 1 << 62, "s": "A b"}, {"ts": START, "n": -0.0}, {"ts": START}, {"ts": START, "deep.x": 4, "n": 1e300},
]


def test_promoted_fields_give_what_leaves_give(spark, tmp_path):
    path = str(tmp_path / "store")
    plain = store.read(spark, path)
    store.append(rows_of(spark, MIXED), path)
    plain = store.read(spark, path)
    assert store.promote(spark, path, ["N", "deep.x"]) == ["n", "deep.x"] and store.promote(spark, path, ["n"]) == []
    store.append(rows_of(spark, MIXED), path)
    assert store.promote(spark, path, ["s"]) == ["s"]
    store.append(rows_of(spark, MIXED), path)
    mixed = store.read(spark, path)
    store.compact(spark, path)
    whole = store.read(spark, path)
    assert (plain.fields.everywhere, mixed.fields.everywhere, whole.fields.everywhere) == (0, 0, 3)
    tests = [("n", op, x) for op in (">", ">=", "<", "<=") for x in (5, 5.5, 7.25, -2, 1e19, -1e19, 1 << 62, 1e300)]
    tests += [(name, ">", x) for name in ("N", "deep.x", "s", "nosuch") for x in (-3, 1.5)]
    counts = [  # all in one job for each view
        [v.df.agg(*(F.count_if(compare(*t).predicate(v)).alias(str(i)) for i, t in enumerate(tests))).first()] for v in (plain, mixed, whole)
    ]
    (plain_n,), (mixed_n,), (whole_n,) = counts
    for t, a, b, c in zip(tests, plain_n, mixed_n, whole_n):
        assert b == c == 3 * a, t
    for name in ("n", "N", "deep.x", "s", "nosuch"):
        aggs = [Agg("count"), Agg("sum", name), Agg("count", name), Agg("max", name)]
        want = {tuple(r)[0]: r for r in stats(plain, aggs, [name]).rows().collect()}
        for v in (mixed, whole):
            got = {tuple(r)[0]: r for r in stats(v, aggs, [name]).rows().collect()}
            assert set(got) == set(want) and all(got[k][1] == 3 * want[k][1] and got[k][4] == want[k][4] for k in want)


def test_comparisons_of_promoted_fields_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(rows_of(spark, [{"ts": START + i, "n": i, "x": i / 2} for i in range(50)]), path)
    assert set(store.promote(spark, path)) == {"n", "x"}
    store.compact(spark, path, least_files=1)
    v = store.read(spark, path)
    plan = find(v, compare("n", ">=", 10) & compare("x", "<", 20)).df.select("ts_ms")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(f_0.i,10)" in pushed and "leaves" not in pushed.split("ReadSchema")[1]


def test_the_catalog_reads_no_rows_and_stays_near(spark, tmp_path):
    path, random_ = str(tmp_path / "store"), random.Random(6)
    for part in range(3):
        items = [{"ts": START + i, "few": f"f{i % 7}", "many": f"m{random_.randrange(3000)}", "n": i, "k": {"flag": i % 2 == 0}} for i in range(2000)]
        store.append(rows_of(spark, items + [{"rare": "x"}] * part), path)

    def check():
        exact = {r["path"]: r for r in discovery.field_catalog(store.read(spark, path)).collect()}
        got = {r["path"]: r for r in store.catalog(spark, path).collect()}
        assert set(got) == set(exact)
        for p, r in got.items():
            assert (r["kind"], r["rows"], r["coverage"]) == (exact[p]["kind"], exact[p]["rows"], exact[p]["coverage"])
            assert r["cardinality"] == pytest.approx(exact[p]["cardinality"], rel=0.1), p

    check()
    store.index(spark, path)
    check()
    store.compact(spark, path)
    check()
    store.index(spark, path)
    check()
    for f in Path(path, "data").rglob("*.parquet"):
        f.unlink()  # the rows aren't needed
    assert store.catalog(spark, path).count() == 5


def test_times_of_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(days(spark, 6), path)
    got = {str(f["day"]): (f["min_ms"], f["max_ms"], f["rows"]) for f in store.files(spark, path).collect()}
    assert got["2025-03-08"] == (START * 1000, START * 1000 + 3000, 2)


def test_environments_are_stored_by_one_append(spark, tmp_path):
    """the environment may be an expression of a row; events are read and shuffled once, not once for each environment."""
    env = F.when(F.col("message") == "x0", "one").otherwise("two")
    path = str(tmp_path / "s")
    assert store.append(rows_of(spark, [{"ts": START + i, "msg": f"x{i}"} for i in range(3)], env=env), path) == {"stored": 3}
    found = find(store.read(spark, path), env="two").df.select("env", "message").collect()
    assert sorted(map(tuple, found)) == [("two", "x1"), ("two", "x2")]
    made = queries_store.scoped(spark, "/root/testdata/sf0.001")
    assert store.read_log(Folder(spark, made.path)).version == 1
