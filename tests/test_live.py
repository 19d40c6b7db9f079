import json
import random

from pyspark.sql import functions as F

from larkspur.plans.filters import word
from larkspur.sources import events, formats, store
from larkspur.streaming import ingest, live

NOW, T0 = {"availableNow": True}, 1767225600


def write(path, rows):
    path.write_text("".join(json.dumps({"ts": T0 + t, "msg": m}) + "\n" for t, m in rows))


def stream(spark, src):
    return events.good(events.rows(formats.ndjson(ingest.text_files(spark, str(src))), 0))


def test_live_tail(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    old = spark.createDataFrame([(json.dumps({"ts": T0 + i, "msg": f"old{i} {'hot' if i % 2 else 'cold'}"}),) for i in range(9)], "event string")
    store.append(events.rows(old, 0), path)

    def run(limit=6):
        tail = live.LiveTail(limit)
        tail.backfill(store.read(spark, path), word("hot"))
        tail.follow(stream(spark, src), str(tmp_path / "ck"), word("hot"), trigger=NOW).awaitTermination()
        return [r["message"] for r in tail.rows()]

    assert run() == ["old7 hot", "old5 hot", "old3 hot", "old1 hot"]
    # equal times, an event that comes twice, and one that the store has as well
    write(src / "a", [(20, "a hot"), (20, "b hot"), (20, "a hot"), (21, "c cold"), (7, "old7 hot")])
    got = run()
    assert sorted(got[:2]) == ["a hot", "b hot"] and got[2:] == ["old7 hot", "old5 hot", "old3 hot", "old1 hot"]
    write(src / "b", [(20, "a hot"), *((30 + i, f"n{i} hot") for i in range(50))])  # again after a restart, and a burst
    assert run() == [f"n{i} hot" for i in range(49, 43, -1)]
    tail = live.LiveTail(3)
    for i in range(1000):
        tail._add([{"ts_ms": i, "seq": 1}])
    assert len(tail._rows) == 3


def test_the_old_tail_forgets(spark):
    df = spark.createDataFrame([(i, f"r{i}", i) for i in range(50)], "ts_ms long, raw string, seq long")
    view, seen, got = live.View(df, live.LeafFields()), set(), []
    for at in (0, 10, 30, 49):
        got += [r["raw"] for r in ingest.tail(view, at, seen, 20)]
        assert all(t >= at for t, _ in seen)
    assert len(got) == len(set(got)) == 50


def test_late_events_correct_their_windows(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "windows")
    src.mkdir()
    random.seed(5)
    rows = [(random.randrange(600), random.choice(["hot", "cold"])) for _ in range(300)]
    shuffled = random.sample(rows, len(rows))
    hot = lambda v: F.col("message") == "hot"

    def run(lateness_ms, out, ck):
        w = live.corrected_windows(stream(spark, src), 60_000, lateness_ms, out, str(tmp_path / ck), hot, trigger=NOW)
        w.awaitTermination()
        return {r["window_ms"] // 1000 - T0: r["n"] for r in live.windows_of(spark, out).collect()}

    for i in range(3):
        write(src / str(i), shuffled[i * 100 : i * 100 + 100])
        got = run(10**9, path, "ck")
        some = shuffled[: i * 100 + 100]
        assert got == {w: n for w in range(0, 600, 60) if (n := sum(m == "hot" and t // 60 * 60 == w for t, m in some))}
    assert live.too_late(spark, path).count() == 0
    write(src / "3", [(1000, "hot"), (5, "hot")])
    run(10**9, path, "ck")
    strict = str(tmp_path / "strict")
    run(0, strict, "ck2")  # all files in one batch: nothing is late yet
    write(src / "4", [(1, "hot"), (2, "cold"), (999, "hot"), (1100, "hot")])
    got = run(0, strict, "ck2")
    assert got[960] == 2 and got[0] == sum(m == "hot" and t < 60 for t, m in rows) + 1
    assert [(r["message"], r["ts_ms"]) for r in live.too_late(spark, strict).collect()] == [("hot", (T0 + 1) * 1000)]
    for f in (tmp_path / "ck2" / "commits").glob("*"):
        f.unlink()
    assert run(0, strict, "ck2") == got  # both batches again
