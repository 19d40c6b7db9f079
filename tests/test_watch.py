import json
import random

from pyspark.sql import functions as F

from larkspur.operators.monitors import COMPARISONS
from larkspur.sources import events, formats
from larkspur.streaming import ingest, watch

NOW, T0, MINUTE = {"availableNow": True}, 1767225600, 60_000


def alerts(rows, comparison, threshold, until):
    """By going through each group's windows from its first row on; those that end after `until` aren't over."""
    out = []
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        first, breached = min(t for _, t, _ in mine) // 60, False
        for w in range(first, until // 60 + 2):
            if (w + 1) * 60 > until:
                break
            n = sum(fits for _, t, fits in mine if t // 60 == w)
            now = COMPARISONS[comparison](n, threshold)
            if now and not breached:
                out.append((g, (T0 // 60 + w) * MINUTE, n))
            breached = now
    return sorted(out)


def run(spark, src, tmp_path, comparison="gte", threshold=2):
    rows = events.good(events.rows(formats.ndjson(ingest.text_files(spark, str(src))), 0))
    hot = lambda v: F.col("message") == "hot"
    found = watch.group_alerts(rows, {"svc": lambda v: v.fields.text("svc")}, MINUTE, comparison, threshold, predicate=hot)
    out = str(tmp_path / f"alerts-{comparison}")
    watch.monitor_groups(found, out, str(tmp_path / f"ck-{comparison}"), NOW).awaitTermination()
    return sorted(tuple(r) for r in watch.alerts_of(spark, out, ["svc"]).collect())


def write(path, rows):
    path.write_text("".join(json.dumps({"ts": T0 + t, "svc": g, "msg": "hot" if fits else "cold"}) + "\n" for g, t, fits in rows))


def test_groups_with_quiet_windows_and_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [("a", 0, True), ("a", 5, True), ("a", 70, True), ("a", 75, True), ("b", 10, True), ("b", 130, True), ("b", 140, True), ("c", 305, False)]
    write(src / "1", [*first, (None, 20, True)])
    assert run(spark, src, tmp_path) == alerts(first, "gte", 2, 305) == [("a", T0 * 1000, 2), ("b", T0 * 1000 + 2 * MINUTE, 2)]
    assert run(spark, src, tmp_path, "lt", 1) == alerts(first, "lt", 1, 305)  # nothing to hear is what this one waits for
    second = [("a", 310, True), ("a", 311, True), ("c", 306, True), ("c", 307, True), ("d", 700, False)]
    write(src / "2", second)
    assert run(spark, src, tmp_path) == alerts(first + second, "gte", 2, 700)
    done = tmp_path / "ck-gte" / "commits"
    last = max(int(f.name) for f in done.glob("[0-9]*"))
    for f in (done / str(last), done / f".{last}.crc"):  # as after a crash before the batch's own record
        f.unlink()
    assert run(spark, src, tmp_path) == alerts(first + second, "gte", 2, 700)


def test_many_groups(spark, tmp_path):
    random.seed(3)
    src = tmp_path / "in"
    src.mkdir()
    rows = [(f"g{random.randrange(2000)}", random.randrange(0, 240), random.random() < 0.8) for _ in range(6000)] + [("end", 600, False)]
    write(src / "1", rows)
    assert run(spark, src, tmp_path) == alerts(rows, "gte", 2, 600)
