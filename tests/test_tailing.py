import json
import os
import random

import pyarrow as pa
import pytest

from larkspur.operators.stats import Agg, stats
from larkspur.sources import store
from larkspur.streaming import ingest, tailing

NOW = {"availableNow": True}


@pytest.fixture
def tail(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def run(**options):
        """One run of the stream, from a fresh reader: what it read is in the table."""
        df = tailing.growing_files(spark, str(src), **options)
        writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        writer.trigger(**NOW).start().awaitTermination()
        return sorted(r["value"] for r in spark.read.schema(tailing.SCHEMA).parquet(out).collect())

    run.src = src
    return run


def add(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_lines_come_once_when_they_end(tail):
    a, b = tail.src / "a.log", tail.src / "b.log"
    add(a, "one\ntwo\nthr")
    assert tail() == ["one", "two"]
    assert tail() == ["one", "two"]
    add(a, "ee\r\n")
    add(b, "\nfour\nfiv")
    assert tail() == ["", "four", "one", "three", "two"]
    add(a, "six")
    assert tail() == ["", "four", "one", "three", "two"]
    add(b, "e\n")
    add(a, "\n")
    assert tail() == ["", "five", "four", "one", "six", "three", "two"]


def test_cut_replaced_and_renamed_files(tail):
    a, b = tail.src / "a.log", tail.src / "a.log.1"
    add(a, "old one\nold two\n")
    assert tail() == ["old one", "old two"]
    a.write_text("new\n")  # cut short
    assert tail() == ["new", "old one", "old two"]
    a.write_text("other and longer than before\n")  # cut, and grown beyond what was read
    assert len(tail()) == 4
    os.rename(a, b)  # rotated: what is read stays read
    add(a, "fresh\n")
    add(b, "last words\n")
    assert tail()[-1] == "other and longer than before" and {"fresh", "last words"} < set(tail()) and len(tail()) == 6
    b.unlink()
    assert len(tail()) == 6
    for name in ("c.log", "d.log"):  # alike in all they hold
        add(tail.src / name, "same\n")
    assert len(tail()) == 8
    add(tail.src / "c.log", "c\n")
    assert len(tail()) == 9


def test_names_that_are_left_out(tail):
    for name in ("a.log", "a.log.gz", "b.tmp", ".hidden", "_part"):
        add(tail.src / name, name + "\n")
    (tail.src / "deep").mkdir()
    add(tail.src / "deep" / "c.log", "deep\n")
    assert tail(only="*.log,*.tmp", but="b.*") == ["a.log", "deep"]


def test_ranges_of_one_file(spark, tail):
    random.seed(2)
    lines = ["x" * random.choice([0, 1, 5, 300]) + f"é{i}" for i in range(500)]
    add(tail.src / "a.log", "\n".join(lines) + "\nrest")
    assert tail(split_bytes=97) == sorted(lines)


def test_every_cut_gives_every_line_once():
    for text in (b"", b"a", b"a\nb", b"\n\n", b"ab\n\ncde\r\nf\n", b"long " * 30 + b"\nx\n"):
        file = pa.BufferReader(text)
        end = tailing.last_line_end(file, 0, len(text))
        want = [x.removesuffix(b"\r") for x in text[:end].split(b"\n")[:-1]]
        for size in range(1, len(text) + 2):
            got = [x for a in range(0, end, size) for part in tailing.lines_of(file, a, min(a + size, end)) for x in part]
            assert got == want, (text, size)


def test_many_appends_equal_one_batch(spark, tmp_path):
    """The store after a stream over files that grow between its runs is the store after all of it at once."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    random.seed(7)
    texts = {f"{k}.ndjson": "".join(json.dumps({"ts": 1767225600 + i, "msg": f"{k}-{i}", "k": k}) + "\n" for i in range(40)) for k in range(3)}
    done = dict.fromkeys(texts, 0)
    while any(done[n] < len(t) for n, t in texts.items()):
        for n, t in texts.items():
            step = random.randrange(0, 1500)
            add(src / n, t[done[n] : done[n] + step])
            done[n] += step
        ingest.ingest(tailing.growing_files(spark, str(src)).select("value"), out, str(tmp_path / "ck"), trigger=NOW).awaitTermination()
    table = stats(store.read(spark, out), [Agg("count")], ["k"]).rows()
    assert [tuple(r) for r in table.collect()] == [("0", 40), ("1", 40), ("2", 40)]


def test_many_small_files_share_tasks(spark, tail, monkeypatch):
    """Files of a few bytes aren't a task each, and what was read of them isn't read again."""
    for i in range(300):
        add(tail.src / f"{i}.log", "x" * 300 + f"{i}\n")
    before, reader = {"files": "{}"}, tailing._Reader({"path": str(tail.src), "tasks": "4"})
    now = reader.latestOffset()
    parts = reader.partitions(before, now)
    assert len(parts) <= 5 and sorted(p for x in parts for p, _, _ in x.ranges) == sorted(str(f) for f in tail.src.iterdir())
    for i in range(300):
        add(tail.src / f"{i}.log", f"more {i}\n")
    then, looks = reader.latestOffset(), []
    monkeypatch.setattr(tailing, "head_of", lambda f, n: looks.append(n))
    parts = reader.partitions(now, then)
    assert len(parts) <= 5 and not looks and all(start > 300 for x in parts for _, start, _ in x.ranges)
    assert len(tail()) == 600


def reader_of(tail, **options):
    return tailing._Reader({"path": str(tail.src), "tasks": "4", **options})


def test_offsets_of_many_files_stay_small(tail, tmp_path, monkeypatch):
    """With a folder for what is known of the files, no more of them than a part has are held at a time or in an offset."""
    for i in range(600):
        add(tail.src / f"a-file-{i:04d}.log", f"line {i}\n")
    reader, held, files = reader_of(tail, state=str(tmp_path / "state"), filesAPart="32"), [], tailing._Reader._files
    monkeypatch.setattr(tailing._Reader, "_files", lambda *a: [held.append(len(x := files(*a))), x][1])
    first = reader.latestOffset()
    assert len(json.dumps(first)) < 2000 < len(json.dumps(reader_of(tail).latestOffset())) and reader.latestOffset() == first
    parts = reader.partitions(reader.initialOffset(), first)
    assert len(parts) <= 5 and sum(len(x.ranges) for x in parts) == 600 and 0 < max(held[:-1]) <= 64
    add(tail.src / "a-file-0007.log", "more\n")
    held.clear()
    then = reader.latestOffset()
    assert sum(a != b for a, b in zip(first["parts"].split(","), then["parts"].split(","))) == 1
    held.clear()
    assert [r[1:] for x in reader.partitions(first, then) for r in x.ranges] == [(7, 12)] and len(held) == 2


def test_offsets_in_parts_say_what_whole_ones_do(tail, tmp_path, monkeypatch):
    """Files added, grown, cut, renamed and deleted by chance, as many as make more parts or fewer."""
    random.seed(4)
    monkeypatch.setattr(tailing, "KEPT", 3)
    options = {"state": str(tmp_path / "state"), "filesAPart": "8"}
    whole, parts = reader_of(tail), reader_of(tail, **options)
    a, b = whole.initialOffset(), parts.initialOffset()
    for step in range(25):
        there = sorted(tail.src.iterdir())
        for i in range(random.choice([3, 40])):
            add(tail.src / f"{step}-{i}.log", "x" * random.choice([3, 300]) + random.choice(["", "\n"]))
        for f in random.sample(there, len(there) * 2 // 3):
            what = random.randrange(6)
            if what < 2:
                add(f, "y" * random.randrange(300) + "\n")
            elif what == 2:
                f.write_text("z" * random.randrange(400) + "\n")
            elif what == 3:
                f.rename(tail.src / f"{f.stem}-{step}.log")
            else:
                f.unlink()
        if step % 6 == 5:
            for f in random.sample(there, len(there) * 3 // 4):
                f.unlink(missing_ok=True)
            parts = reader_of(tail, **options)  # a restart
        then = whole.latestOffset(), parts.latestOffset()
        want, got = (sorted(r for x in p.partitions(s, t) for r in x.ranges) for p, s, t in ((whole, a, then[0]), (parts, b, then[1])))
        assert got == want, step
        a, b = then
        parts.commit(b)
    assert {len(x.split(",")) for x in (b["parts"], parts._state._committed[0])} != {1}
    left = {f.name for f in (tmp_path / "state").iterdir()}
    assert set(b["parts"].split(",")) - {"{}"} <= left and not any(f.startswith("draft-") for f in left)


def test_parts_that_no_offset_names_are_deleted(tail, tmp_path, monkeypatch):
    monkeypatch.setattr(tailing, "KEPT", 2)
    reader, state = reader_of(tail, state=str(tmp_path / "state")), tmp_path / "state"
    for i in range(6):
        add(tail.src / "a.log", f"{i}\n")
        now = reader.latestOffset()
        reader.commit(now)
        assert now["parts"] in {f.name for f in state.iterdir()}
    assert len(list(state.iterdir())) == 2
    os.utime(next(f for f in state.iterdir() if f.name != now["parts"]), (0, 0))
    again = reader_of(tail, state=str(state))
    assert again.latestOffset() == now
    again.commit(now)
    assert [f.name for f in state.iterdir()] == [now["parts"]]


def test_files_renamed_while_they_are_listed(tail, monkeypatch):
    """What is renamed between the list and the look goes on where it was, and its new name is found at the next look."""
    a, b = tail.src / "a.log", tail.src / "b.log"
    add(a, "one\n")
    reader, below = reader_of(tail), tailing.files_below
    first = reader.latestOffset()

    def rotated(*args):
        found = list(below(*args))
        a.rename(b)
        add(a, "another file\n")
        return found

    monkeypatch.setattr(tailing, "files_below", rotated)
    add(a, "two\n")
    second = reader.latestOffset()
    assert [r for x in reader.partitions(first, second) for r in x.ranges] == []
    monkeypatch.setattr(tailing, "files_below", below)
    third = reader.latestOffset()
    assert sorted(r for x in reader.partitions(second, third) for r in x.ranges) == [(str(a), 0, 13), (str(b), 4, 8)]


def test_a_stream_with_its_state_in_a_folder(tail, tmp_path):
    """Restarts go on from the folder, also of a stream that began without one."""
    add(tail.src / "a.log", "one\ntw")
    assert tail() == ["one"]
    state = str(tmp_path / "state")
    add(tail.src / "b.log", "four\n")
    assert tail(state=state) == ["four", "one"]
    add(tail.src / "a.log", "o\n")
    assert tail(state=state) == ["four", "one", "two"]
    assert tail(state=state) == ["four", "one", "two"]
    last = max((tmp_path / "ck" / "offsets").glob("[0-9]*"), key=lambda f: int(f.name)).read_text()
    assert '"parts"' in last and "a.log" not in last
