import gzip
import json
import struct
from datetime import date

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from larkspur.functions import values
from larkspur.operators import search
from larkspur.plans.filters import find
from larkspur.sources import envelopes, events, formats, samples, store
from larkspur.streaming import ingest


def parsed(df):
    return [json.loads(r["event"]) for r in df.collect()]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def files(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "file string, value string")


def test_ndjson_and_documents(spark):
    df = formats.ndjson(lines(spark, '{"a":1}', "", "not json", '{"b":"x"}', "[1]"))
    rows = events.rows(df, 0)
    assert events.good(rows).count() == 2
    assert sorted(tuple(x) for x in events.bad_lines(rows).collect()) == [("json", "[1]"), ("json", "not json")]
    assert parsed(formats.json_document(lines(spark, '[{"a":1.0},{"a":2}]', '{"a":3}'))) == [{"a": 1.0}, {"a": 2}, {"a": 3}]


def test_text_and_multiline(spark):
    assert parsed(formats.text(lines(spark, "one  ", " ", "two"))) == [{"message": "one"}, {"message": "two"}]
    got = parsed(formats.multiline(files(spark, "head\n2024 a\n  at b\n  at c\n2025 d\n"), r"^\d{4}"))
    assert got == [{"message": "head"}, {"message": "2024 a\n  at b\n  at c"}, {"message": "2025 d"}]


def test_syslog(spark):
    got = parsed(formats.syslog(lines(spark, '<34>1 2026-01-01T00:00:00Z host app 12 ID47 [x@1 a="b"] hello there', "<13>Oct  9 22:14:15 mymachine su[77]: failed for x", "plain"), 2025))
    assert got[0] == {"timestamp": "2026-01-01T00:00:00Z", "message": "hello there", "priority": 34, "facility": 4, "severity": 2, "host": "host", "appname": "app", "procid": "12", "msgid": "ID47"}
    assert got[1] == {"timestamp": "2025-10-09T22:14:15Z", "message": "failed for x", "priority": 13, "facility": 1, "severity": 5, "host": "mymachine", "appname": "su", "procid": "77"}
    assert got[2] == {"message": "plain"}


def test_logfmt(spark):
    got = parsed(formats.logfmt(lines(spark, r'level=info msg="a \"quoted\" one" code=7 svc=api', "no pairs")))
    assert got == [{"level": "info", "msg": 'a "quoted" one', "code": "7", "svc": "api"}, {"message": "no pairs"}]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,level,code\na,"x, y",\nb,,7\n')
    (tmp_path / "a.tsv").write_text("name\tcode\na\t1\n")
    assert parsed(formats.delimited(spark, str(tmp_path / "a.csv"))) == [{"name": "a", "level": "x, y"}, {"name": "b", "code": "7"}]
    assert parsed(formats.delimited(spark, str(tmp_path / "a.tsv"))) == [{"name": "a", "code": "1"}]


def test_grok(spark):
    got = parsed(formats.grok(lines(spark, "2025-03-08 06:20:11,042 WARN [pool-3] dock.Crane - cable slack", "other"), "log4j"))
    want = {"timestamp": "2025-03-08 06:20:11,042", "level": "WARN", "thread": "pool-3", "logger": "dock.Crane", "message": "cable slack"}
    assert got == [want, {"message": "other"}]
    assert parsed(formats.grok(lines(spark, "GET 42ms"), "%{WORD:verb} %{INT:took}ms")) == [{"verb": "GET", "took": "42"}]
    access = '203.0.113.9 - mo [08/Mar/2025:06:20:11 +0000] "PUT /crane?b=1 HTTP/1.1" 304 - "-" "probe"'
    (got,) = parsed(formats.grok(lines(spark, access), "nginx_access"))
    assert got == {
        "clientip": "203.0.113.9", "ident": "-", "auth": "mo", "timestamp": "08/Mar/2025:06:20:11 +0000", "verb": "PUT", "request": "/crane?b=1",
        "httpversion": "1.1", "response": "304", "referrer": "-", "agent": "probe",
    }
    (got,) = parsed(formats.grok(lines(spark, access.split(' "-"')[0].replace(" - ", " x ")), "common_log"))
    assert got["ident"] == "x" and "bytes" not in got and "agent" not in got
    line = "2025-03-08T06:20:11.042Z stderr P half a line"
    assert parsed(formats.grok(lines(spark, line), "containerd"))[0]["logtag"] == "P"
    for name, text in (("MONTHNUM", "09"), ("HOUR", "23"), ("MINUTE", "59"), ("SECOND", "60"), ("ISO8601_TIMEZONE", "+01:00"), ("QS", r'"a \"b\""')):
        assert parsed(formats.grok(lines(spark, text), f"^%{{{name}:x}}$")) == [{"x": text}], name
    with pytest.raises(ValueError):
        formats.grok(lines(spark, "x"), "%{NOPE:x}")


def test_cef_and_w3c(spark):
    got = parsed(formats.cef(lines(spark, r"CEF:0|Acme|Wall|1.0|100|worm \| stopped|10|src=10.0.0.1 msg=two words rt=1700000000000", "CEF:short")))
    assert got[0]["message"] == "worm | stopped" and got[0]["msg"] == "two words" and got[0]["timestamp"] == "1700000000000" and got[0]["severity"] == "10"
    assert got[1] == {"message": "CEF:short"}
    log = "#Version: 1.0\n#Fields: date time sc-status cs-method\n2026-01-01\t00:00:05\t200\tGET\n2026-01-01 00:00:06 - PUT\n"
    got = parsed(formats.w3c(files(spark, log)))
    assert got[0] == {"date": "2026-01-01", "time": "00:00:05", "sc-status": "200", "cs-method": "GET", "timestamp": "2026-01-01T00:00:05Z"} and "sc-status" not in got[1]


def test_bulk(spark):
    body = '{"index":{"_index":"a"}}\n{"create":1,"x":1}\n\n{"delete":{"_id":"1"}}\n{"update":{}}\n{"doc":{"y":2}}\nbroken\n{"create":{}}\n{"index":{"z":1}}\n'
    got = envelopes.unpack(spark.createDataFrame([(body,)], "body string"), "bulk").collect()
    assert [(r["index"], json.loads(r["event"])) for r in got] == [("a", {"create": 1, "x": 1}), ("main", {"y": 2}), ("main", {"index": {"z": 1}})]


def test_envelopes(spark):
    def run(kind, body):
        df = spark.createDataFrame([(body,), ("broken {",)], "body string")
        return [(r["index"], json.loads(r["event"])) for r in envelopes.unpack(df, kind).collect()]

    got = run("collector", '{"event":"hi","time":1.5,"host":"h","index":"i","fields":{"k":1}} {"event":{"a":1,"host":"own"},"host":"h"}\n{"plain":true}')
    assert got == [("i", {"k": 1, "timestamp": 1.5, "host": "h", "message": "hi"}), ("main", {"host": "own", "a": 1}), ("main", {"plain": True})]
    otlp = {"resourceLogs": [{"resource": {"attributes": [{"key": "svc", "value": {"stringValue": "a"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "severityText": "WARN", "body": {"stringValue": "m"}, "attributes": [{"key": "n", "value": {"intValue": "5"}}]}]}]}]}
    assert run("otlp", json.dumps(otlp)) == [("main", {"severity": "WARN", "svc": "a", "n": 5, "message": "m", "timestamp": 1700000000000000000})]
    loki = {"streams": [{"stream": {"app": "x"}, "values": [["1700000000000000000", '{"a":1}'], ["1", "text", {"m": 2}]]}]}
    assert run("streams", json.dumps(loki)) == [("main", {"app": "x", "timestamp": 1700000000000000000, "a": 1}), ("main", {"m": 2, "app": "x", "timestamp": 1, "message": "text"})]


def message(*fields):
    """A protobuf message of (number, value): bytes and texts by length, floats and (8,) bytes fixed, numbers as varints."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 1) + struct.pack("<d", v)
        elif isinstance(v, tuple):
            out += varint(number << 3 | 1) + struct.pack("<Q", v[0])
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v % (1 << 64))
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def test_binary_telemetry(spark):
    pair = lambda k, *value: message((1, k), (2, message(*value)))
    inner = [pair("i", (3, -5)), pair("d", (4, 0.5)), pair("b", (2, 1)), pair("y", (7, b"\x00\xff")), pair("none")]
    nested = message((5, message((1, message((1, "x"))), (1, message((3, 300))))))
    record = message(
        (1, (0,)), (11, (1741400000000000001,)), (3, "WARN"), (5, message((1, "héllo"))), (9, b"\xab" * 16), (99, "unknown"),
        *((6, x) for x in inner), (6, message((1, "list"), (2, nested))), (6, pair("svc", (1, "own"))),
    )
    body = message((1, message((1, message((1, pair("svc", (1, "app"))), (1, pair("zone", (1, "z"))))), (2, message((1, "scope"), (2, record), (2, b""))))))
    got = envelopes.unpack(spark.createDataFrame([(body,), (body[:-3],), (b"\xff" * 20,), (None,)], "body binary"), "otlp_binary").collect()
    assert [json.loads(r["event"]) for r in got] == [
        {"severity": "WARN", "traceId": "ab" * 16, "svc": "own", "zone": "z", "i": -5, "d": 0.5, "b": True, "y": "AP8=", "none": None,
         "list": ["x", 300], "message": "héllo", "timestamp": 1741400000000000001},
        {"svc": "app", "zone": "z"},
    ]


def test_sample_events(spark):
    made = samples.sample_events(spark, 500, 1_741_400_000_000)
    assert made.collect() == samples.sample_events(spark, 500, 1_741_400_000_000).collect() and made.select("index").distinct().count() == 5
    rows = events.rows(made, 0, template="demo")
    assert events.bad_lines(rows).count() == 0
    late = rows.filter(F.col("ts_ms") > 1_741_400_000_000 - samples.DAY_MS // 4).count()
    assert late > 200 and rows.agg(F.max("ts_ms")).first()[0] <= 1_741_400_000_000 < rows.agg(F.min("ts_ms")).first()[0] + samples.DAY_MS + 1


def test_levels_and_events_of_hits(spark):
    df = spark.createDataFrame([("warning", " Error "), ("Critical", "warn"), ("loud", "loud"), (None, None)], "l string, s string")
    assert [tuple(r) for r in df.select(values.level(F.col("l")), values.weight(F.col("s"))).collect()] == [
        ("WARN", "high"), ("FATAL", "medium"), (None, "low"), (None, "low"),
    ]
    hits = spark.createDataFrame([('{"a":{"b":7}}',), ("[1]",), ("text",), (None,)], "raw string")
    got = search.with_event(hits).select(F.variant_get("event", "$.a.b", "int")).collect()
    assert [r[0] for r in got] == [7, None, None, None]


SAMPLES = {
    "[1]": "json", '\n {"a":1}': "ndjson", "<34>x": "syslog", "<3456>x": "text", "a=1 b=2": "logfmt", 'm="a b" n=1': "logfmt", "hello": "text",
    "so a=1 it was b=2 said they all": "text", "": "text", "1=a 2=b": "text",
}


def test_detection(spark):
    assert {x: formats.detect(x) for x in SAMPLES} == SAMPLES
    df = spark.createDataFrame([(x,) for x in SAMPLES], "value string")
    assert {r[0]: r[1] for r in df.select("value", formats.detected(df["value"])).collect()} == SAMPLES


def test_formats_of_packed_files(spark, tmp_path):
    texts = {"a.log": '{"n":1}\n{"n":2}\n', "b": "k=1 l=2\n", "c.gz": '[{"n":3}]', "d.zst": "<13>1 - h - - - - hi", "skip.tmp": "no"}
    for name, text in texts.items():
        data = text.encode()
        data = gzip.compress(data) if name == "b" else zstandard.compress(data) if name in ("a.log", "d.zst") else data
        (tmp_path / name).write_bytes(data)
    found = parsed(formats.parse(formats.read_texts(spark, str(tmp_path), but="*.tmp")))
    assert sorted((e.get("n") or e.get("k") or e.get("message") for e in found), key=str) == [1, "1", 2, 3, "hi"]
    assert formats.read_texts(spark, str(tmp_path), only="*.tmp").count() == 1
    with pytest.raises(ValueError):
        formats.parse(formats.read_texts(spark, str(tmp_path)), "nosuch")


def test_whole_csv(spark):
    texts = files(spark, 'a,b\n1,"x, ""y"""\n,2\n', "", "only\n")
    assert parsed(formats.parse(texts, "csv")) == [{"a": "1", "b": 'x, "y"'}, {"b": "2"}]


BAD = ['{"ts":1e30,"m":1}', '{"n":' + "7" * 400 + "}", "[" * 200_000, '{"a":"\\ud800"}', '{"ts":-1e17}', '{"time":' + "9" * 5000 + "}", "\ud800"[:0]]


def test_no_event_stops_the_others(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in [*BAD, '{"ts":1741400000,"msg":"fine"}', None]], "event string")
    rows = events.rows(df, 86_400_000)
    assert sorted(r["reason"] for r in events.bad_lines(rows).collect()) == ["json"] * 4
    got = {r["raw"]: r for r in events.good(rows).collect()}
    assert len(got) == 5 and got['{"a":"\ufffd"}']["leaves"][0]["s"] == "\ufffd"
    huge = next(r for r in got.values() if '"n":777' in r["raw"])
    assert huge["leaves"][0]["d"] == float("inf") and str(got['{"m":1,"ts":1e+30}']["day"]) == "1970-01-02"
    path = str(tmp_path / "store")
    assert store.append(rows, path) == {"stored": 5, "json": 4} and store.read(spark, path).df.count() == 5
    named = rows.withColumn("index", F.when(F.col("message") == "fine", "a/b").otherwise(F.col("index")))
    assert store.append(named, path) == {"stored": 4, "json": 4, "name": 1}
    assert sorted(r["reason"] for r in store.rejected(named).collect()) == ["json"] * 4 + ["name"]


def days(spark, n, name="x"):
    items = [json.dumps({"ts": 1741400000 + 86_400 * (i % 3), "msg": f"{name}{i}"}) for i in range(n)]
    return events.rows(spark.createDataFrame([(x,) for x in items], "event string"), 0)


def messages(spark, path):
    return sorted(r["message"] for r in store.read(spark, path).df.collect())


def test_store_round_trip_prunes_and_compacts(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read(spark, path).df.count() == 0 and store.append(days(spark, 0), path) == {"stored": 0}
    for name in "abc":
        assert store.append(days(spark, 6, name), path)["stored"] == 6
    before = messages(spark, path)
    v = store.read(spark, path)
    day = 1741400000_000 // 86_400_000 * 86_400_000 + 86_400_000
    found = find(v, start_ms=day, end_ms=day + 86_399_999)
    assert found.df.count() == 6 and "PartitionFilters: [isnotnull" in found.df._jdf.queryExecution().toString()
    assert [d for _, _, d in v.partitions] == ["2025-03-08", "2025-03-09", "2025-03-10"]
    old = store.live_files(spark, path)
    assert len(store.compact(spark, path)) == 3 and store.compact(spark, path) == []
    assert [n for *_, n, _ in store.partition_figures(spark, path)] == [1, 1, 1] and store.totals(spark, path)["files"] == 3
    assert messages(spark, path) == before and v.df.count() == 18  # who read before still can
    assert store.clean(spark, path) == 0 and store.clean(spark, path, grace_s=-60) == len(old) and messages(spark, path) == before
    assert store.retain(spark, path, date(2025, 3, 10), 1) == [("default", "main", "2025-03-08")]
    assert len(messages(spark, path)) == 12 and store.clean(spark, path, grace_s=-60) == 1


def test_what_a_crash_leaves_doesnt_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for name in "ab":
        store.append(days(spark, 6, name), path)
    before = messages(spark, path)

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(store.Folder, "put", dies)
    for work in (lambda: store.append(days(spark, 6, "lost"), path), lambda: store.compact(spark, path)):
        with pytest.raises(OSError):
            work()
        assert messages(spark, path) == before
    monkeypatch.undo()
    store.compact(spark, path)
    assert messages(spark, path) == before and store.clean(spark, path, grace_s=-60) > 6 and messages(spark, path) == before


def test_commits_are_put_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for name in "abcd":
        store.append(days(spark, 3, name), path, commit=f"batch-{name}")
    assert store.append(days(spark, 3, "a"), path, commit="batch-a") == {"stored": 0}
    monkeypatch.setattr(store, "LOG_FILES", 2)
    before = messages(spark, path)
    store.compact(spark, path)
    store.clean(spark, path, grace_s=-60)
    assert messages(spark, path) == before and len(list((tmp_path / "store" / "_log").glob("*.json"))) == 1


@pytest.mark.parametrize(
    ("value", "ms"),
    [("2026-01-01T00:00:00Z", 1767225600000), ("2026-01-01T01:00:00+01:00", 1767225600000), ("10/Oct/2024:13:55:36 +0000", 1728568536000), ("2026-01-01 00:00:00,250", 1767225600250), ("2026-01-01T00:00:00", 1767225600000),
     (1767225600, 1767225600000), (1767225600.5, 1767225600500), (1767225600000, 1767225600000), (1767225600000000, 1767225600000), (1767225600000000000, 1767225600000), ("soon", None), (True, None), (None, None)],
)
def test_times(value, ms):
    assert events.epoch_ms(value) == ms


def test_row_rules():
    r = events.row({"Attributes": {"k": 1}, "ts": "soon", "time": 1767225600, "message": "", "msg": "hi", "Deep": {"A": [1, "x", 2.0, None, {"B": True}]}, "log.source": "s"}, "d", "app-{{Deep.none}}-{{msg}}")
    assert (r["ts_ms"], r["message"], r["source"], r["target"]) == (1767225600000, "hi", "s", "app-unknown-hi")
    got = r["leaves"]
    assert ("deep.a", 0, 1, None, None, None) in got and ("deep.a", 0, None, 2.0, None, None) in got and ("deep.a.b", 0, None, None, True, None) in got and ("k", 0, 1, None, None, None) in got
    assert ("ts", 0, None, None, None, "soon") in got and ("message", 0, None, None, None, "") in got
    assert events.row({"a": 1}, "d", "m")["timed"] is False


NOW = {"availableNow": True}


def test_streaming_equals_batch(spark, tmp_path):
    src, out, heard = tmp_path / "in", str(tmp_path / "out"), []
    src.mkdir()
    (src / "a.ndjson").write_text('{"ts":1767225600,"msg":"a","n":1}\nbad\n{"ts":1767312000,"msg":"b","n":2}\n' + "\n".join(x for x in BAD if x))
    run = lambda: ingest.ingest(
        ingest.text_files(spark, str(src), only="*.ndjson"), out, str(tmp_path / "ck"), trigger=NOW, counted=lambda n, o: heard.append(o)
    ).awaitTermination()
    run()
    assert heard == [{"stored": 6, "json": 3}]
    (src / "b.ndjson").write_text('{"ts":1767225601,"msg":"late"}\n{"msg":"untimed"}\n')
    (src / "c.other").write_text('{"msg":"not asked for"}\n')
    run()
    rows = store.read(spark, out).df.filter("message is not null").collect()
    assert sorted(r["message"] for r in rows) == ["a", "b", "late", "untimed"]
    assert next(r["day"] for r in rows if r["message"] == "untimed") >= date(2025, 1, 1)  # the day it came, not when the stream began
    store.append(days(spark, 3), out)
    store.compact(spark, out)
    store.clean(spark, out, grace_s=-60)
    (src / "d.ndjson").write_text('{"ts":1767225602,"msg":"after"}\n')
    run()
    assert store.retain(spark, out, date(2026, 1, 1), 400, {"_ops": 1}) != [] and {"late", "after", "x0"} <= {r["message"] for r in store.read(spark, out).df.collect()}
    seen: set = set()
    n = store.read(spark, out).df.count()
    assert len(ingest.tail(store.read(spark, out), -(1 << 60), seen)) == n and ingest.tail(store.read(spark, out), -(1 << 60), seen) == []


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.ndjson").write_text('{"ts":1767225600,"msg":"a"}\n')
    for _ in range(2):
        ingest.ingest(ingest.text_files(spark, str(src)), out, str(tmp_path / "ck"), trigger=NOW).awaitTermination()
        for f in (tmp_path / "ck" / "commits").glob("*"):  # as after a crash between the batch and Spark's own record of it
            f.unlink()
    assert messages(spark, out) == ["a"]


def test_windows_and_monitor(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "alerts")
    src.mkdir()

    def minutes(name, *at):
        (src / name).write_text("".join(json.dumps({"ts": 1767225600 + 60 * m, "msg": w}) + "\n" for m, w in at))

    def watch(comparison, folder):
        rows = events.good(events.rows(formats.ndjson(ingest.text_files(spark, str(src))), 0))
        hot = lambda v: F.col("message") == "hot"
        ck = str(tmp_path / f"ck-{comparison}")
        ingest.monitor(rows, "1 minute", 60_000, comparison, 1, folder, ck, predicate=hot, trigger=NOW).awaitTermination()
        return sorted(((r["window_ms"] - 1767225600_000) // 60_000, r["n"]) for r in ingest.alerts_of(spark, folder).collect())

    minutes("a", (0, "hot"), (1, "hot"), (1, "cold"), (4, "hot"), (5, "cold"))
    assert watch("gte", out) == [(0, 1), (4, 1)]  # minutes 2 and 3 are windows of 0 between two breaches
    assert watch("lt", str(tmp_path / "none")) == [(2, 0)]  # no events is what this one waits for
    minutes("b", (5, "hot"), (6, "hot"), (9, "cold"), (10, "hot"), (12, "cold"))
    assert watch("gte", out) == [(0, 1), (4, 1), (10, 1)]  # 5 and 6 go on with 4 after the restart
    counts = ingest.window_counts(events.good(events.rows(formats.ndjson(ingest.text_files(spark, str(src))), 0)), "5 minutes", "0 seconds")
    at = str(tmp_path / "windows")
    counts.writeStream.format("parquet").option("path", at).option("checkpointLocation", at + "-ck").trigger(**NOW).start().awaitTermination()
    assert sorted(((r[0] - 1767225600_000) // 60_000, r[1]) for r in spark.read.parquet(at).collect()) == [(0, 4), (5, 4)]


def test_routing(spark):
    rules = [("svc", "equals", "a", "one"), ("msg", "contains", "(x)", "two"), ("msg", "regex", "^z+$", "three")]
    df = spark.createDataFrame([(json.dumps(e),) for e in ({"svc": "a", "msg": "zz"}, {"msg": "q(x)"}, {"msg": "zzz"}, {"svc": "b"}, {})], "event string")
    assert [r[0] for r in df.select(ingest.routed(rules, "rest")).collect()] == ["one", "two", "three", "rest", "rest"]


def test_a_spoilt_record_leaves_the_others(spark):
    def run(kind, body):
        df = spark.createDataFrame([(body,)], "body string")
        return [(r["bad"], json.loads(r["event"]) if r["bad"] is None else r["event"]) for r in envelopes.unpacked(df, kind).collect()]

    good = {"body": {"stringValue": "m"}}
    groups = [{"scopeLogs": [{"logRecords": [good, 5, {"attributes": 7}, good]}, "x"]}, {"resource": 3, "scopeLogs": []}, {"scopeLogs": 4}, {}]
    want = [(None, {"message": "m"}), ("record", "5"), ("record", '{"attributes": 7}'), (None, {"message": "m"}), ("record", '"x"')]
    want += [("record", '{"resource": 3, "scopeLogs": []}'), ("record", "4")]
    assert run("otlp", json.dumps({"resourceLogs": groups})) == want
    streams = [{"stream": {"a": "b"}, "values": [["1", "x"], 7, []]}, 7, {"values": [["2", "y"]]}, {"values": "z"}]
    want = [(None, {"a": "b", "timestamp": 1, "message": "x"}), ("record", "7"), (None, {"a": "b"}), ("record", "7")]
    assert run("streams", json.dumps({"streams": streams})) == [*want, (None, {"timestamp": 2, "message": "y"}), ("record", '"z"')]
    assert run("collector", '{"a":1} 7 {"b":2} {"c":') == [(None, {"a": 1}), ("record", "7"), (None, {"b": 2}), ("record", '{"c":')]
    bulk = '{"index":{}}\n{"a":1}\nbroken\n{"nosuch":{}}\n{"delete":{}}\n{"index":{}}\n[1]\n{"create":{}}\n{"b":2}'
    assert run("bulk", bulk) == [(None, {"a": 1}), ("record", "broken"), ("record", '{"nosuch":{}}'), ("record", "[1]"), (None, {"b": 2})]
    for kind in ("otlp", "streams"):
        assert run(kind, "[1") == [("body", "[1")] and run(kind, "") == run(kind, "{}") == [] and run(kind, "[]") == [("body", "[]")]
    rows = events.rows(formats.json_document(lines(spark, '[{"a":1},2]', '[{"a":1},', "", " ", '{"b":2}', "7", "[]")), 0)
    assert events.good(rows).count() == 2 and sorted(r["raw"] for r in events.bad_lines(rows).collect()) == ["2", "7", '[{"a":1},']


def test_syslog_quotes_and_levels(spark):
    some = (r'<165>1 - h a - - [x@1 k="v]w" l="\"]"][y z="]"] hello', "<192>1 - h a - - - m", "<191>1 - h a - - - m", "<007>1 - h a - - - m")
    got = parsed(formats.syslog(lines(spark, *some), 2025))
    assert got[0]["message"] == "hello" and got[0]["priority"] == 165 and got[1] == {"message": "<192>1 - h a - - - m"}
    assert (got[2]["priority"], got[2]["severity"]) == (191, 7) and got[3]["priority"] == 7


def test_cef_is_taken_apart_once(spark):
    """The pattern of a line is tried a few times, not once for each use of what it gives."""
    df = formats.cef(spark.createDataFrame([(r"CEF:0|v|p\|q|1|9|a b|5|src=1.2.3.4 note=two words rt=17 src=5.6.7.8",)], "value string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 9 and plan.count("regexp_extract_all(") == 2
    event = json.loads(df.first()["event"])
    assert (event["device_product"], event["src"], event["note"], event["timestamp"]) == ("p|q", "5.6.7.8", "two words", "17")


class Taken:
    """Stands for a DataFrame: keeps the function that its rows would go through."""

    def __getattr__(self, name):
        return lambda *args, **kw: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_python_workers_hand_on_events_in_pieces(spark):
    """A worker keeps a few MB of what it makes of a batch, however much that is."""
    body = "".join('{"create":{}}\n' + json.dumps({"m": "x" * 1000, "n": i}) + "\n" for i in range(1500))
    at = Taken()
    envelopes.unpacked(at, "bulk")
    out = list(at.run([pa.RecordBatch.from_pydict({"body": [body] * 8})]))
    assert sum(b.num_rows for b in out) == 12_000 and max(b.nbytes for b in out) < 6 << 20
    at, event = Taken(), json.dumps({"message": "x" * 100_000})
    events.rows(at, 0)
    out = list(at.run([pa.RecordBatch.from_pydict({"event": [event] * 300})]))
    assert sum(b.num_rows for b in out) == 300 and max(b.nbytes for b in out) < 10 << 20


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_pieces_of_files_are_whole_files_of_lines(spark, tmp_path, size):
    lines = "".join(json.dumps({"a": i, "b": "é" * (i % 9)}) + ("\r\n" if i % 3 else "\n") for i in range(300))
    texts = {"a.log": "\n \n" + lines, "b.log": "plain\n" + lines, "c.log": '[{"a": 1},\n{"a": 2}]', "d.log": "", "e.log": "<1>x y\n{}\n" * 9 + "k=v"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
        (tmp_path / f"{name}.z").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "f.log").write_bytes(b"\xff\xc3\n\xe2\x82\n" * 5)
    pieces = formats.read_pieces(spark, str(tmp_path), size=size)
    assert size > 64 or pieces.groupBy("file").count().filter("count > 5").count() >= 4
    got, want = (sorted(r["event"] for r in formats.parse(x).collect()) for x in (pieces, formats.read_texts(spark, str(tmp_path))))
    assert got == want and len(got) > 1200


def test_names_of_indexes_are_cleaned_once():
    """a value that many events have is cleaned for its index once; long values are not kept."""
    before = events._name_part.cache_info().misses
    made = {events.index_name("log-{{ kind }}", {"kind": k}) for k in ["A b/7", "A b/7", "x" * 300, "", None, {"a": 1}] * 50}
    assert made == {"log-a-b-7", "log-" + "x" * 64, "log-unknown"}
    assert events._name_part.cache_info().misses - before <= 2
    assert events.index_name("plain}}", {"kind": "a"}) == "plain}}" and events.index_name("{{x", {"x": 1}) == "{{x"
    r = events.row({"msg": 5, "body": "", "event": "hi", "_source": "s", "attributes": {"a": 1}}, "d", "m")
    assert (r["message"], r["source"], [x[0] for x in r["leaves"]]) == ("hi", "s", ["a", "msg", "body"])
