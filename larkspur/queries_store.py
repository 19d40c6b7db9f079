"""Queries of the store, of streams into it, and of spoilt input, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.values import interval_ms, time_bound
from larkspur.operators import monitors, search
from larkspur.operators.fields import View
from larkspur.operators.stats import Agg, stats, timechart
from larkspur.plans.filters import Filter, compare, find, newest_page, phrase, word
from larkspur.queries import (
    BY_LANG, COUNT, DAY, DEAR, DOCS, ERRORS, EV, HOUR, T0, T1, _by_type, add, bodies, csv, counted, day_of, files_of, get,
    json_events, json_line, lines_folder, r4, record, entry, stored, stream_rows, table, trace, typed, w3c, what, work_path,
)
from larkspur.sources import envelopes, formats, store, telemetry, views
from larkspur.sources import events as shredded
from larkspur.sources.folder import Folder
from larkspur.streaming import ingest, live, tailing, watch

# pages and words


def store_newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of errors from the newest files that can hold it."""
    view = store.read(spark, stored(spark, json_events(spark, sf_dir, event_id=F.col("event_id")), 3))
    hits, _ = newest_page(view, ERRORS, 10, 20)
    return hits.select("timestamp", "source", F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"))


add(
    "store_newest_page",
    "select strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') as timestamp, event_type as source, event_id "
    f"from {EV} where event_type = 'error' order by ms desc limit 10 offset 20",
    store_newest_page,
)


def stored_documents(spark: SparkSession, sf_dir: str) -> View:
    """Documents as events of four indexes by language, with filters of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    event = F.to_json(F.struct(F.col("text").alias("message"), "lang", F.col("source").alias("from")))
    path = stored(spark, docs.select(event.alias("event")), template="docs-{{lang}}")
    store.index(spark, path)
    return store.read(spark, path)


table(
    "store_words",
    f"select lang, count(*) as count from {DOCS} where list_contains(t, 'licensed') and list_contains(t, 'apache') group by 1",
    BY_LANG,
    word("licensed", "message") & word("apache", "message"),
    stored_documents,
)
table(
    "store_absent_word",
    "select lang, count(*) as count from documents where false group by 1",
    BY_LANG,
    word("zzyzxnotthere"),
    stored_documents,
)


def store_files_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches for words open fewer bytes than they may: nowhere, and in one of the indexes."""
    view = stored_documents(spark, sf_dir)
    total = view.chosen.agg(F.sum("bytes")).first()[0]
    out = []
    for name, w, most in (("absent", "zzyzxnotthere", 0.25), ("present", "the", 1.0)):
        read = view.narrowed(F.lit(True), None, None, word(w).needs).chosen.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        out.append((name, read <= most * total))
    return spark.createDataFrame(out, "word string, within boolean")


add("store_files_opened", "select unnest(['absent', 'present']) as word, true as within", store_files_opened)

# promoted fields and the catalog


def half_promoted(spark: SparkSession, sf_dir: str) -> View:
    """Half of the events stored before their fields got columns, half after."""
    events = json_events(spark, sf_dir)
    early = F.get_json_object("event", "$.user_id").cast("long") % 2 == 0
    path = stored(spark, events.filter(early))
    store.promote(spark, path, ["value", "event_type", "props.k"])
    return store.read(spark, stored(spark, events.filter(~early), path=path))


def all_promoted(spark: SparkSession, sf_dir: str) -> View:
    path = work_path(spark, "store")
    store.promote(spark, path, ["value", "event_type", "props.k"])
    return store.read(spark, stored(spark, json_events(spark, sf_dir), path=path))


_promoted = (
    f"select event_type, cast(k as varchar) as props_k, count(*) as count, {r4('sum(value)')} as sum_value from {EV} "
    "where value >= 100 and value < 250.5 group by 1, 2"
)
for _name, _view in (("store_half_promoted", half_promoted), ("store_promoted", all_promoted)):
    table(
        _name,
        _promoted,
        lambda v: stats(v, [COUNT, Agg("sum", "value")], ["event_type", "props.k"]),
        DEAR & compare("value", "<", 250.5),
        _view,
    )


def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from the sketches of most files and the rows of those that came after."""
    events = json_events(spark, sf_dir)
    late = F.get_json_object("event", "$.user_id").cast("long") % 5 == 0
    path = stored(spark, events.filter(~late), 2)
    store.compact(spark, path)
    store.index(spark, path)
    return store.catalog(spark, stored(spark, events.filter(late), path=path))


_field = (
    "select '{0}' as path, '{1}' as kind, count({2}) as rows, count({2}) / (count(*) * 1.0::double) as coverage, "
    "cast({3} as bigint) as cardinality, {3} between 2 and 1000 as interesting from " + EV
)
add(
    "store_catalog",
    " union all ".join(
        _field.format(p, k, c, f"count(distinct {c})" if k == "string" else "0")
        for p, k, c in (("user_id", "number", "user_id"), ("event_type", "string", "event_type"), ("value", "number", "value"), ("props.k", "number", "k"))
    ),
    store_catalog,
)

# several indexes and environments


_made: dict[str, str] = {}  # stores that several queries of a session read


def scoped(spark: SparkSession, sf_dir: str) -> View:
    """Five indexes in each of two environments, and of one that searches pass over."""
    known = _made.get(sf_dir)
    if known and Folder(spark, known).files("_log"):
        return store.read(spark, known)
    third = F.get_json_object("raw", "$.user_id").cast("long") % 3
    env = F.when(third == 0, "default").when(third == 1, "test").otherwise("_own")
    path = stored(spark, json_events(spark, sf_dir), template="log-{{event_type}}", env=env)
    _made[sf_dir] = path
    return store.read(spark, path)


def by_index(view: View) -> DataFrame:
    return view.df.groupBy("env", "index").agg(F.count("*").alias("n"))


_env = "case user_id % 3 when 0 then 'default' when 1 then 'test' else '_own' end as env"
SCOPES: dict[str, tuple[dict, str]] = {
    "scope_all": ({}, "env <> '_own'"),
    "scope_hidden": ({"env": "_own"}, "env = '_own'"),
    "scope_pattern": ({"index": "*-?i*"}, "env <> '_own' and regexp_matches(event_type, '^.i')"),
    "scope_allowed": (
        {"allowed": [("test", "log-c*"), ("DEFAULT", "log-error"), ("*", "log-view")]},
        "env <> '_own' and (env = 'test' and event_type = 'click' or env = 'default' and event_type = 'error' or event_type = 'view')",
    ),
    "scope_allowed_none": ({"allowed": [("nosuch", "*")]}, "env = 'nosuch'"),
    "scope_days": ({"env": "test", "start_ms": T0 + DAY, "end_ms": T0 + 2 * DAY}, f"env = 'test' and ms between {T0 + DAY} and {T0 + 2 * DAY}"),
    "scope_listed": (
        {"explicit": [("default", "log-view", "2024-01-02"), ("test", "log-error", "2024-01-03"), ("test", "log-none", "2024-01-03")]},
        f"env = 'default' and event_type = 'view' and {day_of} = '2024-01-02' or env = 'test' and event_type = 'error' and {day_of} = '2024-01-03'",
    ),
}
for _name, (_scope, _where) in SCOPES.items():
    add(
        _name,
        f"select env, 'log-' || event_type as index, count(*) as n from (select *, {_env} from {EV}) where {_where} group by 1, 2",
        lambda s, d, scope=_scope: by_index(find(scoped(s, d), **scope)),
    )
add(
    "scope_filter_pattern",
    f"select env, 'log-' || event_type as index, count(*) as n from (select *, {_env} from {EV}) where env <> '_own' "
    "and event_type = 'view' and value >= 100 group by 1, 2",
    lambda s, d: by_index(find(scoped(s, d), Filter(lambda v: F.lit(True), ("log-V*",)) & DEAR)),
)
add(
    "scope_terms",
    "select field, value, n from (select *, row_number() over (partition by field order by n desc, value) as r from ("
    f"select 'index' as field, 'log-' || event_type as value, count(*) as n from (select *, {_env} from {EV}) where env <> '_own' group by 2 "
    f"union all select 'source', event_type, count(*) from (select *, {_env} from {EV}) where env <> '_own' group by 2 "
    f"union all select 'user_id', cast(user_id as varchar), count(*) from (select *, {_env} from {EV}) where env <> '_own' group by 2)) where r <= 3",
    lambda s, d: search.terms(find(scoped(s, d)), ["index", "source", "user_id"], 3),
)
_stored_day = f"(select *, {_env}, {day_of} as day from {EV})"
add(
    "store_partitions",
    f"select env, 'log-' || event_type as index, day, count(*) as rows, min(ms) as first_ms, max(ms) as last_ms, true as sized "
    f"from {_stored_day} group by 1, 2, 3",
    lambda s, d: store.partitions(s, scoped(s, d).path)
    .withColumns({"day": F.col("day").cast("string"), "sized": (F.col("bytes") > 0) & (F.col("files") > 0)})
    .drop("bytes", "files"),
)
add(
    "store_indexes",
    "select env, 'log-' || event_type as index, count(distinct day) as partitions, count(*) as rows, min(day) as first_day, "
    f"max(day) as last_day from {_stored_day} group by 1, 2",
    lambda s, d: store.indexes(s, scoped(s, d).path)
    .withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})
    .drop("bytes", "files"),
)


def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = store.totals(spark, scoped(spark, sf_dir).path)
    return spark.createDataFrame([(totals["partitions"], totals["files"] >= totals["partitions"], totals["bytes"] > 0)], "partitions long, files boolean, bytes boolean")


add(
    "store_totals",
    f"select count(*) as partitions, true as files, true as bytes from (select distinct env, event_type, day from {_stored_day})",
    store_totals,
)

# spoilt input: events of users whose number divides by seven are cut, and counted


def spoilt(line: Column, cut: str = "5") -> Column:
    return F.when(F.col("user_id") % 7 == 0, F.lit(cut)).otherwise(line)


def outcomes(found: DataFrame) -> DataFrame:
    return counted(found, bad=F.col("bad"), what=F.when(F.col("bad").isNull(), get("what")))


_outcomes = (
    "select case when user_id % 7 = 0 then 'record' end as bad, case when user_id % 7 > 0 then event_type end as what, "
    "count(*) as n from events group by 1, 2"
)
OTLP, STREAMS = ('{"resourceLogs":[{"scopeLogs":[{"logRecords":[', ",", "]}]}]}"), ('{"streams":[{"stream":{"app":"x"},"values":[', ",", "]}]}")
add("otlp_spoilt", _outcomes, lambda s, d: outcomes(envelopes.unpacked(bodies(s, d, spoilt(record()), *OTLP), "otlp")))
add("streams_spoilt", _outcomes, lambda s, d: outcomes(envelopes.unpacked(bodies(s, d, spoilt(entry()), *STREAMS), "streams")))
add(
    "bulk_spoilt",
    _outcomes,
    lambda s, d: outcomes(
        envelopes.unpacked(bodies(s, d, F.concat(F.lit('{"create":{}}\n'), spoilt(F.to_json(what()), "[1]"))), "bulk")
    ),
)


def json_documents_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of arrays, some with an element that isn't an object, some cut at the end: what is stored, and what is counted."""
    files = files_of(spark, sf_dir, spoilt(json_line()), "[", ", ", "]")
    cut = F.when(F.col("file").endswith("3"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    rows = shredded.rows(formats.parse(files.withColumn("value", cut), "json"), T0)
    outcome = store.append(rows, work_path(spark, "store"))
    return spark.createDataFrame(sorted(outcome.items()), "outcome string, n long")


add(
    "json_documents_spoilt",
    "select case when user_id % 10 = 3 or user_id % 7 = 0 then 'json' else 'stored' end as outcome, "
    "cast(count(*) filter (user_id % 10 <> 3) + count(distinct case when user_id % 10 = 3 then user_id end) as bigint) as n "
    "from events group by 1",
    json_documents_spoilt,
)

# binary telemetry: the same records in Protocol Buffers, made in Python, read back


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field_of(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def otlp_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body a user: records with a time and an attribute."""

    def one(records: list) -> bytes:
        out = b""
        for r in records:
            attribute = _field_of(1, b"what") + _field_of(2, _field_of(1, r["what"].encode()))
            time = _varint(telemetry.TIME << 3 | 1) + r["at"].to_bytes(8, "little")
            out += _field_of(telemetry.LOG_RECORDS, time + _field_of(telemetry.RECORD_ATTRIBUTES, attribute))
        return _field_of(telemetry.RESOURCE_LOGS, _field_of(telemetry.SCOPE_LOGS, out))

    def encode(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, 100):  # users
                bodies = [one(x) for x in b.column(0).slice(i, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    records = F.collect_list(F.struct(F.col("event_type").alias("what"), (ms * 1_000_000).alias("at"))).alias("records")
    by_user = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(records).select("records")
    found = envelopes.unpack(by_user.mapInArrow(encode, "body binary"), "otlp_binary")
    return counted(found, index=F.col("index"), what=get("what"), at=get("timestamp", "long"))


add(
    "otlp_binary",
    f"select 'main' as index, event_type as what, ms * 1000000 as at, count(*) as n from {EV} group by 1, 2, 3",
    otlp_binary,
)
add(
    "index_template",
    "select 'app-' || event_type || '-' || user_id || '-unknown' as index, count(*) as n from events group by 1",
    lambda s, d: counted(shredded.rows(json_events(s, d), T0, template="App-{{event_type}}-{{ user_id }}-{{props.none}}"), index=F.lower("index")),
)


# streams of growing files


def stream_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end in the middle of a line when the stream first reads them, and have grown when it reads them again."""
    folder, path, progress, state = (work_path(spark, x) for x in ("growing", "store", "progress", "state"))
    texts = files_of(spark, sf_dir, json_line(), tail="\n")

    def write(share: float):
        def run(rows) -> None:
            for r in rows:
                files, at = tailing.opened(f"{folder}/{r['file']}.ndjson")
                files.create_dir(at.rsplit("/", 1)[0])
                data = r["value"].encode()
                with files.open_output_stream(at) as f:  # the same file again, with more in it
                    f.write(data[: int(share * len(data))])

        return run

    for share in (0.4, 0.4, 1.0):
        texts.foreachPartition(write(share))
        lines = tailing.growing_files(spark, folder, state=state).select("value")
        ingest.ingest(lines, path, progress, trigger={"availableNow": True}, template="events").awaitTermination()
    return typed(store.read(spark, path).df.select(F.col("raw").alias("event")))


add("stream_growing", _by_type, stream_growing)


def stream_group_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with at least two errors in a day after a day with fewer, by a stream with a state for each user."""
    path, progress = work_path(spark, "alerts"), work_path(spark, "progress")
    by = {"user_id": lambda v: v.fields.text("user_id")}
    found = watch.group_alerts(stream_rows(spark, sf_dir), by, DAY, "gte", 2, predicate=ERRORS.predicate)
    watch.monitor_groups(found, path, progress, {"availableNow": True}).awaitTermination()
    return watch.alerts_of(spark, path, ["user_id"])


add(
    "stream_group_monitor",
    f"with e as (select user_id, ms - ms % {DAY} as w, count(*) filter (event_type = 'error') as n from {EV} group by 1, 2), "
    f"g as (select user_id, unnest(range(min(w), max(w) + 1, {DAY})) as w from e group by 1), "
    "c as (select user_id, w, coalesce(n, 0) as n from g left join e using (user_id, w)), "
    "a as (select *, n >= 2 and not coalesce(lag(n >= 2) over (partition by user_id order by w), false) as alert from c) "
    f"select cast(user_id as varchar) as user_id, w as window_ms, n from a where alert and w + {DAY} <= (select max(ms) from {EV})",
    stream_group_monitor,
)


def stream_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by hour from files that come in no order of time: each batch corrects the windows of those before."""
    path, progress = work_path(spark, "windows"), work_path(spark, "progress")
    lines = ingest.text_files(spark, lines_folder(spark, sf_dir), files_a_trigger=1)
    rows = shredded.good(shredded.rows(formats.ndjson(lines), T0))
    live.corrected_windows(rows, HOUR, 400 * DAY, path, progress, ERRORS.predicate, {"availableNow": True}).awaitTermination()
    return live.windows_of(spark, path).select("window_ms", "n")


add(
    "stream_corrections",
    f"select ms - ms % {HOUR} as window_ms, count(*) as n from {EV} where event_type = 'error' group by 1",
    stream_corrections,
)


def live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 errors after half of the events were stored and all of them came by a stream."""
    tail, half = live.LiveTail(100), F.get_json_object("event", "$.user_id").cast("long") % 2 == 0
    tail.backfill(store.read(spark, stored(spark, json_events(spark, sf_dir).filter(half))), ERRORS)
    tail.follow(stream_rows(spark, sf_dir), work_path(spark, "progress"), ERRORS, "400 days", {"availableNow": True}).awaitTermination()
    rows = spark.createDataFrame([(r["ts_ms"], r["raw"]) for r in tail.rows()], "ms long, raw string")
    return rows.select("ms", F.get_json_object("raw", "$.user_id").cast("long").alias("user_id"))


add("live_tail", f"select ms, user_id from {EV} where event_type = 'error' order by ms desc limit 100", live_tail)

# searches: highlights, intervals, time bounds, monitors


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits have each word that is to be highlighted in them."""
    search_ = (word("licensed", "message") | phrase("apache license", "message")) & ~word("thatble", "message") & ~word("en", "lang")
    hits = find(views.documents(spark, sf_dir), search_).df.select(F.lower("message").alias("m"))
    named = F.array(*(F.when(F.contains("m", F.lit(h)), F.lit(h)) for h in search_.highlights))
    return hits.select(F.explode(F.array_compact(named)).alias("highlight")).groupBy("highlight").agg(F.count("*").alias("n"))


_hits = (
    f"(select lower(text) as m from {DOCS} join (select doc_id, text from documents) using (doc_id) where lang <> 'en' and not list_contains(t, 'thatble') "
    "and (list_contains(t, 'licensed') or len(list_filter(range(1, len(t)), lambda i: t[i] = 'apache' and t[i + 1] = 'license')) > 0))"
)
add(
    "highlights",
    f"select h as highlight, count(*) as n from {_hits}, (select unnest(['licensed', 'apache license']) as h) where contains(m, h) group by 1",
    highlights,
)
add(
    "histogram_interval",
    f"select ms - ms % 5400000 as bucket_ms, count(*) as n from {EV} where ms between {T0 + 4 * DAY} and {T1 - 2 * DAY} group by 1",
    lambda s, d: search.histogram(
        find(views.events(s, d), None, time_bound("2024-01-05T01:00:00+01:00", T1), time_bound("-2d", T1)), interval_ms("90m")
    ).drop("bucket"),
)
add(
    "fields_without_terms",
    "select count(*) as count from events having count(*) > 0",
    lambda s, d: stats(find(views.events(s, d), ~word("2024*", "timestamp") & ~word("1", "dynamic") & ~compare("timestamp", ">", 0))).rows(),
)
add(
    "timechart_capped",
    f"select ms - ms % {DAY} as day_ms, cast(user_id as varchar) as user_id, count(*) as count from {EV} group by 1, 2",
    lambda s, d: timechart(views.events(s, d), DAY, [COUNT], ["user_id"])
    .rows()
    .withColumn("day_ms", F.unix_millis(F.to_timestamp("_time")))
    .drop("_time"),
)


def compressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files packed in two ways, told apart by their first bytes."""
    path = work_path(spark, "packed")
    lines = files_of(spark, sf_dir, json_line(), tail="\n").select("value")
    for codec, part in (("gzip", 0), ("none", 1)):
        some = lines.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == part)
        some.write.option("compression", codec).mode("append").text(path)
    return typed(formats.parse(formats.read_pieces(spark, path, but="_*")))


add("compressed_files", _by_type, compressed_files)


def monitor_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of errors under each comparison."""
    view = find(views.events(spark, sf_dir), ERRORS)
    found = [
        monitors.replay(view, c, 60, DAY, T0, T1).withColumn("comparison", F.lit(c)) for c in ("gt", "gte", "lt", "lte", "eq", "neq")
    ]
    return reduce(DataFrame.unionByName, found)


_daily = (
    f"(select g.b as w, coalesce(c.n, 0) as n from (select unnest(range({T0}, {T1} + 1, {DAY})) as b) g left join "
    f"(select ms - ms % {DAY} as b, count(*) as n from {EV} where event_type = 'error' group by 1) c using (b))"
)
add(
    "monitor_comparisons",
    " union all ".join(
        f"select w as window_ms, n, n {op} 60 as breached, n {op} 60 and not coalesce(lag(n {op} 60) over (order by w), false) as alert, "
        f"'{name}' as comparison from {_daily}"
        for name, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>"))
    ),
    monitor_comparisons,
)


def alert_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an alert on the last five days' errors says, and the hits it shows."""
    told = monitors.check(find(views.events(spark, sf_dir), ERRORS), "gt", 1, T1, 5 * DAY)
    rows = [(told["count"], told["title"], told["alert"], r["timestamp"], r["source"]) for r in told["evidence"]]
    return spark.createDataFrame(rows, "count long, title string, alert boolean, timestamp string, source string")


add(
    "alert_content",
    f"select (select count(*) from {EV} where event_type = 'error' and ms between {T1 - 5 * DAY} and {T1}) as count, 'count gt 1' as title, "
    "true as alert, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') as timestamp, event_type as source "
    f"from {EV} where event_type = 'error' and ms <= {T1} order by ms desc limit 5",
    alert_content,
)


# files in splits: the same input as files that several tasks read


def in_splits(spark: SparkSession, sf_dir: str, line: Column, head: str = "") -> DataFrame:
    """Lines of large files: many users' texts in each, read in the splits that Spark makes."""
    path = work_path(spark, "large")
    files_of(spark, sf_dir, line, head).select("value").coalesce(2).write.text(path)
    return formats.split_lines(spark, path)


add(
    "multiline_splits",
    "select event_type || chr(10) || '  at one.' || user_id || chr(10) || '  at two' as rest, count(*) as n from events group by 1",
    lambda s, d: counted(
        formats.multiline_of_splits(in_splits(s, d, trace()), r"^\d{4}-\d\d-\d\dT"), rest=F.regexp_replace(get("message"), r"^\S+ ", "")
    ),
)
add(
    "w3c_splits",
    "select strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') as timestamp, event_type as what, "
    f"case when user_id % 2 = 1 then 'odd' end as side, count(*) as n from {EV} group by 1, 2, 3",
    lambda s, d: counted(
        formats.w3c_of_splits(in_splits(s, d, w3c(), "#Version: 1.0\n#Fields: date time what side\n")),
        timestamp=get("timestamp"),
        what=get("what"),
        side=get("side"),
    ),
)


def csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one header each, with the cells of half of the users below it."""
    path = work_path(spark, "csv")
    part = F.pmod(F.xxhash64("file"), F.lit(2))
    texts = files_of(spark, sf_dir, csv()).groupBy(part.alias("part")).agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    texts.select("part", F.concat(F.lit("event_id,what,side\n"), "value")).write.partitionBy("part").text(path)
    events = formats.cells_of_splits(formats.split_lines(spark, path), ",").groupBy(get("what").alias("what"), get("side").alias("side"))
    return events.agg(F.sum(get("event_id", "long")).alias("ids"))


add(
    "csv_splits",
    "select event_type || ', \"quoted\"' as what, case when user_id % 2 = 0 then 'even' end as side, sum(event_id) as ids from events group by 1, 2",
    csv_splits,
)
