import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import discovery, monitors, search
from larkspur.operators.fields import LeafFields, View
from larkspur.operators.stats import Agg, stats, timechart, top
from larkspur.plans import filters
from larkspur.plans.filters import compare, everything, find, index, phrase, word
from larkspur.sources import events

COUNT = Agg("count")
TRIPS = [
    {"timestamp": "2025-03-08T06:00:00Z", "message": "ferry left harbour", "line": "north", "delay": 0},
    {"timestamp": "2025-03-08T06:20:00Z", "message": "signal-box flooded", "line": "south", "delay": 45},
    {"timestamp": "2025-03-08T06:40:00Z", "message": "ferry moored late", "line": "north", "delay": 12},
    {"timestamp": "2025-03-08T07:00:00Z", "message": "tram skipped two stops", "line": "south", "delay": 45},
    {"timestamp": "2025-03-08T07:20:00Z", "message": "ferry left quay", "line": "island", "delay": 3},
]
READINGS = [
    {"timestamp": 1_741_400_000 + i, "message": m, "level": v, "ok": i % 3 == 0, "drift": i + 0.25}
    for i, (m, v) in enumerate([("pump alarm", 7.5), ("alarms cleared", "low"), ("gauge 310 read", 31.0), ("gauge 3100 read", 2.0), ("idle", "n/k")])
]
BASKETS = [
    {"ts": 1_741_400_000, "msg": "p", "lines": [{"code": "fig-7", "count": 3, "cents": 120}, {"code": "plum", "count": 4}]},
    {"ts": 1_741_400_001, "msg": "q", "returns": [{"count": 9}]},
]


def view(spark, items, index="main", source=None):
    df = spark.createDataFrame([(json.dumps(x),) for x in items], "event string")
    return View(events.good(events.rows(df, 0, source, index)), LeafFields())


def hits(v, what, **k):
    return find(v, what, **k).df.count()


@pytest.mark.parametrize(
    ("what", "n"),
    [
        (everything(), 5), (word("north", "line"), 2), (word("NORTH", "line"), 2), (~word("north", "line"), 3), (compare("delay", ">=", 12), 3),
        (word("45", "delay"), 2), (word("signal", "message"), 1), (word("box"), 1), (word("ferry") & word("left"), 2), (phrase("ferry left"), 2),
        (phrase("left ferry"), 0), (word("moor*") | word("skip*"), 2), (word("nor*", "line"), 0), (word("1", "nosuch"), 0), (~word("1", "nosuch"), 5),
        (word("2025", "timestamp"), 0), (compare("line", ">", 1), 0), (compare("delay", "<", "x"), 0), (word("f?rry"), 3), (phrase("f?rry"), 0),
    ],
)
def test_trips(spark, what, n):
    assert hits(view(spark, TRIPS), what) == n


def test_tokens_and_types(spark):
    v = view(spark, READINGS)
    assert [hits(v, word(x, "message")) for x in ("alarm", "alarm*", "310")] == [1, 2, 1]
    assert [hits(v, word(x, f)) for f, x in (("level", "31"), ("level", "low"), ("ok", "true"), ("ok", "True"), ("drift", "0.25"))] == [1, 1, 2, 0, 1]
    assert [hits(v, compare("level", ">=", 7.5)), hits(v, ~compare("level", ">", 0))] == [2, 2]


def test_lists_and_last_segments(spark):
    v = view(spark, BASKETS)
    got = [hits(v, word(x, f)) for f, x in (("lines.count", "3"), ("lines.count", "4"), ("lines.cents", "120"), ("lines.count", "8"), ("lines.code", "fig-7"))]
    assert got == [1, 1, 1, 0, 1]
    assert [hits(v, word(x, f)) for f, x in (("count", "3"), ("count", "9"), ("lines.count", "9"))] == [1, 1, 0]
    assert hits(v, compare("lines.count", ">", 3)) == 0  # ranges see the first value only


def test_sources(spark):
    v = view(spark, [{"source": s, "message": "m"} for s in ("buoys/east.log.zst", "buoys/west.log.zst", "radio.txt")])
    assert [hits(v, w) for w in (word("*zst", "source"), word("*zst"), word("buoys/east.log.zst"), word("*txt"), word("*TXT"))] == [2, 2, 1, 1, 1]


def test_negation_is_complement(spark):
    v = view(spark, TRIPS + READINGS)
    for what in (word("north", "line"), compare("level", ">", 6), phrase("ferry left"), word("alarm*"), word("north", "line") | compare("delay", ">", 20)):
        assert hits(v, what) + hits(v, ~what) == len(TRIPS + READINGS)


def test_stats_over_leaves(spark):
    parcels = [
        {"timestamp": "2025-03-01T10:00:00Z", "message": "a", "van": "v1", "load.kilos": 40},
        {"timestamp": "2025-03-01T10:00:09Z", "message": "b", "van": "v1", "load.kilos": 60.5},
        {"timestamp": "2025-03-01T10:02:00Z", "message": "c", "van": "v2"},
        {"timestamp": "2025-03-01T10:03:00Z", "message": "d"},
    ]
    several = [COUNT, Agg("earliest", "timestamp"), Agg("latest", "timestamp"), Agg("sum", "load.kilos")]
    t = stats(view(spark, parcels), several, ["van"]).where("van", "!=", "—").sort("latest(timestamp)", descending=True)
    assert [tuple(r) for r in t.rows().collect()] == [
        ("v2", 1, "2025-03-01T10:02:00.000Z", "2025-03-01T10:02:00.000Z", None),
        ("v1", 2, "2025-03-01T10:00:00.000Z", "2025-03-01T10:00:09.000Z", 100.5),
    ]


def test_names_in_any_case(spark):
    v = view(spark, [{"Crew": "x", "n": 1, "Load": {"Tons": 2}}, {"crew": "x", "N": 2, "load": {"tons": 5}}, {"it's": "y", 'q"q': 3}])
    assert [tuple(r) for r in stats(v, [COUNT, Agg("sum", "N")], ["crew"]).rows().collect()] == [("x", 2, 3.0), ("—", 1, None)]
    assert [tuple(r) for r in stats(v, [Agg("max", "LOAD.TONS")]).rows().collect()] == [(5.0,)]
    assert [tuple(r) for r in stats(v, [Agg("sum", 'q"q')], ["It's"]).rows().collect()] == [("y", 3.0), ("—", None)]


def test_where_rules(spark):
    v = view(spark, TRIPS)
    rows = lambda t: [tuple(r) for r in t.rows().collect()]
    by = lambda f: stats(v, [COUNT], [f])
    assert rows(by("delay").where("delay", "=", 45)) == [] and rows(by("delay").where("delay", "=", "45")) == [("45", 2)]
    assert rows(by("line").where("line", "=", "ISLAND")) == [("island", 1)]
    assert rows(stats(v, [Agg("count", "line")])) == [(None,)] and rows(stats(find(v, word("nothing")), [COUNT])) == []
    assert rows(by("line").rename(count="n").keep(["n", "line"]).tail(1)) == [(2, "south")]
    assert rows(top(v, "delay", 1, rare=True)) == [("0", 1)] and rows(top(v, "line", 1)) == [("north", 2)]
    assert rows(stats(v, [Agg("avg", "delay")]).where("avg(delay)", "=", "21")) == [(21.0,)]
    with pytest.raises(ValueError):
        by("line").where("nosuch", ">", 1)
    with pytest.raises(ValueError):
        by("line").where("line", ">", "a")


def test_renaming(spark):
    t = stats(view(spark, TRIPS), [COUNT, Agg("sum", "delay")], ["line"])
    dropped = t.keep(["line", "count"]).renamed({"count": "sum(delay)"})
    assert dropped.names == ("line", "sum(delay)") and dropped.rows().first()[1] == 1
    swapped = t.renamed({"count": "sum(delay)", "sum(delay)": "count"})
    assert [tuple(r) for r in swapped.sort("count", descending=True).head(1).rows().collect()] == [("south", 2, 90.0)]
    with pytest.raises(ValueError):
        t.rename(line="count")


def test_timechart(spark):
    v = view(spark, [{"timestamp": f"2025-03-01T00:0{m}:0{s}Z", "message": "m", "dock": "d"} for m, s in ((0, 1), (0, 9), (3, 0))])
    assert [tuple(r) for r in timechart(v, 60_000, by=["dock"]).rows().collect()] == [("2025-03-01T00:00:00Z", "d", 2), ("2025-03-01T00:03:00Z", "d", 1)]
    with pytest.raises(ValueError):
        timechart(v, 60_000, cap=1)


def test_timechart_of_many_groups(spark):
    rows = spark.range(60_000).select((F.col("id") * 1000).alias("ts_ms"), F.lit("[]").alias("raw"))
    counts = timechart(View(rows, LeafFields()), 1000).rows()
    assert [tuple(r) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect()] == [(1, 60_000)]


def test_page_histogram_terms(spark):
    v = view(spark, TRIPS)
    assert [r["message"] for r in search.page(v, 2, 1).collect()] == ["tram skipped two stops", "ferry moored late"]
    assert len(search.page(v, 0).collect()) == 1
    start = events.epoch_ms("2025-03-08T06:00:00Z")
    end = start + 5_999_999
    counts = search.histogram(v, 1_200_000, start, end).orderBy("bucket_ms").collect()
    assert [r["n"] for r in counts] == [1, 1, 1, 1, 1]
    for limit, offset in ((2, 0), (2, 2), (9, 0)):
        found, both = search.search_histogram(v, 1_200_000, start, end, limit, offset)
        assert found.collect() == search.page(v, limit, offset).collect() and sorted(both.collect()) == sorted(counts)
    got = {(r["field"], r["value"], r["n"]) for r in search.terms(v, ["delay", "line"], 2).collect()}
    assert got == {("delay", "45", 2), ("delay", "0", 1), ("line", "north", 2), ("line", "south", 2)}
    with pytest.raises(ValueError):
        search.terms(v, ["message"])


def test_catalog(spark):
    got = {r["path"]: r for r in discovery.field_catalog(view(spark, TRIPS)).collect()}
    assert set(got) == {"line", "delay"}
    assert (got["line"]["coverage"], got["line"]["cardinality"], got["line"]["interesting"]) == (1.0, 3, True)
    assert (got["delay"]["cardinality"], got["delay"]["interesting"]) == (0, False)


def test_discovery(spark):
    v = view(spark, TRIPS * 4 + READINGS)
    got = {r["path"]: r for r in discovery.discover(v).collect()}
    assert set(got) == {"line", "delay", "level", "ok", "drift"}
    assert (got["line"]["cardinality"], got["line"]["groupable"], got["line"]["interesting"], got["line"]["examples"]) == (3, True, True, ["island", "north", "south"])
    assert got["level"]["kind"] == "mixed" and not got["level"]["groupable"] and got["ok"]["kind"] == "bool"
    assert [r["path"] for r in discovery.discover(v, top=1).collect()] == ["delay"]
    assert discovery.discover(v, sample=1).count() <= 3  # one row of each partition


def test_monitor_alerts_once(spark):
    v = view(spark, TRIPS)
    now = events.epoch_ms("2025-03-08T07:20:00Z")
    first = monitors.check(v, "gte", 2, now, 2_400_000)
    assert first["count"] == 3 and first["alert"] and not monitors.check(v, "gte", 2, now, 2_400_000, True)["alert"]
    assert [r["message"] for r in first["evidence"]] == ["ferry left quay", "tram skipped two stops", "ferry moored late"]
    start = events.epoch_ms("2025-03-08T06:00:00Z")
    rows = monitors.replay(v, "gte", 1, 1_200_000, start, start + 8_000_000).orderBy("window_ms").collect()
    assert [r["alert"] for r in rows] == [True, *[False] * 6] and [r["n"] for r in rows] == [1, 1, 1, 1, 1, 0, 0]


def test_permissions(spark):
    both = View(view(spark, TRIPS[:2], "web").df.unionAll(view(spark, TRIPS[2:3], "secret").df), LeafFields())
    assert hits(both, everything(), allowed=[("*", "web")]) == 2 and hits(both, everything(), index="sec*") == 1
    assert hits(both, index("sec*")) == 1 and hits(both, ~index("web")) == 0 and hits(both, index("web") | index("secret")) == 3


def test_shuffling_changes_nothing(spark):
    v = view(spark, TRIPS + READINGS)
    several = [COUNT, Agg("p95", "drift"), Agg("avg", "delay")]
    a = stats(v, several, ["line"]).rows().collect()
    assert a == stats(View(v.df.repartition(7, F.rand(3)), v.fields), several, ["line"]).rows().collect()


def test_time_windows_reach_the_scan(spark):
    from larkspur.sources import views

    v = find(views.events(spark, "/root/testdata/sf0.001"), start_ms=1_704_153_600_000, end_ms=1_704_239_999_999)
    plan = v.df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_views_as_sql_tables(spark):
    from larkspur.sources import views

    filters.register(views.events(spark, "/root/testdata/sf0.001"), "e")
    filters.register(view(spark, TRIPS), "t")
    assert spark.sql("FROM e |> WHERE event_type = 'click' |> AGGREGATE count(`props.k`) AS n").first()["n"] > 0
    assert spark.sql("SELECT count(*) AS n FROM t WHERE exists(leaves, x -> x.path = 'line' AND x.s = 'north')").first()["n"] == 2


def test_hits_and_buckets_from_one_scan(spark, tmp_path):
    random.seed(4)
    rows = [(random.randrange(5000), i, random.choice("ab")) for i in range(3000)]
    spark.createDataFrame(rows, "ts_ms long, seq long, source string").repartition(5).write.parquet(str(tmp_path / "t"))
    none = F.lit(None).cast("string")
    df = spark.read.parquet(str(tmp_path / "t")).withColumns({"env": F.lit("default"), "index": F.lit("i"), "day": F.to_date(F.timestamp_millis("ts_ms"))})
    view = View(df.withColumns({"message": none, "raw": none}), LeafFields())
    for what, limit, offset, window in ((None, 50, 0, (0, 4999)), (F.col("source") == "a", 7, 30, (900, 2100)), (F.lit(False), 5, 0, (0, 99)), (None, 5000, 3, (None, None))):
        v = view if what is None else view.where(what)
        hits, counts = search.search_histogram(v, 100, *window, limit=limit, offset=offset)
        found = v.where(search.in_window(v, *window))
        assert hits.collect() == search.page(found, limit, offset).collect()
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, search.histogram(v, 100, *window).collect()))
    assert hits._jdf.queryExecution().toString().count("FileScan") <= 3 and "InMemoryTableScan" in hits._jdf.queryExecution().toString()
