"""Log queries over the star-schema tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import TOKEN
from larkspur.functions.values import auto_interval, default_span, weight
from larkspur.operators import discovery, monitors, search
from larkspur.operators.fields import LeafFields, View
from larkspur.operators.stats import Agg, Table, stats, timechart, timechart_pivot, top
from larkspur.plans import filters
from larkspur.plans.filters import Filter, compare, find, index, phrase, word
from larkspur.sources import envelopes, formats, store, views
from larkspur.sources import events as shredded
from larkspur.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SECOND, HOUR, DAY = 1000, 3_600_000, 86_400_000
T0, T1 = 1_704_067_200_000, 1_706_659_199_999  # 2024-01-01 to the end of 2024-01-30
EV = (
    "(select event_id, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k, "
    "epoch_us(ts) // 1000 as ms from events)"
)
COUNT = Agg("count")


def r4(x: str) -> str:
    return f"sign({x}) * floor(abs({x}) * 10000 + 0.5) / 10000"


def plain_names(df: DataFrame) -> DataFrame:
    """`count(x)` becomes the column `count_x`."""
    return df.toDF(*(c.replace("(", "_").replace(")", "").replace(".", "_") for c in df.columns))


def add(name: str, sql: str | None, run: Query) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def table(
    name: str,
    sql: str,
    make: Callable[[View], Table],
    what: Filter | None = None,
    view: Callable[[SparkSession, str], View] = views.events,
    **scope,
) -> None:
    """Register a search and the table made of what it finds."""
    add(name, sql, lambda spark, sf_dir: plain_names(make(find(view(spark, sf_dir), what, **scope)).rows()))


def aggs(*names: str) -> list[Agg]:
    """`sum value`, `p95 value` and so on."""
    return [Agg(*x.split(" ")) for x in names]


def labelled(spark: SparkSession, sf_dir: str) -> View:
    return views.documents(spark, sf_dir, labels=True)


def events_view(spark: SparkSession, sf_dir: str, what: Filter | None = None, **scope) -> View:
    return find(views.events(spark, sf_dir), what, **scope)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one in a local session without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="larkspur-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


iso_s = "strftime(make_timestamp(({}) * 1000), '%Y-%m-%dT%H:%M:%SZ')"
iso_ms = "strftime(make_timestamp(({}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
USER = "cast(user_id as varchar) as user_id"
day_of = "strftime(make_timestamp(ms * 1000), '%Y-%m-%d')"

# aggregation and tables

table(
    "stats_count_by",
    "select event_type, count(*) as count from events group by 1",
    lambda v: stats(v, [COUNT], ["event_type"]),
)
table(
    "stats_multi_agg",
    f"select event_type, count(*) as count, {r4('sum(value)')} as sum_value, {r4('avg(value)')} as avg_value, "
    f"{r4('min(value)')} as min_value, {r4('max(value)')} as max_value from events group by 1",
    lambda v: stats(v, aggs("count", "sum value", "avg value", "min value", "max value"), ["event_type"]),
)
_q = "list_sort(list(value))[cast(floor((count(value) - 1) * {} + 0.5) as bigint) + 1]"
_ranks = ", ".join(f"{r4(_q.format(p))} as {n}_value" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
table(
    "stats_percentiles",
    f"select event_type, {_ranks} from events group by 1",
    lambda v: stats(v, aggs("p50 value", "p95 value", "p99 value"), ["event_type"]),
)
table(
    "stats_median_global",
    f"select count(*) as count, {r4(_q.format(0.5))} as p50_value, {r4('avg(value)')} as avg_value from events having count(*) > 0",
    lambda v: stats(v, aggs("count", "median value", "avg value")),
)
table(
    "stats_earliest_latest",
    f"select {USER}, {iso_ms.format('min(ms)')} as earliest_timestamp, {iso_ms.format('max(ms)')} as "
    f"latest_timestamp from {EV} group by 1",
    lambda v: stats(v, aggs("earliest timestamp", "latest timestamp"), ["user_id"]),
)
table(
    "stats_count_field",
    f"select {USER}, nullif(count(k), 0) as count_props_k, cast(null as bigint) as count_event_type from {EV} group by 1",
    lambda v: stats(v, aggs("count props.k", "count event_type"), ["user_id"]),
)
table(
    "stats_two_keys",
    f"select event_type, {USER}, count(*) as count, {r4('avg(k)')} as avg_props_k from {EV} group by 1, 2",
    lambda v: stats(v, aggs("count", "avg props.k"), ["event_type", "user_id"]),
)
table(
    "stats_missing_group",
    "select coalesce(cast(quality as varchar), '—') as quality, count(*) as count from documents left join labels "
    "using (doc_id) group by 1",
    lambda v: stats(v, [COUNT], ["quality"]),
    view=labelled,
)
table(
    "stats_global_empty",
    "select count(*) as count from events where event_type = 'nosuch' having count(*) > 0",
    lambda v: stats(v, [COUNT]),
    word("nosuch", "event_type"),
)
table(
    "stats_scan_cap",
    f"select event_type, count(*) as count from (select *, row_number() over (partition by {day_of} order by ms desc, event_id) as r "
    f"from {EV}) where r <= 100 group by 1",
    lambda v: stats(v, [COUNT], ["event_type"], scan_cap=100),
)
table(
    "timechart_1h",
    f"select {iso_s.format('ms - ms % 3600000')} as _time, count(*) as count from {EV} group by 1",
    lambda v: timechart(v, HOUR),
)
table(
    "timechart_by",
    f"select {iso_s.format('ms - ms % 3600000')} as _time, event_type, count(*) as count, {r4('avg(value)')} as "
    f"avg_value from {EV} group by 1, 2",
    lambda v: timechart(v, HOUR, aggs("count", "avg value"), ["event_type"]),
)
table(
    "timechart_subsecond",
    f"select {iso_ms.format('ms - ms % 500')} as _time, count(*) as count from {EV} group by 1",
    lambda v: timechart(v, 500, cap=None),
)
table(
    "timechart_auto",
    f"select {iso_s.format('ms - ms % 43200000')} as _time, count(*) as count from {EV} where ms between {T0} and {T1} group by 1",
    lambda v: timechart(v, default_span(T0, T1)),
    start_ms=T0,
    end_ms=T1,
)
table("top_users", f"select {USER}, count(*) as count from events group by 1 order by 2 desc, 1 limit 5", lambda v: top(v, "user_id", 5))
table(
    "rare_users",
    f"select {USER}, count(*) as count from events group by 1 order by 2, 1 limit 5",
    lambda v: top(v, "user_id", 5, rare=True),
)
table(
    "where_rename_fields",
    f"select {USER}, count(*) as n from events group by 1 having count(*) > 5",
    lambda v: stats(v, aggs("count", "avg value"), ["user_id"]).where("count", ">", 5).rename(count="n").keep(["user_id", "n"]),
)
table(
    "rename_swap",
    f"select event_type as sum_value, {r4('max(value)')} as count from events group by 1 having count(*) > 5",
    lambda v: stats(v, aggs("count", "max value"), ["event_type"])
    .where("count", ">", 5)
    .keep(["event_type", "max(value)"])
    .renamed({"event_type": "sum(value)", "max(value)": "count"}),
)
table(
    "fields_minus",
    f"select {USER}, {r4('max(value)')} as max_value from events group by 1",
    lambda v: stats(v, aggs("count", "max value"), ["user_id"]).drop(["count"]),
)
table(
    "where_string_ci",
    "select event_type, count(*) as count from events where lower(event_type) = 'error' group by 1",
    lambda v: stats(v, [COUNT], ["event_type"]).where("event_type", "=", "ERROR"),
)
table(
    "where_not_equal",
    "select event_type, count(*) as count from events where event_type <> 'error' group by 1",
    lambda v: stats(v, [COUNT], ["event_type"]).where("event_type", "!=", "error"),
)
table(
    "where_num_vs_string",
    f"select {USER}, count(*) as count from events where false group by 1",
    lambda v: stats(v, [COUNT], ["user_id"]).where("user_id", "=", 8),
)
table(
    "where_text_vs_number",
    f"select {USER}, {r4('sum(k)')} as sum_props_k from {EV} group by 1 having sum(k) = (select max(s) from (select "
    f"sum(k) as s from {EV} where user_id < 9 group by user_id))",
    lambda v: _sums_like_the_largest(v),
)
table(
    "sort_tail",
    f"select {USER}, count(*) as count from events group by 1 order by 2 desc, 1 desc limit 3",
    lambda v: stats(v, [COUNT], ["user_id"]).sort("count").tail(3),
)
table(
    "sort_two_columns",
    f"select {USER}, count(*) as count, {r4('avg(value)')} as avg_value from events group by 1 order by 2 desc, 3, 1 limit 7",
    lambda v: stats(v, aggs("count", "avg value"), ["user_id"]).sort("avg(value)").sort("count", descending=True).head(7),
)
table(
    "flagship",
    f"select {USER}, count(*) as count, {r4('avg(value)')} as avg_value from events where event_type = 'error' "
    "group by 1 order by 2 desc, 1 limit 10",
    lambda v: stats(v, aggs("count", "avg value"), ["user_id"]).sort("count", descending=True).head(10),
    word("error", "event_type"),
)


def _sums_like_the_largest(v: View) -> Table:
    """A text compared with a column of doubles: whole ones have no decimals."""
    t = stats(v, aggs("sum props.k"), ["user_id"])
    largest = stats(find(v, compare("user_id", "<", 9)), aggs("sum props.k"), ["user_id"]).df.agg(F.max("`sum(props.k)`")).first()[0]
    return t.where("sum(props.k)", "=", str(int(largest or 0)))


# filters

TWO_TYPES = word("error", "event_type") | word("click", "event_type")
DEAR = compare("value", ">=", 100)
BY_TYPE = lambda v: stats(v, [COUNT], ["event_type"])
BY_LANG = lambda v: stats(v, [COUNT], ["lang"])
table(
    "filter_bool_logic",
    "select count(*) as count from events where (event_type in ('error', 'click')) and user_id <> 8 having count(*) > 0",
    stats,
    TWO_TYPES & ~word("8", "user_id"),
)
table(
    "filter_not_missing",
    "select source, count(*) as count from documents left join labels using (doc_id) where not coalesce(quality = 1, false) group by 1",
    lambda v: stats(v, [COUNT], ["source"]),
    ~word("1", "quality"),
    labelled,
)
table(
    "filter_range",
    f"select count(*) as count, {r4('sum(value)')} as sum_value from events where value >= 100 and value < 200 having count(*) > 0",
    lambda v: stats(v, aggs("count", "sum value")),
    DEAR & compare("value", "<", 200),
)
table("filter_leaf", f"select event_type, count(*) as count from {EV} where k = 69 group by 1", BY_TYPE, word("69", "k"))
table("filter_dotted", f"select event_type, count(*) as count from {EV} where k = 69 group by 1", BY_TYPE, word("69", "props.k"))
table(
    "filter_source",
    "select event_type, count(*) as count from events where regexp_matches(lower(event_type), '^.*r.*e?$') group by 1",
    BY_TYPE,
    word("*R*", "source"),
)
table(
    "filter_index_pattern",
    "select count(*) as count from events where lower(event_type) = 'error' having count(*) > 0",
    stats,
    index("ev*") & word("error"),
)
table(
    "time_window",
    f"select event_type, count(*) as count from {EV} where ms between {T0 + DAY} and {T0 + 3 * DAY} group by 1",
    BY_TYPE,
    start_ms=T0 + DAY,
    end_ms=T0 + 3 * DAY,
)
table(
    "filter_partitions",
    f"select event_type, count(*) as count from {EV} where {day_of} in ('2024-01-02', '2024-01-05') group by 1",
    BY_TYPE,
    explicit=search.listed("default/events/2024-01-02, default/events/2024-01-05"),
)
_token_parts = (
    "case when regexp_matches(m, '[_.-]') then list_concat([m], list_filter(regexp_split_to_array(m, '[_.-]'), "
    "lambda x: x <> '' and length(x) <> length(m))) else [m] end"
)
_tokens = f"list_transform(regexp_extract_all(lower(text), '{TOKEN}'), lambda m: {_token_parts})"
DOCS = f"(select doc_id, lang, source, flatten({_tokens}) as t from documents)"
table(
    "filter_token",
    f"select lang, count(*) as count from {DOCS} where list_contains(t, 'thatble') group by 1",
    BY_LANG,
    word("thatble", "message"),
    views.documents,
)
table(
    "filter_two_tokens",
    f"select lang, count(*) as count from {DOCS} where list_contains(t, 'licensed') and list_contains(t, 'apache') group by 1",
    BY_LANG,
    word("licensed", "message") & word("apache", "message"),
    views.documents,
)
table(
    "filter_phrase",
    f"select source, count(*) as count from {DOCS} where len(list_filter(range(1, len(t)), lambda i: t[i] = "
    "'apache' and t[i + 1] = 'license')) > 0 group by 1",
    lambda v: stats(v, [COUNT], ["source"]),
    phrase("apache license", "message"),
    views.documents,
)
table(
    "filter_glob",
    f"select lang, count(*) as count from {DOCS} where lang <> 'en' and len(list_filter(t, lambda x: "
    "regexp_matches(x, '^licens.*$'))) > 0 group by 1",
    BY_LANG,
    word("licens*", "message") & ~word("en", "lang"),
    views.documents,
)
table(
    "filter_roles",
    f"select role as source, count(*) as count, {r4('max(cast(turn as double))')} as max_turn from conversations "
    "where lower(role) = 'user' group by 1",
    lambda v: stats(v, aggs("count", "max turn"), ["source"]),
    word("USER", "source"),
    views.conversations,
)


def sql_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a piped query of Spark SQL over a registered view."""
    filters.register(views.events(spark, sf_dir), "larkspur_events")
    return spark.sql(
        "FROM larkspur_events |> WHERE event_type = 'error' |> AGGREGATE count(*) AS count GROUP BY CAST(user_id AS string) AS user_id "
        "|> ORDER BY count DESC, user_id |> LIMIT 10"
    )


add(
    "sql_pipes",
    f"select {USER}, count(*) as count from events where event_type = 'error' group by 1 order by 2 desc, 1 limit 10",
    sql_pipes,
)

# searches

add(
    "search_page",
    "select strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') as timestamp, event_type as source, "
    f"'events/' || {day_of} as partition, "
    f"event_id as seq, cast(0 as double) as score from {EV} where event_type = 'error' order by ms desc, event_id limit 10 offset 20",
    lambda s, d: search.page(events_view(s, d, word("error", "event_type")), 10, 20).drop("raw", "message"),
)
add(
    "partition_list",
    f"select distinct 'default' as env, 'events' as index, {day_of} as day from {EV}",
    lambda s, d: search.partition_list(events_view(s, d)).select("env", "index", F.col("day").cast("string").alias("day")),
)


def filled(span: int, where: str) -> str:
    """Counts of all buckets of the window."""
    return (
        f"select g.b as bucket_ms, {iso_s.format('g.b')} as bucket, coalesce(c.n, 0) as n from (select "
        f"unnest(range({T0 // span * span}, {T1} + 1, {span})) as b) g "
        f"left join (select ms - ms % {span} as b, count(*) as n from {EV} where ms between {T0} and {T1} and {where} "
        "group by 1) c using (b)"
    )


PURCHASES = word("purchase", "event_type")
add(
    "histogram_fill",
    filled(HOUR, "event_type = 'purchase' and user_id < 20"),
    lambda s, d: search.histogram(events_view(s, d, PURCHASES & compare("user_id", "<", 20)), HOUR, T0, T1),
)
add(
    "histogram_auto",
    filled(11 * HOUR, "event_type = 'purchase'"),
    lambda s, d: search.histogram(events_view(s, d, PURCHASES), auto_interval(T0, T1), T0, T1),
)
add(
    "histogram_open",
    f"select ms - ms % {DAY} as bucket_ms, {iso_s.format(f'ms - ms % {DAY}')} as bucket, count(*) as n from {EV} "
    "where event_type = 'purchase' group by 1, 2",
    lambda s, d: search.histogram(events_view(s, d, PURCHASES), DAY),
)


def search_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets and, beside each, how many of the newest 100 hits lie in it."""
    hits, counts = search.search_histogram(events_view(spark, sf_dir, word("view", "event_type")), DAY, T0, T1, 100)
    at = F.floor(F.unix_millis(F.to_timestamp("timestamp")) / DAY) * DAY
    hits = hits.select(at.alias("bucket_ms")).groupBy("bucket_ms").agg(F.count("*").alias("hits"))
    return counts.join(hits, "bucket_ms", "left").select("bucket_ms", "n", F.coalesce("hits", F.lit(0)).alias("hits"))


add(
    "search_histogram",
    f"with v as (select ms, event_id from {EV} where event_type = 'view' and ms between {T0} and {T1}), "
    f"h as (select ms - ms % {DAY} as b, count(*) as hits from (select * from v order by ms desc, event_id limit 100) group by 1), "
    f"c as (select ms - ms % {DAY} as b, count(*) as n from v group by 1) "
    f"select g.b as bucket_ms, coalesce(n, 0) as n, coalesce(hits, 0) as hits from (select unnest(range({T0}, {T1} "
    f"+ 1, {DAY})) as b) g "
    "left join c using (b) left join h using (b)",
    search_histogram,
)
_best = "select field, value, n from (select *, row_number() over (partition by field order by n desc, value) as r from ({})) where r <= 5"
_values = (
    "select 'event_type' as field, event_type as value, {0} from {1} group by 2 "
    "union all select 'user_id', cast(user_id as varchar), {0} from {1} group by 2"
)
add(
    "terms_multi",
    _best.format(_values.format("count(*) as n", "events")),
    lambda s, d: search.terms(events_view(s, d), ["event_type", "user_id"], 5),
)
_day = f"(select *, {day_of} as day from {EV})"
_days = (
    "(select day from (select day, row_number() over (order by day desc) as r, count(*) over () as c from (select "
    f"distinct day from {_day})) "
    "where (r - 1) % cast(ceil(c / 8.0) as bigint) = 0)"
)
_ratio = f"((select count(distinct day) from {_day}) * 1.0::double / (select count(*) from {_days}))"
_sampled = " union all ".join(
    f"select '{f}' as field, v as value, cast(sum(floor(c * {_ratio} + 0.5)) as bigint) as n from (select day, "
    f"cast({f} as varchar) as v, count(*) as c "
    f"from {_day} where day in {_days} group by 1, 2) group by 2"
    for f in ("event_type", "user_id")
)
add("terms_sampled", _best.format(_sampled), lambda s, d: search.terms_sampled(events_view(s, d), ["event_type", "user_id"], 5, 8))
add(
    "terms_index",
    "select 'index' as field, 'events' as value, count(*) as n from events having count(*) > 0",
    lambda s, d: search.terms(events_view(s, d), ["index"]),
)
KINDS = ("click", "error", "purchase", "signup", "view")
_wide = ", ".join(f"count(*) filter (event_type = '{k}') as \"{k}\"" for k in KINDS)
add(
    "timechart_pivot",
    f"select {iso_s.format(f'ms - ms % {DAY}')} as _time, {_wide} from {EV} group by 1",
    lambda s, d: timechart_pivot(timechart(events_view(s, d), DAY, [COUNT], ["event_type"]), "event_type"),
)


def predicates(view: View, **named: Filter) -> dict[str, Column]:
    return {n: f.predicate(view) for n, f in named.items()}


ERRORS = word("error", "event_type")
add(
    "multi_series",
    f"select ms - ms % {HOUR} as bucket_ms, count(*) filter (event_type = 'error') as errors, count(*) filter "
    f"(value > 100) as dear from {EV} "
    "where event_type = 'error' or value > 100 group by 1",
    lambda s, d: search.series(v := views.events(s, d), HOUR, predicates(v, errors=ERRORS, dear=compare("value", ">", 100))),
)
add(
    "stat_totals",
    "select count(*) filter (event_type = 'error') as errors, count(*) filter (event_type <> 'error') as others from events",
    lambda s, d: search.totals(v := views.events(s, d), predicates(v, errors=ERRORS, others=~ERRORS)),
)

# discovery

_cat = (
    "select '{0}' as path, '{1}' as kind, count({2}) as rows, count({2}) / (count(*) * 1.0::double) as coverage, "
    "cast({3} as bigint) as cardinality, {3} between 2 and 1000 as interesting from " + EV
)
FIELDS = (
    ("event_id", "number", "event_id"),
    ("user_id", "number", "user_id"),
    ("event_type", "string", "event_type"),
    ("value", "number", "value"),
    ("props.k", "number", "k"),
)
add(
    "field_catalog",
    " union all ".join(_cat.format(p, k, c, f"count(distinct {c})" if k == "string" else "0") for p, k, c in FIELDS),
    lambda s, d: discovery.field_catalog(events_view(s, d)),
)
_newest = (
    f"(select * from (select *, row_number() over (partition by day order by ms desc, event_id) as r from {_day}) "
    f"where r <= cast(ceil({discovery.SAMPLE} * 1.0 / (select count(distinct day) from {_day})) as bigint))"
)
_seen = " union all ".join(
    f"select '{p}' as path, '{k}' as kind, count({c}) as hits, least(count(distinct {c}), 1000) as cardinality, "
    f"count(distinct {c}) >= 1000 as capped, "
    f"count(*) as rows from {_newest}"
    for (p, _, c), k in zip(FIELDS, ("int", "int", "string", "float", "int"))
)
_fit = "not capped and cardinality >= 2 and hits / rows >= 0.05 and hits / cardinality >= 3"
add(
    "field_discovery",
    f"select path, kind, hits / (rows * 1.0::double) as coverage, cardinality, capped, {_fit} as groupable, "
    f"{_fit} and hits / rows >= 0.5 and cardinality <= 20 as interesting, round(hits / (rows * 1.0::double) * ln(1 "
    f"+ cardinality), 6) as score from ({_seen})",
    lambda s, d: discovery.discover(events_view(s, d)).withColumn("score", F.round("score", 6)).drop("examples"),
)
add(
    "partition_info",
    "select 'default' as env, 'events' as index, day, count(*) as rows, min(ms) as first_ms, max(ms) as last_ms "
    f"from {_day} group by day",
    lambda s, d: discovery.partition_info(events_view(s, d)).withColumn("day", F.col("day").cast("string")),
)
add(
    "index_info",
    "select 'default' as env, 'events' as index, count(*) as rows, count(distinct day) as partitions, min(day) as "
    "first_day, max(day) as last_day "
    f"from {_day}",
    lambda s, d: discovery.index_info(events_view(s, d)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")}),
)
_hourly = (
    f"(select g.b as w, coalesce(c.n, 0) as n from (select unnest(range({T0}, {T1} + 1, {HOUR})) as b) g left join "
    f"(select ms - ms % {HOUR} as b, count(*) as n from {EV} where event_type = 'error' and ms between {T0} and "
    f"{T1} group by 1) c using (b))"
)
add(
    "threshold_monitor",
    f"select w as window_ms, n, n > 3 as breached, n > 3 and not coalesce(lag(n > 3) over (order by w), false) as alert from {_hourly}",
    lambda s, d: monitors.replay(events_view(s, d, ERRORS), "gt", 3, HOUR, T0, T1),
)


def rows_of(view: View) -> DataFrame:
    return view.df.agg(F.count("*").alias("n"))


add("allow_list", "select count(*) as n from events", lambda s, d: rows_of(events_view(s, d, allowed=[("default", "ev*")])))
add(
    "allow_list_denied",
    "select count(*) as n from events where false",
    lambda s, d: rows_of(events_view(s, d, allowed=[("default", "doc*")])),
)

# the store: events as JSON lines, shredded into rows with leaves, stored and read back


def ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def stamp() -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_events(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    fields = [stamp().alias("timestamp"), F.col("event_type").alias("source"), "event_type", "user_id", "value"]
    fields += [F.from_json("props", "k long").alias("props"), *(c.alias(n) for n, c in more.items())]
    # the table is one small file; its events are dealt out, as Python works on them
    dealt = events_table(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return dealt.select(F.to_json(F.struct(*fields)).alias("event"))


def stored(spark: SparkSession, events: DataFrame, appends: int = 1, path: str | None = None, **options) -> str:
    """A new store with these events, in so many appends."""
    path = path or work_path(spark, "store")
    rows = shredded.rows(events, T0, **{"template": "events", **options})
    for i in range(appends):
        store.append(rows.filter(F.pmod("seq", F.lit(appends)) == i) if appends > 1 else rows, path)
    return path


def ingested(spark: SparkSession, sf_dir: str) -> View:
    return store.read(spark, stored(spark, json_events(spark, sf_dir)))


table(
    "ingest_stats",
    f"select event_type, count(*) as count, {r4('sum(value)')} as sum_value from events group by 1",
    lambda v: stats(v, aggs("count", "sum value"), ["event_type"]),
    view=ingested,
)
table(
    "ingest_leaf",
    f"select event_type, count(*) as count from {EV} where k = 69 and value >= 100 group by 1",
    BY_TYPE,
    word("69", "k") & DEAR,
    ingested,
)
table(
    "ingest_timechart",
    f"select {iso_s.format(f'ms - ms % {DAY}')} as _time, coalesce(cast(k as varchar), '—') as props_k, count(*) as "
    f"count from {EV} where event_type = 'view' group by 1, 2",
    lambda v: timechart(v, DAY, [COUNT], ["props.k"]),
    word("view", "source"),
    ingested,
)


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest errors' events, read out of the hits."""
    hits = search.with_event(search.page(find(ingested(spark, sf_dir), ERRORS), 20))
    of = lambda path, name: F.variant_get("event", path, "long").alias(name)
    return hits.select("timestamp", of("$.user_id", "user_id"), of("$.props.k", "k"))


add(
    "page_events",
    "select strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') as timestamp, user_id, k "
    f"from {EV} where event_type = 'error' order by ms desc limit 20",
    page_events,
)
add(
    "alert_weights",
    "select case event_type when 'error' then 'high' when 'view' then 'medium' else 'low' end as weight, count(*) as n "
    "from events group by 1",
    lambda s, d: counted(events_table(s, d), weight=weight(F.replace("event_type", F.lit("view"), F.lit(" Warning")))),
)


def of_any_case(spark: SparkSession, sf_dir: str) -> View:
    """Events with a flag and a nested name in capitals."""
    more = {"ok": F.col("event_id") % 2 == 0, "Place": F.struct(F.col("user_id").alias("Shard"))}
    return View(shredded.good(shredded.rows(json_events(spark, sf_dir, **more), T0)), LeafFields())


table(
    "ingest_flags",
    "select cast(user_id as varchar) as place_shard, count(*) as count from events where event_id % 2 = 0 group by 1",
    lambda v: stats(v, [COUNT], ["place.shard"]),
    word("true", "ok"),
    of_any_case,
)


def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six appends, compacted and cleaned: the same rows in one file a day."""
    path = stored(spark, json_events(spark, sf_dir), 6)
    store.compact(spark, path)
    store.clean(spark, path, grace_s=0)
    figures = spark.createDataFrame([(str(d), n) for _, _, d, n, _ in store.partition_figures(spark, path)], "day string, files long")
    rows = store.read(spark, path).df.groupBy(F.col("day").cast("string").alias("day"))
    return rows.agg(F.count("*").alias("n")).join(figures, "day")


add("store_compaction", f"select day, count(*) as n, cast(1 as bigint) as files from {_day} group by 1", store_compaction)


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the days when a week is kept on 2024-01-31."""
    path = stored(spark, json_events(spark, sf_dir))
    store.retain(spark, path, date(2024, 1, 31), 7)
    return store.read(spark, path).df.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


add("retention", f"select day, count(*) as n from {_day} where day >= '2024-01-24' group by 1", retention)


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some cut in the middle and some for an index that no folder can have, and what became of each."""
    cut = F.when(F.col("event").contains('"view"'), F.substring("event", 1, 30)).otherwise(F.col("event"))
    rows = shredded.rows(json_events(spark, sf_dir).select(cut.alias("event")), T0)
    rows = rows.withColumn("index", F.when(F.col("source") == "signup", F.lit("no/folder")).otherwise(F.col("index")))
    outcome = store.append(rows, work_path(spark, "store"))
    return spark.createDataFrame(sorted(outcome.items()), "outcome string, n long")


add(
    "ingest_rejects",
    "select case event_type when 'view' then 'json' when 'signup' then 'name' else 'stored' end as outcome, "
    "count(*) as n from events group by 1",
    ingest_rejects,
)

# wire formats: a table rendered in the format, read back, and counted


def user_file() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")


def files_of(spark: SparkSession, sf_dir: str, line: Column, head: str = "", sep: str = "\n", tail: str = "") -> DataFrame:
    """(file, value): the events' lines, one file a user, in the order of the events."""
    numbered = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    texts = events_table(spark, sf_dir).groupBy(user_file()).agg(numbered.alias("l"))
    return texts.select("file", F.concat(F.lit(head), F.array_join("l.line", sep), F.lit(tail)).alias("value"))


def get(name: str, kind: str = "string") -> Column:
    return F.get_json_object("event", f"$['{name}']").cast(kind)


def counted(events: DataFrame, **by: Column) -> DataFrame:
    return events.groupBy(*(c.alias(n) for n, c in by.items())).agg(F.count("*").alias("n"))


def text_of(*parts: str | Column) -> Column:
    return F.concat(*((F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p)) if isinstance(p, str) else p for p in parts))


def json_line() -> Column:
    return F.to_json(F.struct("event_type", "user_id", "event_id"))


_by_type = "select event_type, count(*) as n, sum(event_id) as ids from events group by 1"


def typed(events: DataFrame) -> DataFrame:
    return events.groupBy(get("event_type").alias("event_type")).agg(F.count("*").alias("n"), F.sum(get("event_id", "long")).alias("ids"))


add("ndjson_lines", _by_type, lambda s, d: typed(formats.parse(files_of(s, d, F.concat(json_line(), F.lit("  "))), "ndjson")))
add("json_documents", _by_type, lambda s, d: typed(formats.parse(files_of(s, d, json_line(), "[", ", ", "]"), "json")))
add(
    "text_lines",
    "select length(m) % 100 as size, count(*) as n from (select rtrim(unnest(string_split(text, chr(10))), chr(13) "
    "|| chr(9) || ' ') as m from documents) where m <> '' group by 1",
    lambda s, d: counted(
        formats.text(s.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("value"))),
        size=F.length(get("message")).cast("long") % 100,
    ),
)


def trace() -> Column:
    return text_of(stamp(), " ", "$event_type", "\n  at one.", "$user_id", "\n  at two")


add(
    "multiline_records",
    "select event_type || chr(10) || '  at one.' || user_id || chr(10) || '  at two' as rest, count(*) as n from events group by 1",
    lambda s, d: counted(
        formats.parse(files_of(s, d, trace()), "text", start=r"^\d{4}-\d\d-\d\dT"), rest=F.regexp_replace(get("message"), r"^\S+ ", "")
    ),
)


def syslog() -> Column:
    return text_of("<", (F.col("event_id") % 192).cast("string"), ">1 ", stamp(), " host app ", "$user_id", " - - did ", "$event_type")


add(
    "syslog_lines",
    "select event_id % 192 // 8 as facility, event_id % 192 % 8 as severity, 'did ' || event_type as message, "
    "count(*) as n from events group by 1, 2, 3",
    lambda s, d: counted(
        formats.parse(files_of(s, d, syslog()), "syslog"),
        facility=get("facility", "long"),
        severity=get("severity", "long"),
        message=get("message"),
    ),
)


def csv() -> Column:
    return text_of("$event_id", ',"', "$event_type", ', ""quoted""",', F.when(F.col("user_id") % 2 == 0, "even").otherwise(""))


add(
    "csv_files",
    "select event_type || ', \"quoted\"' as what, case when user_id % 2 = 0 then 'even' end as side, sum(event_id) "
    "as ids from events group by 1, 2",
    lambda s, d: formats.parse(files_of(s, d, csv(), "event_id,what,side\n"), "csv")
    .groupBy(get("what").alias("what"), get("side").alias("side"))
    .agg(F.sum(get("event_id", "long")).alias("ids")),
)


def cef() -> Column:
    head = ("CEF:0|shop|", "$event_type", "|1.0|", "$user_id", r"|a \| b|5|src=10.0.0.", "$user_id")
    return text_of(*head, " note=two words rt=", ms().cast("string"))


add(
    "cef_lines",
    f"select event_type as product, 'a | b' as message, 'two words' as note, cast(ms // {DAY} as bigint) as day, "
    f"count(*) as n from {EV} group by 1, 2, 3, 4",
    lambda s, d: counted(
        formats.parse(files_of(s, d, cef()), "cef"),
        product=get("device_product"),
        message=get("message"),
        note=get("note"),
        day=F.floor(get("timestamp", "long") / DAY),
    ),
)


def w3c() -> Column:
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return text_of(when, " ", "$event_type", " ", F.when(F.col("user_id") % 2 == 0, "-").otherwise("odd"))


add(
    "w3c_files",
    "select strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') as timestamp, event_type as what, "
    "case when user_id % 2 = 1 then 'odd' end as side, "
    f"count(*) as n from {EV} group by 1, 2, 3",
    lambda s, d: counted(
        formats.parse(files_of(s, d, w3c(), "#Version: 1.0\n#Fields: date time what side\n"), "w3c"),
        timestamp=get("timestamp"),
        what=get("what"),
        side=get("side"),
    ),
)


def logfmt() -> Column:
    return text_of("level=", "$event_type", ' msg="user ', "$user_id", ' did it" n=', "$event_id")


add(
    "logfmt_lines",
    "select event_type as level, 'user ' || user_id || ' did it' as msg, count(*) as n from events group by 1, 2",
    lambda s, d: counted(formats.parse(files_of(s, d, logfmt()), "logfmt"), level=get("level"), msg=get("msg")),
)


def access() -> Column:
    when = F.date_format(F.col("ts").cast("timestamp"), " '['dd/MMM/yyyy:HH:mm:ss +0000']'")
    outcome = F.when(F.col("event_type") == "error", "500 -").otherwise("200 17")
    return text_of("10.0.0.7 - u", "$user_id", when, ' "GET /', "$event_type", ' HTTP/1.1" ', outcome, ' "-" "agent one"')


add(
    "access_log",
    "select 'u' || user_id as auth, '/' || event_type as request, case when event_type = 'error' then '500' else "
    "'200' end as response, "
    "case when event_type <> 'error' then '17' end as bytes, 'agent one' as agent, count(*) as n from events group by 1, 2, 3, 4",
    lambda s, d: counted(
        formats.parse(files_of(s, d, access()), "grok", pattern="combined_log"),
        **{x: get(x) for x in ("auth", "request", "response", "bytes", "agent")},
    ),
)


def grok_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls taken apart by a grok expression."""
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("value"))
    return counted(formats.grok(lines, "%{WORD:scheme}://%{NOTSPACE:rest}"), scheme=get("scheme"))


add("grok_lines", "select regexp_extract(url, '^(\\w+)://', 1) as scheme, count(*) as n from pages group by 1", grok_lines)


def auto_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's file in one of four formats, told apart by its first line."""
    kind = F.col("user_id") % 4
    line = F.when(kind == 0, json_line()).when(kind == 1, logfmt()).when(kind == 2, syslog())
    found = formats.parse(files_of(spark, sf_dir, line.otherwise(text_of("plain ", "$event_type"))))
    kind = F.when(get("event_type").isNotNull(), "ndjson").when(get("level").isNotNull(), "logfmt")
    kind = kind.when(get("severity").isNotNull(), "syslog").otherwise("text")
    last = F.regexp_extract(get("message"), r"(\w+)$", 1)
    return counted(found, format=kind, what=F.coalesce(get("event_type"), get("level"), last))


add(
    "auto_formats",
    "select case user_id % 4 when 0 then 'ndjson' when 1 then 'logfmt' when 2 then 'syslog' else 'text' end as "
    "format, event_type as what, count(*) as n "
    "from events group by 1, 2",
    auto_formats,
)


# push bodies: one a user


def bodies(spark: SparkSession, sf_dir: str, line: Column, head: str = "", sep: str = "\n", tail: str = "") -> DataFrame:
    return files_of(spark, sf_dir, line, head, sep, tail).select(F.col("value").alias("body"))


def pushed(events: DataFrame) -> DataFrame:
    return counted(events, index=F.col("index"), what=get("what"), at=get("timestamp", "long"))


def seconds() -> Column:
    return F.floor(ms() / SECOND)


def nanos() -> Column:
    return (ms() * 1_000_000).cast("string")


def what() -> Column:
    return F.struct(F.col("event_type").alias("what"))


def app() -> Column:
    return F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string"))


def hec() -> Column:
    return F.to_json(F.struct(what().alias("event"), seconds().alias("time"), F.when(F.col("user_id") % 3 > 0, app()).alias("index")))


_app = "case when user_id % 3 > 0 then 'app' || user_id % 3 else 'main' end as index, event_type as what"
_nanos = f"select 'main' as index, event_type as what, ms * 1000000 as at, count(*) as n from {EV} group by 1, 2, 3"
add(
    "collector_push",
    f"select {_app}, ms // 1000 as at, count(*) as n from {EV} group by 1, 2, 3",
    lambda s, d: pushed(envelopes.unpack(bodies(s, d, hec()), "collector")),
)


def bulk_action() -> Column:
    return F.to_json(F.struct(F.struct(F.when(F.col("user_id") % 3 > 0, app()).alias("_index")).alias("create")))


def bulk_doc() -> Column:
    like_an_action = F.struct(F.lit(1).alias("x")).alias("index")
    return F.to_json(F.struct(like_an_action, F.col("event_type").alias("what"), seconds().alias("timestamp")))


def bulk_gone() -> Column:
    return F.when(F.col("event_id") % 5 == 0, '{"delete":{"_id":"1"}}\n').otherwise("")


add(
    "bulk_push",
    f"select {_app}, ms // 1000 as at, count(*) as n from {EV} group by 1, 2, 3",
    lambda s, d: pushed(envelopes.unpack(bodies(s, d, F.concat(bulk_gone(), bulk_action(), F.lit("\n"), bulk_doc())), "bulk")),
)


def record() -> Column:
    value = F.struct(F.col("event_type").alias("stringValue")).alias("value")
    attributes = F.array(F.struct(F.lit("what").alias("key"), value)).alias("attributes")
    return F.to_json(F.struct(nanos().alias("timeUnixNano"), attributes))


add(
    "otlp_push",
    _nanos,
    lambda s, d: pushed(envelopes.unpack(bodies(s, d, record(), '{"resourceLogs":[{"scopeLogs":[{"logRecords":[', ",", "]}]}]}"), "otlp")),
)


def entry() -> Column:
    return F.to_json(F.array(nanos(), F.to_json(what())))


add(
    "streams_push",
    _nanos,
    lambda s, d: pushed(envelopes.unpack(bodies(s, d, entry(), '{"streams":[{"stream":{"app":"x"},"values":[', ",", "]}]}"), "streams")),
)
RULES = [
    ("event_type", "equals", "error", "alarms"),
    ("event_type", "regex", "^(purchase|signup)$", "money"),
    ("event_type", "contains", "lic", "clicks"),
]
add(
    "routed_events",
    "select case event_type when 'error' then 'alarms' when 'purchase' then 'money' when 'signup' then 'money' "
    "when 'click' then 'clicks' else 'rest' end as index, "
    "count(*) as n from events group by 1",
    lambda s, d: counted(json_events(s, d), index=ingest.routed(RULES, "rest")),
)

# streams


def lines_folder(spark: SparkSession, sf_dir: str) -> str:
    """The events as text files of JSON lines, for streams to read."""
    path = work_path(spark, "lines")
    json_events(spark, sf_dir).repartition(4, "event").write.text(path)
    return path


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files streamed into a store, a batch appended beside, all compacted: each event twice."""
    path, lines = work_path(spark, "store"), lines_folder(spark, sf_dir)
    stream = ingest.text_files(spark, lines, files_a_trigger=2)
    ingest.ingest(stream, path, work_path(spark, "progress"), trigger={"availableNow": True}, template="events").awaitTermination()
    stored(spark, json_events(spark, sf_dir), path=path)
    store.compact(spark, path)
    return plain_names(stats(store.read(spark, path), [COUNT], ["event_type"]).rows())


add("stream_ingest", "select event_type, 2 * count(*) as count from events group by 1", stream_ingest)


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of rows. One batch, as files come in no order of time."""
    lines = ingest.text_files(spark, lines_folder(spark, sf_dir))
    return shredded.good(shredded.rows(formats.ndjson(lines), T0))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of errors in hours that are over, by a stream."""
    out = work_path(spark, "windows")
    counts = ingest.window_counts(stream_rows(spark, sf_dir), "1 hour", "0 seconds", ERRORS.predicate)
    writer = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_ms long, n long").parquet(out)


_errors = f"(select * from {EV} where event_type = 'error')"
add(
    "stream_windows",
    f"select ms - ms % {HOUR} as window_ms, count(*) as n from {_errors} group by 1 having window_ms + {HOUR} <= "
    f"(select max(ms) from {_errors})",
    stream_windows,
)


def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more than three errors after one without, by a stream."""
    alerts = work_path(spark, "alerts")
    rows, progress = stream_rows(spark, sf_dir), work_path(spark, "progress")
    watch = ingest.monitor(rows, "1 hour", HOUR, "gt", 3, alerts, progress, predicate=ERRORS.predicate, trigger={"availableNow": True})
    watch.awaitTermination()
    return ingest.alerts_of(spark, alerts)


add(
    "stream_monitor",
    "select w as window_ms, n from (select w, n, n > 3 and not coalesce(lag(n > 3) over (order by w), false) as alert from "
    f"{_hourly}) where alert and w + {HOUR} <= (select max(ms) from {EV})",
    stream_monitor,
)
