"""The event store: Parquet files by environment, index and day, and a log of versions that says which of them count.

Every write puts new files in a folder of its own; then one small JSON file in `_log`, the next version, makes them count
and what they replace stop counting. A version's file is created by exactly one writer: who comes second reads the log
again and tries the version after it. Appends never stand in each other's way; a compaction or an expiry is given up if
another writer took one of its files away (`Conflict`). Readers see all of a version or nothing, a writer that dies leaves
only files that no version names, and a commit whose name the log has is skipped, so a batch that a stream repeats is
stored once. Old files stay for running readers until `clean`.

The log names each file's partition, size, rows and times. Every LOG_FILES versions, the list of files is written as a
Parquet table, and readers take from it what a search's partitions, times and words leave: `find` narrows a stored view
before any file is listed. Rows are sorted by time within each file, so a time window also skips row groups.

`index` makes what further narrows and describes files, in side tables by file that compaction remakes with the files:
a Bloom filter of the words in each file's texts, and for each field counts and a HyperLogLog sketch of its values. Files
that aren't indexed yet are read. `promote` names fields that from then on get Parquet columns of their own beside the
leaves; a search takes the column where a file has it and the leaves elsewhere.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import token_set
from larkspur.operators.discovery import CARDINALITY_CAP, LEAST_COVERAGE
from larkspur.operators.fields import PROMOTED, PROMOTED_N, LeafFields, PromotedFields, View, promoted_column
from larkspur.sources.folder import Folder

PARTITION = ["env", "index", "day"]
SCHEMA = (
    "ts_ms bigint, message string, source string, raw string, seq bigint, "
    "leaves array<struct<path:string,pos:int,i:bigint,d:double,b:boolean,s:string>>, env string, index string, day date"
)
FILES = "file string, env string, index string, day date, bytes bigint, rows bigint, min_ms bigint, max_ms bigint, fields int"
TARGET_BYTES, FLOOR_BYTES = 64 << 20, 5 << 20
PARTITIONS_A_JOB = 500
LOG_FILES = 50  # after so many versions the list of files is written anew
GRACE_S = 3600.0
NAME = "^[A-Za-z0-9_-]+$"
TRIES = 1000
MOVES = 16  # folders that a write moves at a time
BITS_A_WORD, PROBES, LEAST_SIZE, MOST_SIZE = 10, 7, 10, 30  # of a file's Bloom filter: 1 % of absent words pass
SKETCH_K = 10  # 2**10 registers: cardinalities within 3 % two times of three


class Conflict(Exception):
    """Another writer took away files that this one was to replace."""


# the log


@dataclass
class Log:
    """What the versions up to one of them say; `table`: the list of files as of some version, `new` and `old`: since then."""

    version: int = 0
    table: str | None = None
    new: dict[str, dict] = field(default_factory=dict)
    old: set[str] = field(default_factory=set)
    names: set[str] = field(default_factory=set)
    last: dict[str, int] = field(default_factory=dict)
    promoted: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    since: int = 0  # versions since the table

    def add(self, commit: dict) -> None:
        for f in commit.get("old", ()):
            self.new.pop(f, None)
            self.old.add(f)
        self.new |= {f["file"]: f for f in commit.get("new", ())}
        if name := commit.get("name"):
            stream, _, number = name.rpartition("-")
            if number.isdigit():  # of a stream's numbered batches the last one tells
                self.last[stream] = max(int(number), self.last.get(stream, -1))
            else:
                self.names.add(name)
        self.promoted += commit.get("promoted", ())
        self.indexes += commit.get("indexes", ())
        self.version, self.since = commit["version"], self.since + 1

    def has(self, name: str | None) -> bool:
        stream, _, number = (name or "").rpartition("-")
        return name in self.names or number.isdigit() and int(number) <= self.last.get(stream, -1)


def _number(file: str) -> int:
    return int(file.rsplit("/", 1)[-1].split(".")[0].lstrip("c"))


def read_log(at: Folder) -> Log:
    for _ in range(TRIES):
        names = [f for f, _, _ in at.files("_log") if f.endswith(".json")]
        tables = [f for f in names if f.rsplit("/", 1)[-1].startswith("c")]
        log = Log()
        try:
            if tables:
                c = at.read(max(tables, key=_number))
                log = Log(c["version"], c["table"], names=set(c["names"]), last=c["last"], promoted=c["promoted"], indexes=c["indexes"])
            for f in sorted((f for f in names if f not in tables and _number(f) > log.version), key=_number):
                if _number(f) != log.version + 1:
                    raise FileNotFoundError(f)
                log.add(at.read(f))
            return log
        except (FileNotFoundError, Py4JJavaError):  # cleaned between listing and reading
            time.sleep(0.05)
    raise OSError(f"can't read the log of {at.path}")


def advance(at: Folder, make: Callable[[Log], dict | None]) -> bool:
    """Add make(log) as the next version, made anew whenever another writer was first; False if it gives None."""
    for _ in range(TRIES):
        log = read_log(at)
        what = make(log)
        if what is None:
            return False
        if at.put(f"_log/{log.version + 1:012d}.json", what | {"version": log.version + 1}):
            return True
    raise OSError(f"no version of {at.path} could be added in {TRIES} tries")


def _files(spark: SparkSession, at: Folder, log: Log) -> DataFrame:
    new = [tuple(f.get(n) if n != "day" else date.fromisoformat(f["day"]) for n in FILE_FIELDS) for f in log.new.values()]
    now = spark.createDataFrame(new, FILES)
    if not log.table:
        return now
    then = spark.read.schema(FILES).parquet(f"{at.path}/{log.table}")
    if log.old:  # of at most the versions since the table
        then = then.join(F.broadcast(spark.createDataFrame([(f,) for f in log.old], "file string")), "file", "left_anti")
    return then.unionByName(now)


FILE_FIELDS = [f.split()[0] for f in FILES.split(", ")]


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files that count, with partition, bytes, rows and times."""
    at = Folder(spark, path)
    return _files(spark, at, read_log(at))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """env, index, day, files, bytes, rows, first_ms, last_ms of every partition, from the log alone."""
    figures = [F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")]
    figures += [F.min("min_ms").alias("first_ms"), F.max("max_ms").alias("last_ms")]
    return files(spark, path).groupBy(*PARTITION).agg(*figures)


def indexes(spark: SparkSession, path: str) -> DataFrame:
    """env, index, partitions, files, bytes, rows, first and last day of every index, from the log alone."""
    figures = [F.count("*").alias("partitions"), *(F.sum(n).alias(n) for n in ("files", "bytes", "rows"))]
    figures += [F.min("day").alias("first_day"), F.max("day").alias("last_day")]
    return partitions(spark, path).groupBy("env", "index").agg(*figures)


def live_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each file that counts, on the driver."""
    return {r["file"]: r["bytes"] for r in files(spark, path).select("file", "bytes").collect()}


def partition_figures(spark: SparkSession, path: str) -> list[tuple[str, str, str, int, int]]:
    """(env, index, day, files, bytes) of every partition, on the driver."""
    rows = partitions(spark, path).select("env", "index", F.col("day").cast("string"), "files", "bytes").collect()
    return sorted(tuple(r) for r in rows)


def totals(spark: SparkSession, path: str) -> dict[str, int]:
    """Partitions, files and bytes of the whole store."""
    sums = [F.count("*").alias("partitions"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("files", "bytes"))]
    return partitions(spark, path).agg(*sums).first().asDict()


# writing

_PATH = r"(env=[^/]+/index=[^/]+/day=[^/]+/[^/]+/[^/]+)$"


def _write(rows: DataFrame, at: Folder, promoted: Sequence[str]) -> list[dict]:
    """Files of the rows, dealt and sorted by the caller, with the promoted fields; they don't count yet."""
    spark, write = rows.sparkSession, uuid.uuid4().hex
    staging = f"_staging/{write}"
    if promoted:
        own = {promoted_column(k): LeafFields().promoted(p) for k, p in enumerate(promoted)}
        rows = rows.withColumns(own | {PROMOTED_N: F.lit(len(promoted))})
    rows.write.option("compression", "zstd").partitionBy(*PARTITION).parquet(f"{at.path}/{staging}")
    sizes, folders = {}, set()
    for f, n, _ in at.files(staging, recursive=True):
        folder, _, file = f[len(staging) + 1 :].rpartition("/")
        if folder and file.endswith(".parquet"):
            sizes[f"{folder}/{write}/{file}"] = n
            folders.add(folder)
    with ThreadPoolExecutor(MOVES) as pool:  # one move for each partition that has rows; each waits for the file system
        list(pool.map(lambda folder: at.move(f"{staging}/{folder}", f"data/{folder}/{write}"), folders))
    at.delete(staging)
    if not sizes:
        return []
    written = spark.read.schema("ts_ms bigint").parquet(*(f"{at.path}/data/{f}" for f in sizes))
    name = F.regexp_extract("_metadata.file_path", _PATH, 1)
    times = written.groupBy(name.alias("file")).agg(F.count("*").alias("rows"), F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    out = []
    for r in times.collect():  # one row a file of this write
        env, index, day = _key(f"data/{r['file']}")
        about = {"file": f"data/{r['file']}", "env": env, "index": index, "day": day, "bytes": sizes[r["file"]], "fields": len(promoted)}
        out.append(about | {"rows": r["rows"], "min_ms": r["low"], "max_ms": r["high"]})
    return out


def _key(file: str) -> tuple[str, str, str]:
    """Of data/env=E/index=I/day=D/write/file."""
    return tuple(x.split("=", 1)[1] for x in file.split("/")[1:4])


def _drop(at: Folder, files: Iterable[dict]) -> None:
    for folder in {f["file"].rpartition("/")[0] for f in files}:
        at.delete(folder)


def bad_name() -> Column:
    """Environment or index can't be a folder's name."""
    return ~F.coalesce(F.col("env").rlike(NAME) & F.col("index").rlike(NAME), F.lit(False))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows that parsed and whose environment and index may be folder names."""
    parsed = F.col("bad").isNull() if "bad" in rows.columns else F.lit(True)
    return rows.filter(parsed & ~bad_name()).drop("bad")


def rejected(rows: DataFrame) -> DataFrame:
    """reason, raw of the rows that accepted() leaves out."""
    reason = F.when(bad_name(), F.lit("name"))
    reason = F.coalesce("bad", reason) if "bad" in rows.columns else reason
    return rows.select(reason.alias("reason"), "raw").filter("reason is not null")


def append(rows: DataFrame, path: str, commit: str | None = None) -> dict[str, int]:
    """Store the accepted rows; returns how many were stored, and how many not for each reason.

    Late rows go to their own day. Rows of a partition meet; Spark deals a busy day to several tasks and puts quiet ones
    together, by their sizes. commit: a name that is stored at most once.
    """
    at, seen = Folder(rows.sparkSession, path), Observation()
    log = read_log(at)
    if log.has(commit):
        return {"stored": 0}
    bad = F.col("bad") if "bad" in rows.columns else F.lit(None).cast("string")
    reason = F.coalesce(bad, F.when(bad_name(), F.lit("name")))
    counts = [F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in ("json", "value", "name")]
    watched = rows.observe(seen, F.count_if(reason.isNull()).alias("stored"), *counts)
    dealt = accepted(watched).hint("rebalance", *map(F.col, PARTITION)).sortWithinPartitions(*PARTITION, "ts_ms")
    new = _write(dealt, at, log.promoted)
    if not advance(at, lambda now: None if now.has(commit) else {"new": new, "name": commit}):
        _drop(at, new)
        return {"stored": 0}
    try:
        return {k: v for k, v in seen.get.items() if v or k == "stored"}
    except Py4JJavaError:  # Spark drops what it is to observe in a plan that it knows to be empty
        return {"stored": 0}


# reading


class StoredView(View):
    """A view of some of a store's files. What of them to read is settled when rows are asked for."""

    def __init__(self, spark: SparkSession, path: str, chosen: DataFrame, promoted: Sequence[str], side: Sequence[str]):
        self.spark, self.path, self.chosen, self.promoted, self.side = spark, path.rstrip("/"), chosen, promoted, side
        self.ts = None

    @cached_property
    def files(self) -> list:
        """The log's rows of the chosen files, on the driver: as many as the search opens."""
        return self.chosen.orderBy("file").collect()

    @cached_property
    def fields(self) -> PromotedFields:
        everywhere = min((f["fields"] or 0 for f in self.files), default=0)
        return PromotedFields(list(self.promoted), everywhere)

    @cached_property
    def partitions(self) -> list[tuple[str, str, str]]:
        return sorted({(f["env"], f["index"], str(f["day"])) for f in self.files})

    @cached_property
    def df(self) -> DataFrame:
        own = [f"{PROMOTED_N} int", *(f"{promoted_column(k)} {PROMOTED}" for k in range(len(self.promoted)))]
        schema = ", ".join([SCHEMA, *own]) if self.promoted else SCHEMA
        if not self.files:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", self.path)
        return read.parquet(*(f"{self.path}/{f['file']}" for f in self.files))

    def of(self, chosen: DataFrame) -> StoredView:
        return StoredView(self.spark, self.path, chosen, self.promoted, self.side)

    def narrowed(self, planned: Column, start_ms: int | None, end_ms: int | None, needs: Sequence[frozenset[str]] = ()) -> StoredView:
        chosen = self.chosen.filter(planned)
        if start_ms is not None:
            chosen = chosen.filter(F.col("max_ms") >= start_ms)
        if end_ms is not None:
            chosen = chosen.filter(F.col("min_ms") <= end_ms)
        if needs and self.side:
            chosen = chosen.join(_without_words(self.spark, self.path, self.side, needs), "file", "left_anti")
        return self.of(chosen)


def read(spark: SparkSession, path: str) -> StoredView:
    at = Folder(spark, path)
    log = read_log(at)
    return StoredView(spark, path, _files(spark, at, log), log.promoted, log.indexes)


def newest(view: StoredView, search: Callable[[View], View], limit: int = 50, offset: int = 0, wave: int = 8) -> tuple[View, int]:
    """(a view that holds the first offset + limit hits, newest first, how many files were opened for them).

    Files are opened by their largest time, from the newest on, twice as many in each wave. Once so many hits are found
    that the last of them is newer than anything in the files not opened, no other file can hold one of these hits.
    """
    wanted = offset + max(1, limit)
    # the order is settled where the list is: one row a file in scope
    left = sorted(view.files, key=lambda f: (-f["max_ms"], f["file"]))
    opened, times = [], []
    while left:
        now, left = left[:wave], left[wave:]
        opened += now
        found = search(view.of(view.spark.createDataFrame(now, FILES)))
        rows = found.df.select("ts_ms").orderBy(F.desc("ts_ms")).limit(wanted).collect()
        times = sorted([*times, *(r[0] for r in rows)], reverse=True)[:wanted]
        if len(times) == wanted and (not left or times[-1] > left[0]["max_ms"]):
            break
        wave *= 2
    out = search(view.of(view.spark.createDataFrame(opened, FILES)))
    return (out.where(F.col("ts_ms") >= times[-1]) if len(times) == wanted else out), len(opened)


# side tables


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.concat(F.lit("data/"), F.regexp_extract("_metadata.file_path", _PATH, 1)))


def _hashes(word: Column) -> Column:
    """The two numbers that say where a word sets bits."""
    low = F.lit((1 << 40) - 1)
    return F.struct(
        F.xxhash64(word).bitwiseAND(low).alias("a"),
        F.xxhash64(word, F.lit(1)).bitwiseAND(low).bitwiseOR(F.lit(1).cast("long")).alias("b"),
    )


def _positions(a: Column, b: Column, size: Column) -> Column:
    """Where a word of these hashes sets bits in a filter of 2**size bits: (number of the 64 bits, which of them)."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def probe(i: Column) -> Column:
        at = (a + i * b).bitwiseAND(mask)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
        return F.struct(F.shiftright(at, 6).alias("at"), bit.alias("bits"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(PROBES - 1).cast("long")), probe)


def _words(rows: DataFrame) -> DataFrame:
    """file, a, b: hashes of the words of message and raw, and of sources as a whole; those say all that a filter keeps of
    a word, and are shorter."""
    some = [F.coalesce(token_set(F.col(c)), F.array().cast("array<string>")) for c in ("message", "raw")]
    source = F.when(F.col("source").isNotNull(), F.array(F.lower("source"))).otherwise(F.array().cast("array<string>"))
    words = rows.select("file", F.explode(F.array_distinct(F.concat(*some, source))).alias("word"))
    return words.select("file", _hashes(F.col("word")).alias("h")).select("file", "h.a", "h.b").distinct()


def _filters(rows: DataFrame) -> DataFrame:
    """file, size, at, bits: the Bloom filter of each file's words, 64 bits to a row."""
    words = _words(rows)
    counts = words.groupBy("file").agg(F.count("*").alias("n"))
    size = F.least(F.lit(MOST_SIZE), F.greatest(F.lit(LEAST_SIZE), F.ceil(F.log2(F.col("n") * BITS_A_WORD)))).cast("int")
    sized = words.join(counts.select("file", size.alias("size")), "file")
    each = sized.select("file", "size", F.explode(_positions(F.col("a"), F.col("b"), F.col("size"))).alias("p"))
    return each.groupBy("file", "size", F.col("p.at").alias("at")).agg(F.bit_or("p.bits").alias("bits"))


def _sketches(rows: DataFrame) -> DataFrame:
    """file, path, kind, rows, sketch: for each field of a file its rows and a sketch of its texts."""
    leaves = rows.select("file", F.explode("leaves").alias("x")).select("file", "x.*").filter("pos = 0")
    kind = F.when(F.col("s").isNotNull(), "string").when(F.col("b").isNotNull(), "bool").otherwise("number")
    sketch = F.hll_sketch_agg("s", F.lit(SKETCH_K))
    return leaves.groupBy("file", "path", kind.alias("kind")).agg(F.count("*").alias("rows"), sketch.alias("sketch"))


def _side(spark: SparkSession, path: str, side: Sequence[str], table: str, schema: str) -> DataFrame:
    if not side:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/_index/{s}/{table}" for s in side))


FILTER, SKETCH = "file string, size int, at bigint, bits bigint", "file string, path string, kind string, rows bigint, sketch binary"


def index(spark: SparkSession, path: str) -> int:
    """Make the side tables of files that have none yet; returns how many files got them."""
    at = Folder(spark, path)
    log = read_log(at)
    known = _side(spark, path, log.indexes, "files", "file string")
    todo = [r["file"] for r in _files(spark, at, log).join(known, "file", "left_anti").select("file").collect()]
    for i in range(0, len(todo), PARTITIONS_A_JOB):
        some, name = todo[i : i + PARTITIONS_A_JOB], uuid.uuid4().hex
        rows = _named(spark.read.schema(SCHEMA).option("basePath", path).parquet(*(f"{at.path}/{f}" for f in some)))
        # readers ask for few values of (size, at)
        _filters(rows).repartitionByRange("size", "at").sortWithinPartitions("size", "at").write.parquet(f"{at.path}/_index/{name}/words")
        _sketches(rows).write.parquet(f"{at.path}/_index/{name}/fields")
        spark.createDataFrame([(f,) for f in some], "file string").coalesce(1).write.parquet(f"{at.path}/_index/{name}/files")
        advance(at, lambda now, name=name: {"indexes": [name]})
    return len(todo)


def _without_words(spark: SparkSession, path: str, side: Sequence[str], needs: Sequence[frozenset[str]]) -> DataFrame:
    """The indexed files whose filters say that one of `needs`, alternatives each, has no word in them."""
    filters = _side(spark, path, side, "words", FILTER)
    asked = spark.createDataFrame([(i, w) for i, some in enumerate(needs) for w in some], "need int, word string")
    sizes = F.sequence(F.lit(LEAST_SIZE), F.lit(MOST_SIZE))
    h = _hashes(F.col("word"))
    asked = asked.withColumn("size", F.explode(sizes)).withColumn("p", F.explode(_positions(h["a"], h["b"], F.col("size"))))
    asked = asked.groupBy("need", "word", "size", F.col("p.at").alias("at")).agg(F.bit_or("p.bits").alias("want"))
    places = asked.groupBy("need", "word", "size").agg(F.count("*").alias("places"))
    spots = [r["at"] for r in asked.select("at").distinct().collect()]  # PROBES a word and size
    read = filters.filter(F.col("at").isin(spots))
    met = read.join(F.broadcast(asked), ["size", "at"]).filter(F.col("bits").bitwiseAND(F.col("want")) == F.col("want"))
    held = met.groupBy("file", "need", "word", "size").agg(F.count("*").alias("n")).join(F.broadcast(places), ["need", "word", "size"])
    needed = held.filter("n = places").select("file", "need").distinct().groupBy("file").agg(F.count("*").alias("met"))
    able = needed.filter(F.col("met") == len(needs)).select("file")
    return _side(spark, path, side, "files", "file string").join(able, "file", "left_anti")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, rows, coverage, cardinality, interesting, as discovery.field_catalog() gives them, but cardinalities
    from sketches: within some per cent. Rows are read of files only that index() hasn't seen."""
    at = Folder(spark, path)
    log = read_log(at)
    live = _files(spark, at, log)
    known = _side(spark, path, log.indexes, "files", "file string")
    fields = _side(spark, path, log.indexes, "fields", SKETCH).join(live.select("file"), "file", "left_semi")
    unseen = StoredView(spark, path, live.join(known, "file", "left_anti"), (), ())
    if unseen.files:
        fields = fields.unionByName(_sketches(_named(unseen.df)))
    total = live.agg(F.sum("rows")).first()[0] or 0
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality")
    out = fields.groupBy("path").agg(F.min("kind").alias("kind"), F.sum("rows").alias("rows"), merged)
    coverage = F.col("rows") / F.lit(max(total, 1))
    interesting = F.col("cardinality").between(2, CARDINALITY_CAP) & (coverage >= LEAST_COVERAGE)
    return out.select("path", "kind", "rows", coverage.alias("coverage"), "cardinality", interesting.alias("interesting"))


def promote(spark: SparkSession, path: str, paths: Sequence[str] | None = None, coverage: float = 0.5, most: int = 16) -> list[str]:
    """Give fields columns of their own in files written from now on; returns which are new. By default the fields that
    so many of the rows have, `most` in all, those of most rows first."""
    at = Folder(spark, path)
    if paths is None:
        frequent = catalog(spark, path).filter(F.col("coverage") >= coverage).orderBy(F.desc("rows"), "path").limit(most)
        paths = [r["path"] for r in frequent.collect()]
    new: list[str] = []

    def make(log: Log) -> dict | None:
        new[:] = [p for p in dict.fromkeys(x.lower() for x in paths) if p not in log.promoted]
        return {"promoted": list(new)} if new else None

    advance(at, make)
    return new


# upkeep


def compact(spark: SparkSession, path: str, target: int = TARGET_BYTES, least_files: int = 2) -> list[tuple[str, str, str]]:
    """Write small files of a partition as files of about the target size; returns which partitions.

    Files of half the target and more stay as they are, so a byte is written again only while its file is small.
    """
    at = Folder(spark, path)
    log = read_log(at)
    small = _files(spark, at, log).filter(F.col("bytes") < target / 2)
    groups = small.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.collect_list("file").alias("old"))
    chosen = groups.filter(F.col("n") >= least_files).orderBy(*PARTITION).collect()  # small files' names by partition
    done = []
    for i in range(0, len(chosen), PARTITIONS_A_JOB):
        some = {(g["env"], g["index"], str(g["day"])): g for g in chosen[i : i + PARTITIONS_A_JOB]}
        old = {f for g in some.values() for f in g["old"]}
        rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*(f"{at.path}/{f}" for f in sorted(old)))
        parts = F.create_map(*(F.lit(x) for k, g in some.items() for x in ("/".join(k), -(-g["size"] // target))))
        part = F.pmod(F.xxhash64("seq"), parts[F.concat_ws("/", "env", "index", F.col("day").cast("string"))])
        dealt = rows.withColumn("part", part).repartition(*PARTITION, "part").drop("part")
        new = _write(dealt.sortWithinPartitions(*PARTITION, "ts_ms"), at, log.promoted)
        _replace(spark, at, old, new)
        done += some
    _write_table(spark, at)
    return done


def _replace(spark: SparkSession, at: Folder, old: set[str], new: list[dict]) -> None:
    def make(now: Log) -> dict:
        known = old - set(now.new)
        if known & now.old or known and not now.table:
            raise Conflict(f"files of {at.path} are gone")
        if known and now.table != seen["table"]:  # the list was written anew meanwhile
            there = spark.read.schema(FILES).parquet(f"{at.path}/{now.table}").filter(F.col("file").isin(sorted(known))).count()
            if there < len(known):
                raise Conflict(f"files of {at.path} are gone")
            seen["table"] = now.table
        return {"old": sorted(old), "new": new}

    seen: dict = {"table": None}
    try:
        advance(at, make)
    except Conflict:
        _drop(at, new)
        raise


def _write_table(spark: SparkSession, at: Folder) -> None:
    """Write the list of files anew if there are many versions since the last one."""
    log = read_log(at)
    if log.since <= LOG_FILES:
        return
    table = f"_log/files-{uuid.uuid4().hex}"
    dealt = _files(spark, at, log).repartitionByRange("index", "day", "env").sortWithinPartitions("index", "day", "env")
    dealt.write.parquet(f"{at.path}/{table}")
    about = {"version": log.version, "table": table, "names": sorted(log.names), "last": log.last}
    at.put(f"_log/c{log.version:012d}.json", about | {"promoted": log.promoted, "indexes": log.indexes})


def clean(spark: SparkSession, path: str, grace_s: float = GRACE_S) -> int:
    """Delete files of that age which don't count, and what the log no longer needs; returns how many files went."""
    at = Folder(spark, path)
    before = (time.time() - grace_s) * 1000
    log = read_log(at)
    live = _files(spark, at, log).select("file")
    there = [(f,) for f, _, changed in at.files("data", recursive=True) if f.endswith(".parquet") and changed < before]
    dead = [r["file"] for r in spark.createDataFrame(there, "file string").join(live, "file", "left_anti").collect()]
    for f in dead:
        at.delete(f)
    first = log.version - log.since
    for f, _, changed in at.files("_log"):
        stands = f.endswith(".json") and (_number(f) > first or f == f"_log/c{first:012d}.json")
        if not stands and changed < before:
            at.delete(f)
    for name, changed in at.folders("_log"):
        if name.startswith("files-") and f"_log/{name}" != log.table and changed < before:
            at.delete(f"_log/{name}")
    for name, changed in at.folders("_index"):
        if name not in log.indexes and changed < before:
            at.delete(f"_index/{name}")
    for folder in ("_drafts", "_staging"):
        for f, _, changed in at.files(folder, recursive=True):
            if changed < before:
                at.delete(f)
    return len(dead)


def expired(today: date, days: int, overrides: dict[str, int] | None = None, env: str = "default") -> date:
    """The first day that is kept: at least one day back, an environment's own number of days before the common one."""
    return today - timedelta(days=max(1, (overrides or {}).get(env, days)))


def retain(spark: SparkSession, path: str, today: date, days: int, overrides: dict[str, int] | None = None) -> list[tuple[str, str, str]]:
    """Partitions older than their environment allows count no longer; returns which. clean() deletes their files."""
    at = Folder(spark, path)
    first = F.lit(expired(today, days))
    for env in overrides or {}:
        first = F.when(F.col("env") == env, F.lit(expired(today, days, overrides, env))).otherwise(first)
    gone: list = []

    def make(log: Log) -> dict | None:
        gone[:] = _files(spark, at, log).filter(F.col("day") < first).collect()  # made anew if another writer was first
        return {"old": sorted(f["file"] for f in gone)} if gone else None

    advance(at, make)
    return sorted({(f["env"], f["index"], str(f["day"])) for f in gone})
