"""Tables that live between two jobs of one operator, in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_worker: dict[str, str] = {}
_caches: list[Callable[[], None]] = []
_written: list[DataFrame | None] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a temporary folder serves a local session; a cluster needs it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="larkspur-")
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    if _written:
        _written.append(out)
    return out


class Temporary:
    """Tables that materialize() writes inside `with Temporary() as t` are deleted at its end, but for those in t.keep()."""

    def __enter__(self) -> Temporary:
        self.kept: set[str] = set()
        self.first = len(_written)
        _written.append(None)  # from here on tables are noted down
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._larkspur_path)
        return table

    def __exit__(self, *_) -> None:
        inside = _written[self.first + 1 :]
        del _written[self.first :]
        release(*(t for t in inside if t is not None and t._larkspur_path not in self.kept))


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_larkspur_path", None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with an operator's own."""
    return df.select(*columns)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clears(cache: Callable[[], None]) -> Callable[[], None]:
    """Register a function that empties a cache of this Python worker."""
    _caches.append(cache)
    return cache


def worker_for(operator: str) -> None:
    """Spark uses its Python workers again: one that turns to another operator gives the former one's memory back."""
    if _worker.setdefault("operator", operator) != operator:
        _worker["operator"] = operator
        for clear in _caches:
            clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes from this Python worker's allocators to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere the allocator decides
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A function of mapInArrow or applyInArrow whose arrays' memory is given back after the partition or each group: a worker
    that waits holds none of it while other workers and the JVM of its executor go on."""

    def partition(batches):
        yield from run(batches)
        give_back()

    def group(key, table):
        out = run(key, table)
        give_back()
        return out

    def cogroup(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return {1: partition, 2: group, 3: cogroup}[run.__code__.co_argcount]
