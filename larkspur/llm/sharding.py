"""Sharded tables with size-tiered compaction and versioned manifests.

`append` adds an arrival as small immutable Parquet shards. `compact` sorts the shards below the target size
into tiers (powers of FANOUT of their size), joins similarly sized ones of a tier into runs of up to the target
and writes each run as one new shard, until no tier holds FANOUT shards. Every change is a new manifest: the
complete list of live shards under the next version number, a file that exactly one writer creates and that is there as
a whole or not at all, so readers see one version or the next. Of two writers the second reads the table again: an arrival
is added to the version it finds, a compaction goes on from there and leaves out what another one has joined. The tests
race writers on a local disk, where the file is placed by a hard link; elsewhere it takes a file system whose rename never
replaces, as HDFS promises (not tested here), and plain object stores need a lock beside it. Files are
never changed; `vacuum` deletes those that no kept version lists, also what failed or beaten writers left behind.

Only file names and sizes pass the driver. Rows are taken as they are: nulls and repeated rows are kept; an empty
arrival adds a version without shards. An arrival may lack columns or bring new ones, which are null in the other
rows; one whose column has another type, or a name that differs in case only, is refused before anything is written.
Shards are read and written by Spark alone.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from larkspur.sources.folder import Folder

TARGET_BYTES = 128 << 20
SMALL_BYTES = 8 << 20
FANOUT = 4
RUNS_A_JOB = 200
ABANDONED_S = 86_400.0  # shards and drafts of this age that no version lists belong to no running writer


def widened(have: StructType | None, new: StructType) -> StructType:
    """The columns of both, all nullable; raises where they can't be read as one."""
    out = {f.name: f for f in (have.fields if have else ())}
    for f in new.fields:
        old = out.setdefault(f.name, StructField(f.name, f.dataType, True, f.metadata))
        if old.dataType != f.dataType:
            raise ValueError(f"column {f.name!r} is {old.dataType.simpleString()} in the table and {f.dataType.simpleString()} here")
    if len({n.lower() for n in out}) < len(out):
        raise ValueError("columns whose names differ in case only")
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in out.values()])


def _schema(manifest: dict) -> StructType | None:
    return manifest["schema"] and StructType.fromJson(json.loads(manifest["schema"]))


class ShardedTable:
    def __init__(
        self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.small, self.fanout = target_bytes, small_bytes, fanout
        self.folder = Folder(spark, path)

    # manifests

    def versions(self) -> list[int]:
        return sorted(int(name[1:-5]) for name, _ in self.folder.folders("manifests") if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"file", "bytes"}]} of a version, by default the latest."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "shards": []}
        return self.folder.read(f"manifests/v{have[-1] if version is None else version:010d}.json")

    def _commit(self, base: dict, schema: str, shards: list[dict]) -> dict:
        """Put the next version in place; raises FileExistsError if another writer was first."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["file"])}
        if not self.folder.put(f"manifests/v{new['version']:010d}.json", new):
            raise FileExistsError(f"version {new['version']} exists")
        return new

    # shards

    def _write(self, df: DataFrame) -> list[dict]:
        name = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return [{"file": f, "bytes": n} for f, n, _ in self.folder.files(name) if f.endswith(".parquet") and n]

    def _read(self, shards: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['file']}" for s in shards))

    def append(self, arrival: DataFrame, shards: int | None = None) -> dict:
        """Add the rows of an arrival; shards: into how many files, by default one for each of its partitions."""
        widened(_schema(self.manifest()), arrival.schema)
        new = self._write(arrival.coalesce(shards) if shards else arrival)
        while True:
            base = self.manifest()
            schema = widened(_schema(base), arrival.schema)  # another arrival may have brought columns meanwhile
            try:
                return self._commit(base, schema.json(), base["shards"] + new)
            except FileExistsError:
                continue

    def _runs(self, shards: list[dict]) -> list[list[dict]]:
        """Shards to be joined: similarly sized ones, up to the target each."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tier = math.ceil(math.log(max(s["bytes"], 1) / self.small, self.fanout))
                tiers.setdefault(max(0, tier), []).append(s)
        runs = []
        for _, tier in sorted(tiers.items()):
            if len(tier) < self.fanout:
                continue
            run, size = [], 0
            for s in sorted(tier, key=lambda s: (s["bytes"], s["file"])):
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> dict:
        """Join runs until no tier has enough shards; one commit for each round of at most RUNS_A_JOB runs."""
        now = self.manifest()
        while runs := self._runs(now["shards"])[:RUNS_A_JOB]:
            joined = reduce(DataFrame.unionAll, [self._read(run, _schema(now)).coalesce(1) for run in runs])  # one task and one file a run
            gone, new = {s["file"] for run in runs for s in run}, self._write(joined)
            while gone <= {s["file"] for s in now["shards"]}:
                rest = [s for s in now["shards"] if s["file"] not in gone]
                try:
                    now = self._commit(now, now["schema"], rest + new)
                    break
                except FileExistsError:
                    now = self.manifest()  # with more shards, or without some of these: then they are joined anew
        return now

    def vacuum(self, keep: int = 1, abandoned_s: float = ABANDONED_S) -> int:
        """Delete all versions but the last `keep`, the shards only they list, and shards and drafts of that age which
        no version lists; returns how many shards went."""
        have = self.versions()
        kept, old = have[-keep:], have[:-keep]
        live = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        dead = {s["file"] for v in old for s in self.manifest(v)["shards"]} - live
        for v in old:
            self.folder.delete(f"manifests/v{v:010d}.json")
        before = (time.time() - abandoned_s) * 1000
        for folder, changed in self.folder.folders("shards"):
            name = f"shards/{folder}"
            files = {f: at for f, _, at in self.folder.files(name)}
            shards = {f for f in files if f.endswith(".parquet")}
            dead |= {f for f in shards - live - dead if files[f] < before}
            stale = max([changed, *files.values()]) < before
            if not shards - dead and (shards or stale):
                self.folder.delete(name)
            else:
                for f in shards & dead:
                    self.folder.delete(f)
        for draft, changed in self.folder.folders("_drafts"):
            if changed < before:
                self.folder.delete(f"_drafts/{draft}")
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m["shards"], _schema(m)) if m["shards"] else self.spark.createDataFrame([], _schema(m))
