"""Lines of files that grow, as a stream: each line once, when its end is there.

The stream's offset says of each file which one it is and how many of its bytes are done. A batch reads from there to the
last line end, in byte ranges on the executors; a line without an end waits for the next batch. A file that was cut short
or replaced is read from its beginning, one that was given another name goes on where it was. All of that is told from
the offsets alone, so a restarted stream goes on without a line lost or repeated.

    spark.dataSource.register(GrowingFiles)
    spark.readStream.format("growing_files").option("path", folder).option("but", "*.tmp,*.gz").load()  # value, file

What is known of the files is as long as they are many. With the option `state`, a folder that lasts as long as the stream's
checkpoint and is this stream's alone, it lies there in parts of some thousand files each, and the offset only names the
parts by their contents: driver and checkpoint hold one part at a time, and parts that stayed the same aren't read. Without
`state` the offset itself says all, which serves for some thousand files.

Files lie on any file system that Arrow opens by URI and that driver and executors share. On local disks a file is known
by its inode, elsewhere by its path; and by its first HEAD bytes. Files of another name than `only` (globs, by commas) or
of one that `but` has are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256
SPLIT_BYTES = 32 << 20
OPEN_BYTES = 64 << 10  # what opening a file counts as, when ranges are put together
LINES_A_BATCH = 10_000
BLOCK = 4 << 20
LISTERS = 16
TRIED, QUICK_S = 64, 0.0005  # files that are looked at before others at once, unless these took no longer each
FILES_A_PART = 8192  # of an offset; as many are held at a time
KEPT = 100  # batches whose offsets' parts stay, as Spark keeps so many in a checkpoint
OLD_S = 86400.0  # parts that an earlier run left go at that age
SCHEMA = "value string, file string"


def packed(what: list | dict) -> bytes:
    return zlib.compress(json.dumps(what, sort_keys=True).encode(), 1)


def unpacked(data: bytes) -> list | dict:
    return json.loads(zlib.decompress(data))


@dataclass
class Ranges(InputPartition):
    """One task's (path, start, end): the lines of a file that start from byte `start` on and before byte `end`, at which a
    line has ended or a range does. They are packed, as the driver holds those of all tasks."""

    data: bytes

    @property
    def ranges(self) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in unpacked(self.data)]


def weight(range_: tuple[str, int, int]) -> int:
    return OPEN_BYTES + range_[2] - range_[1]


def together(ranges: Iterable[tuple[str, int, int]], total: int, most: int, tasks: int) -> Iterator[Ranges]:
    """Ranges of this total weight dealt to tasks: many short ones to each, so that many small files aren't a task each."""
    most = min(most, -(-total // max(1, tasks)))
    some: list = []
    filled = 0
    for r in ranges:
        if some and filled + weight(r) > most:
            yield Ranges(packed(some))
            some, filled = [], 0
        some.append(r)
        filled += weight(r)
    yield Ranges(packed(some))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def files_below(files: fs.FileSystem, root: str) -> Iterator[tuple[str, str, str]]:
    """(path, name, id), on local disks one after the other, elsewhere a folder at a time."""
    folders = [root]
    while folders:
        folder = folders.pop()
        if not isinstance(files, fs.LocalFileSystem):
            for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.type == fs.FileType.Directory:
                    folders.append(x.path)
                elif x.type == fs.FileType.File:
                    yield x.path, x.base_name, x.path
        elif os.path.exists(folder):
            with os.scandir(folder) as found:
                for x in found:
                    if x.is_dir():
                        folders.append(x.path)
                    elif x.is_file():
                        yield x.path, x.name, inode(x.path)


def inode(path: str) -> str:
    return "{0.st_dev}:{0.st_ino}".format(os.stat(path))


def last_line_end(file: pa.NativeFile, start: int, size: int) -> int:
    """The byte after the last line end between start and size; start if there is none."""
    end = size
    while end > start:
        begin = max(start, end - (1 << 16))
        file.seek(begin)
        at = file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def head_of(file: pa.NativeFile, n: int) -> int:
    file.seek(0)
    return zlib.crc32(file.read(n))


def begun(path: str, now: dict, before: dict, by_id: dict, heads) -> int:
    """From which byte a file is to be read, given the offsets of all files now and before; by_id: names before by file.

    heads(path, n) is the checksum of its first n bytes, which is asked for where the offset now hasn't that one.
    """
    own = now[path]
    was = before.get(path)
    if was is None or was["id"] != own["id"]:
        # given this name since then
        moved = (before[p] for p in by_id.get(own["id"], ()) if now.get(p, {}).get("id") != own["id"])
        was = next(moved, None)
    if was is None or was["byte"] > own["size"] or was["n"] > own["size"]:
        return 0
    head = own["head"] if was["n"] == own["n"] else heads(path, was["n"])
    return was["byte"] if head == was["head"] else 0


def each(look: Callable, found: list, pool: ThreadPoolExecutor) -> list:
    """look() of each: in threads where that waits for a network; on local disks threads only wait for each other."""
    start = time.perf_counter()
    out = list(map(look, found[:TRIED]))
    quick = time.perf_counter() - start <= QUICK_S * len(out)
    return out + list((map if quick else pool.map)(look, found[TRIED:]))


def part_of(id_: str, parts: int) -> int:
    """The number of the part that a file is in; of a power of two."""
    return zlib.crc32(id_.encode()) % parts


def parts_of(offset: dict) -> list[str]:
    """Names of an offset's parts, or all that it says as the only one."""
    return offset["parts"].split(",") if "parts" in offset else [offset["files"]]


class _State:
    """Parts of offsets in a folder, each under a name that its contents give, so what stays the same is there once."""

    def __init__(self, path: str):
        self.fs, self.root = opened(path)
        self.fs.create_dir(self.root)
        self._committed: deque[str] = deque()

    def put(self, text: str) -> str:
        if text == "{}":
            return text
        name = hashlib.sha256(text.encode()).hexdigest()[:32]
        if self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.File:
            draft = f"{self.root}/draft-{uuid.uuid4().hex}"  # a part is there as a whole or not at all
            with self.fs.open_output_stream(draft) as f:
                f.write(zlib.compress(text.encode(), 1))
            self.fs.move(draft, f"{self.root}/{name}")
        return name

    def get(self, name: str) -> dict[str, dict]:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return unpacked(f.read())

    def commit(self, parts: list[str], seen: list[str]) -> None:
        """Delete what neither the last offsets nor `seen` name."""
        if not self._committed:  # what earlier runs left
            for x in self.fs.get_file_info(fs.FileSelector(self.root)):
                age = time.time() - x.mtime_ns / 1e9 if x.mtime_ns is not None else 0
                if age > OLD_S and x.base_name not in {*parts, *seen}:
                    self.fs.delete_file(x.path)
        self._committed.append(",".join(parts))
        if len(self._committed) > KEPT:
            gone = set(self._committed.popleft().split(",")).difference(seen, *(x.split(",") for x in self._committed))
            for name in gone - {"{}"}:
                if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.File:
                    self.fs.delete_file(f"{self.root}/{name}")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.only = [x for x in options.get("only", "*").split(",") if x]
        self.but = [x for x in options.get("but", "").split(",") if x]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.most = int(options.get("filesAPart", FILES_A_PART))
        self._state = _State(options["state"]) if options.get("state") else None
        self._seen: list[str] = ["{}"]  # the parts of the last look

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self, parts: list[str], n: int, of: int) -> dict[str, dict]:
        """path: what an offset says of it, for the files of part n if there were `of` parts."""
        names = parts[n::of] if len(parts) >= of else [parts[n % len(parts)]]
        some = (json.loads(x) if x.startswith("{") else self._state.get(x) for x in names)
        return {path: own for part in some for path, own in part.items() if part_of(own["id"], of) == n}

    def _about(self, files: fs.FileSystem, path: str, id_: str, old: dict | None) -> dict | None:
        """What is to be known of a file; None if it was moved or replaced since it was listed."""
        try:
            with files.open_input_file(path) as f:
                if isinstance(files, fs.LocalFileSystem) and inode(path) != id_:
                    return None
                size = f.size()
                n = min(HEAD, size)
                head = head_of(f, n)
                # what was there at the last look needn't be searched again
                same = old and old["id"] == id_ and old["n"] <= n and old["byte"] <= size
                same = same and (head if old["n"] == n else head_of(f, old["n"])) == old["head"]
                return {"id": id_, "n": n, "head": head, "size": size, "byte": last_line_end(f, old["byte"] if same else 0, size)}
        except FileNotFoundError:
            return None

    def latestOffset(self) -> dict:
        files, root = opened(self.path)
        with tempfile.TemporaryDirectory(prefix="growing-") as lists, ThreadPoolExecutor(LISTERS) as pool:
            parts, looked = self._listed(files, root, lists), []
            for n in range(parts):
                old = self._files(self._seen, n, parts) if len(self._seen) == parts else {}
                found = [(path, id_, old.get(path)) for path, id_ in lines_in(f"{lists}/{n}")]
                about = each(lambda x: self._about(files, *x), found, pool)
                now = {path: own for (path, _, _), own in zip(found, about) if own}
                ids = {own["id"] for own in now.values()}
                # what has moved since stays as it was until the next look finds it, unless this one has found it already
                now |= {path: was for (path, _, was), own in zip(found, about) if was and not own and was["id"] not in ids}
                text = json.dumps(now, sort_keys=True)
                looked.append(self._state.put(text) if self._state else text)
        self._seen = looked
        return {"parts": ",".join(looked)} if self._state else {"files": looked[0]}

    def _listed(self, files: fs.FileSystem, root: str, lists: str) -> int:
        """Write (path, id) of the wanted files to a list for each part; returns how many parts they are."""
        count = 0
        with open(f"{lists}/all", "w") as out:
            for path, name, id_ in files_below(files, root):
                if self._taken(name):
                    out.write(json.dumps([path, id_]) + "\n")
                    count += 1
        if not self._state or count <= self.most:
            os.rename(f"{lists}/all", f"{lists}/0")
            return 1
        parts = 1 << (-(-count // self.most) - 1).bit_length()
        found = lines_in(f"{lists}/all")
        while some := list(islice(found, self.most)):
            by_part: dict[int, list[str]] = {}
            for x in some:
                by_part.setdefault(part_of(x[1], parts), []).append(json.dumps(x) + "\n")
            for n, lines in by_part.items():
                with open(f"{lists}/{n}", "a") as out:
                    out.writelines(lines)
        return parts

    def _taken(self, name: str) -> bool:
        hidden = name.startswith((".", "_"))
        return not hidden and any(fnmatch(name, x) for x in self.only) and not any(fnmatch(name, x) for x in self.but)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Files that change place stay in their part, as their ids decide it, so that no part needs another."""
        before, now = parts_of(start), parts_of(end)
        of, total, pieces = max(len(before), len(now)), 0, []
        with ThreadPoolExecutor(LISTERS) as pool:
            for n in range(of):
                if len(before) == len(now) and before[n] == now[n]:
                    continue
                found = self._ranges(self._files(before, n, of), self._files(now, n, of), pool)
                total += sum(map(weight, found))
                pieces.append(packed(found))
        ranges = (r for piece in pieces for r in unpacked(piece))
        return list(together(ranges, total, self.split, self.tasks))

    def _ranges(self, before: dict[str, dict], now: dict[str, dict], pool: ThreadPoolExecutor) -> list[tuple[str, int, int]]:
        files, _ = opened(self.path)
        by_id: dict[str, list[str]] = {}
        for path, own in before.items():
            by_id.setdefault(own["id"], []).append(path)

        def head(path: str, n: int) -> int:
            with files.open_input_file(path) as f:
                return head_of(f, n)

        changed = [p for p, own in sorted(now.items()) if before.get(p) != own]
        starts = each(lambda p: begun(p, now, before, by_id, head), changed, pool)
        out = []
        for path, a in zip(changed, starts):
            end = now[path]["byte"]
            out += [(path, x, min(x + self.split, end)) for x in range(a, end, self.split)]
        return out

    def read(self, partition: Ranges):
        """Lines of many small files in one batch."""
        values, paths = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(paths, pa.string())], names=["value", "file"])

        root, _ = opened(self.path)
        for path, start, end in partition.ranges:
            with root.open_input_file(path) as f:
                for lines in lines_of(f, start, end):
                    values += [x.decode("utf-8", "replace") for x in lines]
                    paths += [path] * len(lines)
                    if len(values) >= LINES_A_BATCH:
                        yield batch()
                        values, paths = [], []
        if values:
            yield batch()

    def commit(self, end: dict) -> None:
        if self._state:
            self._state.commit(parts_of(end), self._seen)


def lines_in(path: str) -> Iterator[list[str]]:
    """The JSON lines of a list, if there is one."""
    if os.path.exists(path):
        with open(path) as f:
            yield from map(json.loads, f)


def lines_of(file: pa.NativeFile, start: int, end: int):
    """Lists of the lines that start in [start, end), without their ends, a block at a time."""
    at = start
    if start:  # a line that began before belongs to the range before
        file.seek(start - 1)
        if file.read(1) != b"\n":
            while (block := file.read(BLOCK)) and b"\n" not in block:
                at += len(block)
            at += block.find(b"\n") + 1
    file.seek(at)
    rest = b""
    while at < end:
        block = file.read(min(BLOCK, end - at))
        if not block:
            break
        at += len(block)
        *lines, rest = (rest + block).split(b"\n")
        if lines:
            yield [x.removesuffix(b"\r") for x in lines]
    while rest and (block := file.read(1 << 16)):  # the last line goes on in the next range
        line, end_of_line, _ = block.partition(b"\n")
        rest += line
        if end_of_line:
            yield [rest.removesuffix(b"\r")]
            return


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def growing_files(
    spark: SparkSession, path: str, only: str = "*", but: str = "", split_bytes: int = SPLIT_BYTES, state: str | None = None
) -> DataFrame:
    """value, file: lines of the files below a folder as they grow. state: a folder beside the checkpoint, for many files."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("path", path).option("only", only).option("but", but)
    reader = reader.option("state", state) if state else reader
    tasks = spark.sparkContext.defaultParallelism
    return reader.option("splitBytes", str(split_bytes)).option("tasks", str(tasks)).load()
