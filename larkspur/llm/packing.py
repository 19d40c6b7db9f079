"""Best-fit packing of documents into sequences by linear grouping.

Tokenised documents become pieces of at most `capacity` tokens. `plan` sees only how many pieces there are of
each length (at most `capacity` numbers, whatever the corpus holds). Full pieces are sequences of their own; the
others go in four steps: pieces longer than `small` are put in descending order into groups of equal
cardinality, whose lengths are rounded up to the group's largest; sequences of few such sizes are optimised, each
time the fullest that holds the largest remaining size, as often as the counts allow; the groups' actual pieces are
substituted, which gives back the rounding; then pieces of up to `small` tokens go, longest first, where the least
room is left. Several numbers of groups and shares of the capacity that count as small are tried, and the plan of
fewest sequences stays. It says for each run of equally long pieces which run of sequences it goes to, so each executor places its
own pieces.

Null texts count as empty (one piece that holds the end id). Repeated doc_ids are separate documents. An empty
table gives no pieces. Further columns of the input are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.encoding import END_ID, encoded, text_slices
from larkspur.llm.shared import giving_back, materialize, plain, worker_for

CAPACITY = 1024
GROUPS = (32, 256)
SMALL_SHARES = (0.25, 0.375, 0.5)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("part", pa.int32()), ("local_rank", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, share: float = 1.0) -> DataFrame:
    """One row per piece; local_rank numbers the pieces of one length within a partition. Only the first piece may be short.

    share: of the slices and caches that a worker holds by default.
    """
    end = END_ID.to_bytes(4, "little")

    def cut(batches):
        worker_for("tokens")
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for rows in text_slices(batch, 1, share):
                out = []
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoded(tokenizer, rows.column(1).to_pylist(), share)):
                    data = memoryview(ids + end)
                    n = len(data) // 4
                    start, k = 0, 0
                    length = n % capacity or capacity
                    while start < n:
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        out.append((doc_id, k, start, length, crc, part, int(seen[length])))
                        seen[length] += 1
                        start, k, length = start + length, k + 1, capacity
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(giving_back(cut), PIECE + ", part int, local_rank long")


def _fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest multiset of the sizes in counts that holds the largest one: {size: times}."""
    top = max(counts)
    room = capacity - top
    reach, steps = 1, []  # bit s: sum s can be made
    for size in sorted(counts, reverse=True):
        times, k = min(counts[size] - (size == top), room // size), 1
        while times > 0:
            k = min(k, times)
            steps.append((reach, size, k))
            reach |= (reach << (size * k)) & ((1 << (room + 1)) - 1)
            times, k = times - k, 2 * k
        if reach >> room:
            break
    left, used = reach.bit_length() - 1, defaultdict(int, {top: 1})
    for before, size, k in reversed(steps):
        if not before >> left & 1:
            left -= size * k
            used[size] += k
    return used


Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """(length, first rank, pieces, first sequence, offset) for runs of pieces, and the number of sequences: the best grouped()."""
    plans = [grouped(histogram, capacity, groups, int(share * capacity)) for share in SMALL_SHARES for groups in GROUPS]
    return min(plans, key=lambda p: p[1])


def grouped(histogram: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[Run], int]:
    """plan() with so many groups of pieces that are longer than small."""
    lengths = sorted((x for x in histogram if small < x < capacity and histogram[x]), reverse=True)
    # runs of equal length in descending order; the rank of a piece among all large ones decides its group
    ends, total = [], 0
    for x in lengths:
        total += histogram[x]
        ends.append(total)
    firsts = [0, *ends[:-1]] if len(ends) <= groups else list(range(0, total, -(-total // groups)))  # few lengths: no rounding
    counts: dict[int, int] = defaultdict(int)
    by_size: dict[int, list[list[int]]] = defaultdict(list)  # rounded size: runs of ranks [from, to)
    for first, last in zip(firsts, [*firsts[1:], total]) if total else ():
        size = lengths[int(np.searchsorted(ends, first, side="right"))]
        counts[size] += last - first
        by_size[size].append([first, last])
    blocks: list[tuple[int, list[tuple[int, int]]]] = []  # (sequences, [(length, first rank within its length)])
    if full := histogram.get(capacity):
        blocks.append((full, [(capacity, 0)]))

    def take(size: int, n: int) -> list[tuple[int, int]]:
        """The next n pieces of a rounded size as runs (first rank, pieces)."""
        out = []
        while n:
            run = by_size[size][0]
            k = min(n, run[1] - run[0])
            out.append((run[0], k))
            run[0] += k
            n -= k
            if run[0] == run[1]:
                by_size[size].pop(0)
        return out

    while counts:
        used = _fullest(counts, capacity)
        times = min(counts[s] // k for s, k in used.items())
        slots = []
        for size, k in used.items():
            counts[size] -= k * times
            if not counts[size]:
                del counts[size]
            slots += [take(size, times) for _ in range(k)]
        # split where any slot's actual length changes
        cuts, lanes = {0, times}, []
        for runs in slots:
            lane, done = [], 0
            for first, n in runs:
                while n:
                    i = int(np.searchsorted(ends, first, side="right"))
                    k = min(n, ends[i] - first)
                    lane.append((done, lengths[i], first - (ends[i - 1] if i else 0)))
                    cuts.add(done)
                    done, first, n = done + k, first + k, n - k
            lanes.append(lane)
        marks, index = sorted(cuts), [0] * len(lanes)
        for a, b in zip(marks, marks[1:]):
            parts = []
            for j, lane in enumerate(lanes):
                while index[j] + 1 < len(lane) and lane[index[j] + 1][0] <= a:
                    index[j] += 1
                begin, length, rank = lane[index[j]]
                parts.append((length, rank + a - begin))
            blocks.append((b - a, parts))

    # best fit of the small ones: open blocks by the room they have left
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for block in blocks:
        room[capacity - sum(x for x, _ in block[1])].append(block)
    for length in sorted((x for x in histogram if x <= min(small, capacity - 1) and histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        gaps = [x for x in room if x >= length and room[x]]
        heapq.heapify(gaps)
        while left:
            while gaps and not room[gaps[0]]:
                heapq.heappop(gaps)
            if gaps:
                gap = gaps[0]
                n, parts = room[gap].pop()
            else:
                gap, n, parts = capacity, -(-left // (capacity // length)), []
            k = min(n, left)
            each = max(1, min(gap // length, left // k))
            placed = parts + [(length, rank + i * k) for i in range(each)]
            if k < n:  # the rest of the block stays as it was
                room[gap].append((n - k, [(x, r + k) for x, r in parts]))
                if gap not in gaps:
                    heapq.heappush(gaps, gap)
            rank, left = rank + each * k, left - each * k
            rest = gap - each * length
            room[rest].append((k, placed))
            if rest >= length and rest not in gaps:
                heapq.heappush(gaps, rest)
    rows, sequence = [], 0
    for kept in room.values():
        for n, parts in kept:
            offset = 0
            for length, rank in parts:
                rows.append((length, rank, n, sequence, offset))
                offset += length
            sequence += n
    return rows, sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, share: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes."""
    cut = materialize(pieces(docs, tokenizer, capacity, share), "pieces")
    counts = cut.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = rows[:, 0] << 44 | rows[:, 1]  # (length, first rank), ascending

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = (F.col("base") + F.col("local_rank")).alias("rank")
    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", rank)

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(rows[i, 3] + rank - rows[i, 1]), pa.array(rows[i, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")
