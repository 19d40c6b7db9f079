"""Exact removal of repeated byte strings by suffix arrays over content-defined groups.

Every string of `length` bytes has an anchor: the GRAM bytes in it whose hash is least (the first of equals), so
equal strings have equal anchors at equal places, wherever they stand. A document is thus cut into segments, the
bytes of consecutive strings with one anchor, and only segments with equal anchors can share strings.

1. Blocks of documents send one row of numbers per anchor; anchors of a single block stop there. Where an anchor
   has the same segment everywhere, the smallest doc_id is enough to decide.
2. Blocks send the other anchors' segments, each distinct one once; a very common anchor is dealt to several
   problems, PROBLEM segments or so each. Each problem's segments are one text, whose suffix array
   (suffix_array.py: linear grouping) puts equal strings next to each other.
3. Of anchors dealt to several problems, the first holder of each distinct string meets the others' once more by
   the string's hash and the first one is kept.
4. Each block takes the decided strings out of its documents.

No group grows with the number of copies: blocks and problems send one entry for whatever they hold several
times. A row goes from a block to each bucket that it has anchors for, so there are never more rows than anchors. All
texts are read whole; long documents are taken in pieces that overlap by length - 1 bytes.

Null texts count as empty. doc_ids that are null count as larger than all others; rows with equal doc_id remove
nothing from each other. Strings with different bytes are told apart by 96 bits of hashes or byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.hashing import BYTE, ODD, mix, prefix, run_hash
from larkspur.llm.shared import giving_back, partitions, plain, worker_for
from larkspur.llm.suffix_array import suffix_arrays

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 2 << 20
PIECE = 1 << 18
BUCKET_ANCHORS = 250_000
PROBLEM = 64
TASK_BYTES = 32 << 20
BATCH = 1 << 19
NO_ID = np.iinfo(np.int64).max
PASSED = "dest long, src long, kind int, payload binary"
_PASSED = pa.schema([("dest", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
LOCAL, REPLY, SEGMENTS, STRINGS = range(4)
_ANCHOR = np.uint64((1 << 48) - 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each laid out byte by byte, so that high bytes that are all 0 compress away."""
    n = len(arrays[0])
    head = np.array([n, len(arrays)], "<u4").tobytes() + "".join(a.dtype.str.ljust(4) for a in arrays).encode()
    return head + b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(n, a.itemsize).T).tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(data, "<u4", 2)
    at, out = 8 + 4 * int(k), []
    for i in range(k):
        kind = np.dtype(data[8 + 4 * i : 12 + 4 * i].decode().strip())
        size = int(n) * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at += size
    return out


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_PASSED)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PASSED)], schema=_PASSED)


class Block:
    """The documents of one block in a fixed order, as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.order = order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.keys = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        self.bounds = np.cumsum([0] + [len(texts[i]) for i in order])
        self.data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)

    def segments(self, length: int, gram: int) -> list[np.ndarray]:
        """anchor, segment hash, document row, start in the block, bytes, of each segment."""
        size = len(self.data)
        found = [_segments(self.data, self.bounds, a, min(a + PIECE, size), length, gram) for a in range(0, size, PIECE)]
        return [np.concatenate(c) for c in zip(*found)] if found else _no_segments()


def _no_segments() -> list[np.ndarray]:
    return [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]


def _segments(data: np.ndarray, bounds: np.ndarray, first: int, last: int, length: int, gram: int):
    """Segments of the strings that start in [first, last)."""
    raw = data[first : last + length - 1]
    if len(raw) < length:
        return _no_segments()
    values = BYTE[raw]
    # hashes of runs of 1, 2, 4, ... bytes, put together to `gram` bytes
    h, have, run, step, bit = None, 0, values, 1, gram
    while True:
        if bit & 1:
            more = run[have : len(raw) - step + 1]
            h = more if h is None else h[: len(raw) - have - step + 1] * ODD[2 + step.bit_length()] + more
            have += step
        bit >>= 1
        if not bit:
            break
        run = run[:-step] * ODD[12 + step.bit_length()] + run[step:]
        step *= 2
    h = mix(h)
    width = length - gram + 1
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    n, step = len(h) - width + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n)
    row = np.searchsorted(bounds, start + first, side="right") - 1
    whole = start + first + length <= bounds[row + 1]
    start, at, row = start[whole], at[whole], row[whole]
    if not len(start):
        return _no_segments()
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    begin, end, at, row = start[a], start[np.append(a[1:], len(start)) - 1] + length, at[a], row[a]
    content = run_hash(prefix(values), begin, end) + (at - begin).astype(np.uint64) * ODD[1]
    # least hashes are small numbers: mixed again, they spread evenly over the buckets
    return [mix(h[at]) >> np.uint64(16), content, row, begin + first, end - begin]


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    first = _firsts(sorted_)
    return list(zip(sorted_[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_)).tolist()))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Anchors:
    """A block's segments in the order of anchor, content and document, with one entry for each anchor."""

    def __init__(self, block: Block, length: int, gram: int):
        anchor, content, row, start, size = block.segments(length, gram)
        by = np.lexsort((row, content, anchor))
        self.anchor, self.content, self.row, self.start, self.size = (x[by] for x in (anchor, content, row, start, size))
        self.first = _firsts(self.anchor)
        self.kind_first = _firsts(self.anchor, self.content)  # one for each distinct segment
        self.of_kind = np.repeat(np.arange(len(self.kind_first)), np.diff(np.append(self.kind_first, len(anchor))))
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(anchor))))
        self.kinds = np.bincount(self.of[self.kind_first], minlength=len(self.first))
        self.key = block.keys[self.row]
        self.least = np.minimum.reduceat(self.key, self.first) if len(self.first) else self.key
        self.most = np.maximum.reduceat(self.key, self.first) if len(self.first) else self.key


def _scaled(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 48-bit numbers each lies in, in whole numbers."""
    high, low = x >> np.uint64(24), x & np.uint64((1 << 24) - 1)
    return ((high * np.uint64(n) + (low * np.uint64(n) >> np.uint64(24))) >> np.uint64(24)).astype(np.int64)


def _send_anchors(length: int, gram: int, buckets: int):
    def run(key, table):
        worker_for("suffix_dedup")
        own = _Anchors(Block(table), length, gram)
        anchor = own.anchor[own.first]
        kinds = np.minimum(own.kinds, 65535).astype("<u2")
        content = own.content[own.first] >> np.uint64(16)
        rows, me = [], key[0].as_py()
        for b, x, y in _runs(_scaled(anchor, buckets)):
            rows.append((-1 - b, me, x, _pack(anchor[x:y].astype("<u8"), content[x:y], own.least[x:y], kinds[x:y])))
        return _rows(rows)

    return run


def _judge_anchors(problem: int):
    """For each block and anchor that another block has too: 1 the one segment's first holder is here, 2 it is elsewhere,
    2 + n dealt to n problems."""

    def run(key, table):
        worker_for("suffix_dedup")
        parts = [_unpack(x) for x in table.column("payload").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        anchor, content, least, kinds = (np.concatenate(c) for c in zip(*parts))
        source = np.repeat(np.arange(len(parts)), sizes)
        index = np.concatenate([np.arange(n) + x for n, x in zip(sizes, table.column("kind").to_pylist())])
        by = np.argsort(anchor, kind="stable")
        first = _firsts(anchor[by])
        count = np.diff(np.append(first, len(by)))
        keep = np.repeat(count > 1, count)
        by, count = by[keep], count[count > 1]
        if not len(by):
            return _rows([])
        first = np.cumsum(count) - count
        low = np.repeat(np.minimum.reduceat(least[by], first), count)
        one = np.maximum.reduceat(kinds[by], first) == 1
        same = one & (np.minimum.reduceat(content[by], first) == np.maximum.reduceat(content[by], first))
        problems = -(-np.add.reduceat(kinds[by].astype(np.int64), first) // problem)
        code = np.where(np.repeat(same, count), np.where(least[by] == low, 1, 2), 2 + np.repeat(problems, count))
        src = table.column("src").to_pylist()
        order = np.argsort(source[by], kind="stable")
        by, code = by[order], code[order]
        rows, cuts = [], np.searchsorted(source[by], np.arange(len(parts) + 1))
        for i in range(len(parts)):
            x, y = cuts[i], cuts[i + 1]
            if x < y:
                rows.append((src[i], key[0].as_py(), REPLY, _pack(index[by[x:y]].astype("<u4"), code[x:y].astype("<u4"))))
        return _rows(rows)

    return run


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Overlapping or touching spans of one document joined."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], end[by]
    if not len(row):
        return [row.astype("<u4"), start.astype("<u4"), end.astype("<u4")]
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(row), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    a = np.flatnonzero(new)
    return [row[a].astype("<u4"), start[a].astype("<i8"), (reach - shift)[np.append(a[1:], len(row)) - 1].astype("<i8")]


def _send_segments(length: int, gram: int, buckets: int):
    def run(key, texts, replies):
        worker_for("suffix_dedup")
        if not texts.num_rows:
            return _rows([])
        block = Block(texts)
        own = _Anchors(block, length, gram)
        code = np.where(own.least == own.most, 0, np.where(own.kinds == 1, 1, 3))  # what the block knows by itself
        for data in replies.column("payload").to_pylist():
            index, told = _unpack(data)
            code[index] = told
        each = code[own.of]
        kind_least = np.minimum.reduceat(own.key, own.kind_first) if len(own.kind_first) else own.key
        later = own.key > kind_least[own.of_kind] if len(own.key) else np.zeros(0, bool)
        gone = (each == 2) | ((each > 0) & later)
        open_ = (each > 2) & ~later
        # one entry for each distinct segment; all its places in the first document wait for the answer
        kind_open = np.unique(own.of_kind[open_])
        entry = np.searchsorted(kind_open, own.of_kind[open_])
        gone_spans = _merged(own.row[gone], own.start[gone], own.start[gone] + own.size[gone])
        me = key[0].as_py()
        spans = _pack(*gone_spans)
        waiting = _pack(entry.astype("<u4"), own.row[open_].astype("<u4"), own.start[open_].astype("<i8"))
        rows = [(me, me, LOCAL, np.array([len(spans)], "<u4").tobytes() + spans + waiting)]
        head = own.kind_first[kind_open]
        salt = own.content[head] % (code[own.of[head]] - 2).astype(np.uint64)
        problem = mix(own.anchor[head] + salt * ODD[3])
        split = (code[own.of[head]] > 3).astype("<u1")
        bucket = (problem % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        for b, x, y in _runs(bucket[by]):
            i = by[x:y]
            h = head[i]
            size = own.size[h]
            at = np.repeat(own.start[h] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            numbers = _pack(problem[i], own.content[h], own.key[h], i.astype("<u4"), size.astype("<u2"), split[i])
            rows.append((-1 - b, me, SEGMENTS, np.array([len(numbers)], "<u4").tobytes() + numbers + block.data[at].tobytes()))
        return _rows(rows)

    return run


def _classes(problem: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, length: int):
    """For each string of each segment: (segment, place in it, least key among equal strings of its problem).

    Problems are runs.
    """
    cut = _firsts(problem)
    out = []
    counts = np.diff(np.append(cut, len(problem)))
    bytes_of = np.add.reduceat(size + 1, cut)
    order = np.argsort(bytes_of, kind="stable")  # problems of like size advance together
    load = np.cumsum(bytes_of[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + BATCH, side="right")))
        some = order[at:end]
        at = end
        n = counts[some]
        seg = np.repeat(cut[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        length_of = size[seg]
        put = np.cumsum(length_of + 1) - length_of - 1
        last = np.zeros(len(seg), bool)
        last[np.cumsum(n) - 1] = True
        symbols = np.where(np.repeat(last, length_of + 1), 0, 1)  # what follows a segment; the rest is written over
        inside = np.arange(int(length_of.sum())) - np.repeat(np.cumsum(length_of) - length_of, length_of)
        place = np.repeat(put, length_of) + inside
        text = data[np.repeat(begin[seg], length_of) + inside]
        symbols[place] = text.astype(np.int64) + 2
        starts = np.append(put[np.concatenate([[0], np.cumsum(n)[:-1]])], len(symbols))
        sa = suffix_arrays(symbols, starts)
        owner = np.repeat(np.arange(len(seg)), length_of + 1)
        within = np.arange(len(symbols)) - put[owner]
        is_string = within + length <= length_of[owner]
        sa = sa[is_string[sa]]
        if not len(sa):
            continue
        of = np.searchsorted(starts, sa, side="right")
        # neighbours in the suffix array are equal strings if all their bytes are
        same = of[1:] == of[:-1]
        for k in range(length):
            i = np.flatnonzero(same)
            same[i] = symbols[sa[i] + k] == symbols[sa[i + 1] + k]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        keys = key[seg][owner[sa]]
        least = np.repeat(np.minimum.reduceat(keys, first), np.diff(np.append(first, len(sa))))
        out.append((seg[owner[sa]], within[sa], least))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _reply(source: np.ndarray, entry: np.ndarray, start: np.ndarray, end: np.ndarray, me: int) -> list[tuple[int, int, int, bytes]]:
    """Rows that tell blocks which bytes of their entries go."""
    by = np.lexsort((start, entry, source))
    source, entry, start, end = source[by], entry[by], start[by], end[by]
    cuts = _firsts(source)
    told = lambda x, y: _pack(entry[x:y].astype("<u4"), start[x:y].astype("<u2"), end[x:y].astype("<u2"))
    return [(int(source[x]), me, REPLY, told(x, y)) for x, y in zip(cuts, np.append(cuts[1:], len(source)))]


def _sort_segments(length: int, buckets: int):
    def run(key, table):
        worker_for("suffix_dedup")
        me = key[0].as_py()
        if me >= 0:  # a block's own spans pass through
            return table
        numbers, texts, sources = [], [], []
        for src, data in zip(table.column("src").to_pylist(), table.column("payload").to_pylist()):
            n = int(np.frombuffer(data, "<u4", 1)[0])
            numbers.append(_unpack(data[4 : 4 + n]))
            texts.append(np.frombuffer(data, np.uint8, offset=4 + n))
            sources.append(np.full(len(numbers[-1][0]), src))
        problem, content, id_, entry, size, split = (np.concatenate(c) for c in zip(*numbers))
        data, source, size = np.concatenate(texts), np.concatenate(sources), size.astype(np.int64)
        begin = np.cumsum(size) - size
        by = np.lexsort((id_, content, problem))
        problem, content, id_, entry = problem[by], content[by], id_[by], entry[by]
        size, split, source, begin = size[by], split[by], source[by], begin[by]
        head = _firsts(problem, content)
        of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(by))))
        again = id_ > id_[head][of]  # a segment that a smaller document has goes whole
        none = np.zeros(int(again.sum()), np.int64)
        rows = _reply(source[again], entry[again], none, size[again], me) if again.any() else []
        # the others of equal ids are one segment below, and what goes there goes from each of them
        holders = np.flatnonzero(~again)
        cut = _firsts(problem[head])
        count = np.diff(np.append(cut, len(head)))
        many = np.repeat(count > 1, count) | (split[head] > 0)
        kept = head[many]
        if not len(kept):
            return _rows(rows)
        holders = holders[many[of[holders]]]
        holder_of = (np.cumsum(many) - 1)[of[holders]]
        problem, id_, size, split, begin = problem[kept], id_[kept], size[kept], split[kept], begin[kept]
        seg, at, least = _classes(problem, data, begin, size, id_, length)

        def held(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Segment, place in it and holder of the chosen strings, once for each holder, in order."""
            s, a = seg[which], at[which]
            order = np.lexsort((a, s))
            s, a = s[order], a[order]
            x, y = np.searchsorted(s, holder_of, side="left"), np.searchsorted(s, holder_of, side="right")
            i = np.repeat(x - np.cumsum(y - x) + (y - x), y - x) + np.arange(int((y - x).sum()))
            return s[i], a[i], np.repeat(holders, y - x)

        gone = id_[seg] > least
        s, a, h = held(gone)
        if len(s):
            runs = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1] + 1)]))
            ends = a[np.append(runs[1:], len(s)) - 1] + length
            rows += _reply(source[h[runs]], entry[h[runs]], a[runs], ends, me)
        # first holders of strings whose anchor was dealt to several problems meet the others by the string's hash
        s, a, h = held(~gone & (split[seg] > 0))
        if len(s):
            start = begin[s] + a
            name, check = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
            for k in range(length):
                byte = BYTE[data[start + k]]
                name, check = name * ODD[4] + byte, mix(check + byte)
            name = mix(name)
            to = (name % np.uint64(buckets)).astype(np.int64)
            check = (check >> np.uint64(32)).astype("<u4")
            by = np.argsort(to, kind="stable")
            for b, x, y in _runs(to[by]):
                i = by[x:y]
                rows.append((-1 - b, me, STRINGS, _pack(name[i], check[i], id_[s[i]], source[h[i]], entry[h[i]], a[i].astype("<u2"))))
        return _rows(rows)

    return run


def _meet_strings(length: int):
    def run(key, table):
        worker_for("suffix_dedup")
        me = key[0].as_py()
        if me >= 0:
            return table
        parts = [_unpack(x) for x in table.column("payload").to_pylist()]
        name, check, id_, source, entry, at = (np.concatenate(c) for c in zip(*parts))
        by = np.lexsort((id_, check, name))
        first = _firsts(name[by], check[by])
        least = np.repeat(id_[by][first], np.diff(np.append(first, len(by))))
        gone = by[id_[by] > least]
        at = at.astype(np.int64)
        return _rows(_reply(source[gone], entry[gone], at[gone], at[gone] + length, me) if len(gone) else [])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _take_out(with_text: bool, carried: bool):
    def run(key, texts, told):
        worker_for("suffix_dedup")
        block = Block(texts)
        change = np.zeros(len(block.data) + 1, np.int32)
        entry = row = start = np.zeros(0, np.int64)
        replies = []
        for kind, data in zip(told.column("kind").to_pylist(), told.column("payload").to_pylist()):
            if kind == LOCAL:
                n = int(np.frombuffer(data, "<u4", 1)[0])
                _, a, b = _unpack(data[4 : 4 + n])
                np.add.at(change, a.astype(np.int64), 1)
                np.add.at(change, b.astype(np.int64), -1)
                entry, row, start = _unpack(data[4 + n :])
            else:
                replies.append(_unpack(data))
        if replies and len(entry):
            by = np.argsort(entry, kind="stable")
            entry, start = entry[by], start[by].astype(np.int64)
            e, a, b = (np.concatenate(c).astype(np.int64) for c in zip(*replies))
            x, y = np.searchsorted(entry, e, side="left"), np.searchsorted(entry, e, side="right")
            n = y - x
            place = start[np.repeat(x - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            np.add.at(change, place + np.repeat(a, n), 1)
            np.add.at(change, place + np.repeat(b, n), -1)
        keep = np.cumsum(change[:-1]) == 0
        out = []
        for i, doc_id in enumerate(block.ids):
            x, y = block.bounds[i], block.bounds[i + 1]
            k = keep[x:y]
            left = block.data[x:y][k].tobytes()
            spans = int((~k[:1]).sum() + (k[:-1] & ~k[1:]).sum())
            row = (doc_id, int(y - x), int(y - x) - len(left), spans, hashlib.sha256(left).hexdigest())
            out.append(row + ((left.decode("utf-8", "ignore"),) if with_text else ()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        width = 5 + with_text
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * width, kinds)]
        if carried:
            columns.append(texts.column("carried").take(pa.array(block.order, pa.int64())).combine_chunks())
        return pa.Table.from_arrays(columns, names=names[:width] + ["carried"] * carried)

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    with_text: bool = True,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    problem: int = PROBLEM,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (without cut characters).

    carry: columns of docs that come along, in a struct named `carried`.

    Every byte goes that lies in a string of `length` bytes which also starts in a document of smaller doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", *([F.struct(*carry).alias("carried")] if carry else []))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    blocks = max(1, -(-total // block_bytes))  # by the data alone: a row goes from each block to each bucket
    buckets = max(1, -(-total // (16 * BUCKET_ANCHORS)))
    name = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks))
    n = max(n, -(-total // TASK_BYTES))  # a task's share stays the same, however large the input
    texts = docs.withColumn("block", name).repartition(n, "block")
    by_block = texts.groupBy("block")

    def dealt(rows: DataFrame):
        return rows.repartition(n, "dest").groupBy("dest")

    anchors = by_block.applyInArrow(giving_back(_send_anchors(length, gram, buckets)), PASSED)
    judged = dealt(anchors).applyInArrow(giving_back(_judge_anchors(problem)), PASSED)
    segments = by_block.cogroup(dealt(judged)).applyInArrow(giving_back(_send_segments(length, gram, buckets)), PASSED)
    sorted_ = dealt(segments).applyInArrow(giving_back(_sort_segments(length, buckets)), PASSED)
    told = dealt(sorted_).applyInArrow(giving_back(_meet_strings(length)), PASSED)
    schema = RESULT + ", kept_text string" * with_text
    if carry:
        schema += f", carried {docs.schema['carried'].dataType.simpleString()}"
    return by_block.cogroup(dealt(told)).applyInArrow(giving_back(_take_out(with_text, bool(carry))), schema)
