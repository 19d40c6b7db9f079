"""Token ids of texts, with each distinct blank-separated unit of a slice of text looked at once.

Both public BPE files split a text before a blank that is followed by a visible character, so a text's
ids are its units' ids joined. Arrow splits a slice of texts into units, numbers the distinct ones and joins their ids
again. The distinct ones of Latin letters, digits, signs and line ends are cut as the pre-tokenizers do, all at once, and what
that gives is looked up in a bounded cache; only unknown pieces reach the library's BPE model. Other units, and those of texts
with further blanks beside a blank, have caches of their own and reach the library as they are.

A full cache becomes the former one, which a new one takes over from what is used again: words
that come back stay, those seen once go, and a worker never holds more than two caches and one slice of text. `share` makes
both smaller, for workers beside which an executor holds much else; ids are the same.

`encoded` gives what the library gives by default: a special token's text within a text becomes that token, and
what stands before and after it is encoded as texts of their own. `UnitEncoder` takes such a text literally.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm.shared import clears

END_ID = 2
CACHE_UNITS = 100_000
CACHE_PIECES = 300_000  # a piece costs a call of the model, a plain unit two look-ups
SLICE_CHARS = 4_000_000  # the more, the fewer times a unit is looked at
_BORDER = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?=\s|$)")
_WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)"
_PLAIN = re.compile(rf"{_WORD}(?:\n{_WORD})?")
# the byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for U+0100 and on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
# of a tokenizer that cuts lower-cased words apart with this pattern, and what the pattern finds in plain lower-cased text
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
# what both pre-tokenizers make of plain units that are joined by blanks; each unit begins with a piece that begins with its blank
_WORD_PIECES = re.compile(_PLAIN_WORDS.pattern + "| ")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_MARK = b"\xff" * 4  # stands before the ids of a piece that begins a unit; no token has this id
_encoders: dict[str, "UnitEncoder"] = {}
clears(_encoders.clear)


class UnitEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            # a byte-level vocabulary keeps the blank before a word as part of it
            data = json.load(f)
        self.lead = " " if data["pre_tokenizer"]["type"] == "ByteLevel" else ""
        cutters = data["pre_tokenizer"].get("pretokenizers") or [{}]
        self.bytewise = data["pre_tokenizer"] == BYTE_LEVEL and data["normalizer"] is None
        self.words = cutters[0].get("pattern", {}).get("Regex") == WORD_PATTERN  # plain_words() knows what it does
        added = data["added_tokens"]
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that look at what stands beside them")
        self.special = {a["content"]: a["id"].to_bytes(4, "little") for a in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + ("|".join(map(re.escape, longest)) or "(?!)") + ")")
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.line_end = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        self.share = 1.0
        self.pieces, self.first, self.rest = {}, {}, {}
        self._renew_units()
        self._renew_pieces()

    def units(self, text: str) -> list[str]:
        """Parts before the blanks; a blank that no visible character follows stays within the part before it."""
        parts = text.split(" ")
        if not self.lead or not _ODD.search(text):
            return parts
        out = parts[:1]
        for x in parts[1:]:
            if not x or x[0].isspace():
                out[-1] += " " + x
            else:
                out.append(x)
        return out

    def plain_words(self, text: str) -> tuple[list[str], list[str]]:
        """What the model sees of the plain units of a text, and the other units; for a tokenizer with `words`."""
        odd: list[str] = []
        if not _PLAIN_TEXT.fullmatch(text):
            units = text.split(" ")
            odd = [u for u in units if not _PLAIN_TEXT.fullmatch(u)]
            text = " ".join([u for u in units if _PLAIN_TEXT.fullmatch(u)])
        return _PLAIN_WORDS.findall(text.lower()), odd

    def pre_tokens(self, unit: str) -> tuple[str, ...]:
        """What the model sees of a unit, one after another."""
        normal = self.tokenizer.normalizer
        return tuple([t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(unit) if normal else unit)])

    def _renew_units(self) -> None:
        """Begin new caches of units and keep those so far as the former ones."""
        self.former_first, self.former_rest = self.first, self.rest
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {} if self.lead else self.first
        self.held_units = 0  # a long one counts as several

    def _renew_pieces(self) -> None:
        self.former_pieces = self.pieces
        self.pieces: dict[str, bytes] = {}
        self.held_pieces = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.held_units > self.share * CACHE_UNITS:
            self._renew_units()
        if self.held_pieces > self.share * CACHE_PIECES:
            self._renew_pieces()
        if not (self.words or self.bytewise):
            return self._units(texts)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at, units = split.offsets.to_numpy(), split.values
        rest = np.ones(len(units), bool)
        rest[at[:-1]] = False
        coded = units.filter(pa.array(rest)).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.lead and not all([u and not u[0].isspace() for u in names]):  # a blank beside another
            out = dict.fromkeys(range(len(texts)), b"")
            for some, encode in (([i for i in out if _ODD.search(texts[i])], self._units), ([i for i in out if not _ODD.search(texts[i])], self.encode)):
                if some:
                    out.update(zip(some, encode([texts[i] for i in some]), strict=True))
            return list(out.values())
        heads = units.take(pa.array(at[:-1])).to_pylist()
        self._learn(self.first, self.former_first, set(heads), "")
        ids = self._joined(names).take(coded.indices)
        data, ends = memoryview(ids.buffers()[2] or b""), np.zeros(len(at), np.int64)
        if len(ids):
            ends = np.frombuffer(ids.buffers()[1], np.int64)[at - np.arange(len(at))]
        ends, first = ends.tolist(), self.first
        return [first[x] + data[a:b] for x, a, b in zip(heads, ends, ends[1:])]

    def _joined(self, units: list[str]) -> pa.Array:
        """The ids of each of the units, which follow a blank."""
        text, odd = "".join([" " + u for u in units]), None
        if not _PLAIN_TEXT.fullmatch(text):
            odd = np.array([not _PLAIN_TEXT.fullmatch(u) for u in units])
            text = "".join([" " + u for u, o in zip(units, odd) if not o])
        found = _WORD_PIECES.findall(text.lower()) if self.words else _BYTE_PIECES.findall(text)
        values = list(map(self.pieces.get, found))
        if None in values:
            self._learn_pieces({x for x, ids in zip(found, values) if ids is None})
            held = self.pieces
            values = [held[x] if ids is None else ids for x, ids in zip(found, values)]
        ids = np.frombuffer(b"".join(values), "<u4")
        marks = np.flatnonzero(ids == 0xFFFFFFFF)
        if len(marks) != len(units) - (0 if odd is None else odd.sum()):
            raise RuntimeError("units and pieces differ")
        offsets = 4 * np.append(marks - np.arange(len(marks)), len(ids) - len(marks))
        plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(offsets), pa.py_buffer(ids[ids != 0xFFFFFFFF])])
        if odd is None:
            return plain
        others = [u for u, o in zip(units, odd) if o]
        self._learn(self.rest, self.former_rest, set(others), self.lead)
        both = pa.concat_arrays([plain, pa.array([self.rest[u] for u in others], pa.large_binary())])
        return both.take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Put pieces into the cache, each with a mark before its ids if it begins a unit."""
        new = [*pieces]
        if known := {x: ids for x in new if (ids := self.former_pieces.get(x)) is not None}:
            self.pieces.update(known)
            new = [x for x in new if x not in known]
        self.held_pieces += len(pieces) + (sum(map(len, pieces)) >> 6)
        tokenize, id_bytes, held, mark = self.model.tokenize, self.id_bytes, self.pieces, _MARK
        for x, bytewise in zip(new, shown("\0".join(new)).split(shown("\0"))):
            if x == " " and self.words:
                held[x] = mark
            else:
                ids = b"".join([id_bytes[t.id] for t in tokenize(bytewise)])
                held[x] = mark + ids if x[0] == " " else ids

    def _units(self, texts: list[str]) -> list[bytes]:
        split = [self.units(x) for x in texts]
        self._learn(self.first, self.former_first, {x[0] for x in split}, "")
        self._learn(self.rest, self.former_rest, {u for x in split for u in x[1:]}, self.lead)
        first, rest = self.first, self.rest
        return [first[x[0]] + b"".join([rest[u] for u in x[1:]]) for x in split]

    def _learn(self, cache: dict[str, bytes], former: dict[str, bytes], units: set[str], lead: str) -> None:
        odd, piece = [], self._piece
        for u in units:
            if u not in cache:
                self.held_units += 1 + (len(u) >> 6)
                if (ids := former.get(u)) is not None:
                    cache[u] = ids
                elif m := _PLAIN.fullmatch(u):
                    a, b, c, d = m.groups()
                    ids = piece(lead + a).removeprefix(_MARK)
                    if b:
                        ids += piece(b)
                    if c:
                        ids += (self.line_end + piece(c) + piece(d)) if d else self.line_end + piece(c)
                    cache[u] = ids
                else:
                    odd.append(u)
        for at in range(0, len(odd), 5_000):
            part = odd[at : at + 5_000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast([lead + u for u in part], add_special_tokens=False)):
                cache[u] = np.array(e.ids, "<u4").tobytes()

    def _piece(self, x: str) -> bytes:
        """The ids of one pre-token of Latin-1 letters or ASCII signs."""
        if not self.lead:
            x = x.lower()
        if x not in self.pieces:
            self._learn_pieces({x})
        return self.pieces[x]


def shown(x: str) -> str:
    """A text's bytes in the byte-level alphabet."""
    return x.encode().decode("latin-1").translate(_ALPHABET)


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def text_slices(batch: pa.RecordBatch, column: int, share: float = 1.0):
    """Rows of a batch, as many at a time as hold `share` of SLICE_CHARS bytes of text, one at least."""
    most = int(share * SLICE_CHARS)
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64) + 64), 0  # an empty text is a row, too
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right"))
        yield batch.slice(at, max(1, upto - at))
        at = max(upto, at + 1)


def encoded(path: str, texts: list[str | None], share: float = 1.0) -> "list[bytes]":
    """encode() over bounded slices, so that the split units of few texts are in memory at once."""
    out, part, size, enc = [], [], 0, encoder(path)
    enc.share, most = share, int(share * SLICE_CHARS)
    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size > most:
            out += _with_special(enc, part)
            part, size = [], 0
    return out + _with_special(enc, part) if part else out


def _slices(text: str, most: int):
    """Parts of a long text, cut before a blank that a visible character follows."""
    at = 0
    while len(text) - at > most and (border := _BORDER.search(text, at + most)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def _with_special(enc: UnitEncoder, texts: list[str]) -> list[bytes]:
    cut = [enc.cut.split(x) for x in texts]  # text, special token, text, ...
    plain, most = [x for parts in cut for x in parts[::2]], int(enc.share * SLICE_CHARS)
    if len(texts[-1]) > most:
        ids = iter([b"".join([enc.encode([x])[0] for x in _slices(text, most)]) for text in plain])
    else:
        ids = iter(enc.encode(plain))
    return [next(ids) + b"".join([enc.special[x] + next(ids) for x in parts[1::2]]) for parts in cut]
