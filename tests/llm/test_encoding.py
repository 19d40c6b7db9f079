import gc
import random
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import encoding, shared, token_output
from larkspur.llm.encoding import encoded, encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOC = "doc_id long, text string"


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_units_equal_whole_texts(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    random.seed(3)
    odd = ["", " ", "  a \n b\nc ", "it's 's we'll\n't", "a\x1c b", "ΣΑΣ x", "日本 語", "<|endoftext|> x", "a b c　d", "é ́e á"]
    odd += ["".join(random.choice("ab A.'é\n \t,s_1#²İ") for _ in range(random.randint(1, 40))) for _ in range(1500)]
    for text, ids in zip(odd, encoder(path).encode(odd)):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_tokens_as_the_library_reads_them(path):
    t = Tokenizer.from_file(path)
    random.seed(4)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]
    texts = ["one <|endoftext|> two", "one  <|endoftext|>  two ", "<|endoftext|>", "a<|endoftext|>'s<|endoftext|><|endoftext|>\n", "<|<|endoftext|>|>", "É́<|startoftext|>́e", ""]
    texts += ["".join(random.choice([*special, " ", "  ", "\n", "a", "it's", "Éa", "1", "\t"]) for _ in range(random.randint(1, 12))) for _ in range(1500)]
    for text, ids in zip(texts, encoded(path, texts), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_files_round_trip(spark):
    rows = [(3, "b c"), (1, None), (2, ""), (2, "x"), (None, "last"), (7, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], DOC + ", start long")
    path = shared.new_path(spark, "t")
    token_output.write_tokens(df, path, WORD, 3)
    t = Tokenizer.from_file(WORD)
    got = token_output.token_digest(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 2, 3, 7, None]
    start = 0
    for r in got:
        texts = [x or "" for i, x in rows if i == r["doc_id"]]
        ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids]
        start += r["n_tokens"]
    assert token_output.read_index(spark, path).count() == 6
    plan = token_output.read_index(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint,local_start:bigint,part:int>" in plan
    token_output.write_tokens(df.limit(0), path + "e", WORD, 2)
    assert token_output.token_digest(spark, path + "e").count() == 0


def test_files_are_delta_packed_and_indexed(spark):
    df = docs(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    path = shared.new_path(spark, "t")
    token_output.write_tokens(df, path, WORD, 2)
    files = sorted(Path(path.removeprefix("file:")).glob("*.parquet"))
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups >= 1
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["ids"].encodings and columns["ids"].compression == "ZSTD"
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert columns["ids"].total_uncompressed_size <= 17 << 20 and columns["doc_id"].statistics.has_min_max
    some = token_output.read_tokens(spark, path).filter("doc_id in (3, 500, 999)")
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    texts = {r["doc_id"]: r["text"] for r in df.filter("doc_id in (3, 500, 999)").collect()}
    t = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r["ids"] for r in some.collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_caches_are_bounded_and_keep_what_comes_back(path, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_UNITS", 400)
    monkeypatch.setattr(encoding, "CACHE_PIECES", 400)
    enc, t = encoding.UnitEncoder(path), Tokenizer.from_file(path)
    random.seed(5)
    for i in range(60):
        texts = [" ".join(["often", "seen", *("".join(random.choices("abcdefgh", k=8)) for _ in range(20)), f"é{i}日 ", "z" * 900]) for _ in range(4)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(enc.pieces) + len(enc.former_pieces) < 2 * 600 and len(enc.first) + len(enc.rest) + len(enc.former_first) + len(enc.former_rest) < 4 * 600
        assert "seen" in {**enc.rest, **enc.former_rest} or "seen" in {**enc.pieces, **enc.former_pieces}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_long_text_goes_slice_by_slice(path, monkeypatch):
    monkeypatch.setattr(encoding, "SLICE_CHARS", 50)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = False
    random.seed(6)
    texts = ["".join(random.choice(["<|endoftext|>", " ", "  ", "\n", "a", "it's", "Éa ", " 1", "\t", " \n ", " word", "日"]) for _ in range(random.randint(1, 300))) for _ in range(300)]
    texts += ["x" * 400, " " * 400, "", "one " * 100]
    sizes, encode = [], encoding.UnitEncoder.encode
    monkeypatch.setattr(encoding.UnitEncoder, "encode", lambda self, x: sizes.append(sum(map(len, x))) or encode(self, x))
    for text, ids in zip(texts, encoded(path, texts), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    sizes.clear()
    encoded(path, ["one two " * 1000])
    assert max(sizes) < 120


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_plain_texts_equal_the_library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    random.seed(7)
    parts = ["a", "Éß", "'s", "'S", "'", "'ll", "n't", "12", "3.5", "(", ").", "_", "-", "x×", "\n", "\r\n", "\n\n", "\t", "\x0b", "THE", "<|endoftext|>", "日", "\u212a", "«"]
    for kinds in (20, len(parts)):  # without others and with them
        texts = [" ".join("".join(random.choices(parts[:kinds], k=random.randint(1, 5))) for _ in range(random.randint(1, 12))) for _ in range(1500)]
        texts += ["".join(random.choices([*parts[:kinds], " "], k=9)) for _ in range(300)]
        for some in (texts[:1500], texts):  # units that begin with blanks go another way
            for text, ids in zip(some, encoder(path).encode(some), strict=True):
                assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        solid = [x for x in texts if not encoding._ODD.search(x)]
        for text, ids in zip(solid, encoder(path).encode(solid), strict=True):
            assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_distinct_units_of_known_pieces_cost_no_calls(path):
    enc, t, calls = encoding.UnitEncoder(path), Tokenizer.from_file(path), []
    words = ["one", "Two", "thrée", "four", "five", "six", "seven", "eight", "nine", "ten"]
    texts = [" ".join(["it", *(f"{a}{s}\n{b}{e}" for a in words for b in words for s in ".,;:!?" for e in ".,;:!?")])]
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        ids = enc.encode(texts)
    finally:
        sys.setprofile(None)
    assert ids == [np.array(t.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(set(texts[0].split(" "))) == 3601 and calls.count("call") < 400  # one a unit at least before


def test_rows_are_taken_by_their_texts_sizes(monkeypatch):
    monkeypatch.setattr(encoding, "SLICE_CHARS", 1000)
    texts = ["x" * 300, None, "y" * 5000, "", *["z" * 100] * 20, "é" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]).slice(1)
    got = list(encoding.text_slices(batch, 1))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1, len(texts)))
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b.column(1).to_pylist()) <= 1000 for b in got) and len(got) < 8


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_running_words_are_no_python_objects(path):
    enc, t, text = encoding.UnitEncoder(path), Tokenizer.from_file(path), " ".join(f"{a}{b}," for a in "stone wood water fire".split() for b in "abcdefgh")
    once = enc.encode([text])[0]
    assert once == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    gc.collect()
    tracemalloc.start()
    ids = enc.encode([" ".join([text] * 5000)])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) >= 5000 * len(once) - 40_000 and most < 5000 * 32 * 40 + 2 * len(ids)  # a string a word took more


def test_the_pipelines_share_takes_less_memory_and_gives_the_same_ids():
    random.seed(6)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)] + ["x " * 3_000_000]

    def run(share):
        enc = encoding._encoders[BYTE] = encoding.UnitEncoder(BYTE)
        tracemalloc.start()
        crc = [zlib.crc32(x) for t in range(0, len(texts), 40) for x in encoded(BYTE, texts[t : t + 40], share)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return crc, peak, len(enc.pieces) + len(enc.former_pieces)

    whole, less = run(1.0), run(corpus_pipeline.SHARE)
    del encoding._encoders[BYTE]
    assert less[0] == whole[0] and less[1] < 0.7 * whole[1] and less[2] < 0.6 * whole[2], (whole[1:], less[1:])
