import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import queries, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "It's  3rd́ <|endoftext|>'ll go", "<|startoftext|><|endoftext|>", "a  b   c ", " lead", "tail ",
    "=" * 5000 + " " + "=" * 5000, "x" * 60 + " " + "x" * 60, "ÅNGSTRÖM ǅ İ ß ﬁ", "日本語 テキスト", "é é ́  x y", "1234 a1b2",
    "the cat\tsat\r\non the mat", "ab " * 400_000, "don't can't we'll I'm", "😀😀 👩‍👩‍👧", "<|endoftext", "x\x1cy \x85z", "​ ﻿",
]


def plain(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("head", [3, 200_000])
def test_counts_are_the_library_s(spark, path, head):
    ids = [None, None, 1, 1, *range(2, len(TEXTS) - 2)]
    rows = [(i, t, 7, "x", 0, "k") for i, t in zip(ids, TEXTS)] + [(1, "\n", 7, "x", 0, "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int, token string, row int, key string")
    found = [tuple(r) for r in token_counts.count_tokens(df, path, 100, head).collect()]
    texts = TEXTS + ["\n"]
    want = [(i, len((t or "").encode()), n, n > 100) for i, t, n in zip(ids + [1], texts, plain(path, texts))]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_no_documents(spark):
    out = token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), WORD)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_long_texts_are_cut_where_the_model_does_not_look(monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 7)
    for path in (WORD, BYTE):
        encoder = token_counts.encoder(path)
        for text, n in zip(TEXTS[:16], plain(path, TEXTS[:16])):
            found, special = token_counts.pre_tokens(path, text or "")
            assert special + sum(times * len(encoder.model.tokenize(t)) for t, times in found.items()) == n, repr(text)


def test_the_model_sees_each_pre_token_once(spark):
    df = spark.createDataFrame([(i, "one two one " + "z" * 99) for i in range(50)], "doc_id long, text string")
    tokens = token_counts.frequencies(df, WORD).selectExpr("explode(tokens) as token").groupBy("token").count()
    tokens = tokens.selectExpr("token", "count as rows", "token as key")
    assert sorted(tuple(r)[:2] for r in token_counts.pieces(tokens, WORD).collect()) == [("one", 50), ("two", 50), ("z" * 99, 50)]


def test_the_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (len((t or "").encode()), n, n > 2048) for (d, t), n in zip(docs, plain(WORD, [t for _, t in docs]))}
    found = queries.op12_token_counts(spark, sf).collect()
    assert len(found) == len(docs) and {r[0]: tuple(r)[1:] for r in found} == want
