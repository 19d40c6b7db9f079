import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
import plain_versions
from larkspur.llm import shared

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, rows):
    """A folder with these documents and the benchmark of SF."""
    at = shared.new_path(spark, "sf")
    df = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], COLUMNS)
    df.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def by_hand(rows, items):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = {i for i, _, _, k in plain_versions.near_groups(rows) if k}
    left = [(r[0], r[5]) for r in plain_versions.without_repeats([(i, t) for i, t in rows if i in kept], 50)]
    gone = {i for i, _ in plain_versions.leaks(left, items)}
    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in left:
        if i in gone:
            continue
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "12 !?"), (5003, f"{items[0][1]} and more " + "x " * 9), (5004, rows[3][1])]
    rows += [(5005, rows[5][1][:300] + " something else"), (5006, "long words " * 30_000), (5007, "é" * 3000)]
    at = folder(spark, rows)
    got = corpus_pipeline.run(spark, at)
    assert sorted(tuple(r)[:5] for r in got.collect()) == by_hand(rows, items)
    table, docs = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, at), name)
        assert docs.schema.simpleString() == table.schema.simpleString(), name


def test_rows_without_or_with_equal_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (None, a), (None, item), (8, item), (8, "clean words of document eight"), (9, b + " b")]
    at = folder(spark, rows)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.one_of_each_group(spark, docs, at).collect()
    texts = sorted((str(r["doc_id"]), r["text"]) for r in kept)
    assert texts == sorted((str(i), t) for i, t in rows if i not in (7, 9)), texts  # 7 has a copy of 1, 9 one of 7
    clean = corpus_pipeline.without_benchmark(spark, docs, at).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean) == sorted((str(i), t) for i, t in rows if t != item)


def test_empty_documents(spark):
    assert corpus_pipeline.run(spark, folder(spark, [])).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, [(1, None), (None, "..")])).count() == 0


def test_tables_inside_stages_are_deleted(spark):
    with shared.Temporary() as tables:
        a = shared.materialize(spark.range(3), "a")
        kept = tables.keep(shared.materialize(a, "b"))
        with shared.Temporary():
            shared.materialize(a, "c")
    assert kept.count() == 3 and not list(spark.sparkContext._jvm.java.io.File(a._larkspur_path).list() or [])
    shared.release(kept)


def test_registered(spark):
    from larkspur.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
