import threading

import pytest

from larkspur.llm import sharding, shared

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_sharding(spark):
    table = sharding.ShardedTable(spark, shared.new_path(spark, "s"), target_bytes=400_000, small_bytes=20_000)
    df = docs(spark).selectExpr("*", "cast(null as string) as path")
    for i in range(5):
        table.append(df.filter(f"doc_id % 5 = {i}"))
    table.append(df.limit(0))
    before = table.manifest()
    after = table.compact()
    assert after["version"] > before["version"] and len(after["shards"]) < len(before["shards"])
    assert table.read(before["version"]).exceptAll(df).count() == 0 and table.read().exceptAll(df).count() == 0 and table.read().count() == 200
    assert table.vacuum() > 0 and table.versions() == [after["version"]] and table.read().count() == 200
    with pytest.raises(Exception, match="(?i)exist"):  # a second writer from the same version has to try again
        table._commit({"version": after["version"] - 1}, after["schema"], [])
    empty = sharding.ShardedTable(spark, shared.new_path(spark, "s"))
    empty.append(df.limit(0))
    assert empty.compact()["shards"] == [] or empty.read().count() == 0


def test_arrivals_with_other_columns(spark):
    table = sharding.ShardedTable(spark, shared.new_path(spark, "s"), fanout=2)
    table.append(spark.createDataFrame([(1, "a")], DOC))
    table.append(spark.createDataFrame([("x", 2)], "more string, doc_id long"))
    table.append(spark.createDataFrame([(3, "c", None)], DOC + ", more string"))
    want = [(1, "a", None), (2, None, "x"), (3, "c", None)]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    before = table.versions()
    for other in ("doc_id string", "doc_id long, TEXT string"):
        with pytest.raises(ValueError):
            table.append(spark.createDataFrame([], other))
    assert table.versions() == before
    table.compact()
    table.vacuum()
    assert sorted(tuple(r) for r in table.read().collect()) == want


def test_what_beaten_writers_left(spark):
    path = shared.new_path(spark, "s")
    table, other = sharding.ShardedTable(spark, path), sharding.ShardedTable(spark, path)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], DOC)
    table.append(df)
    base = other.manifest()
    table.append(df)
    lost = other._write(df)
    with pytest.raises(Exception, match="(?i)exist"):
        other._commit(base, base["schema"], base["shards"] + lost)
    assert table.vacuum() == 0 and table.read().count() == 6  # the writer might still be at work
    assert table.vacuum(abandoned_s=-60) == len(lost) and table.read().count() == 6


def test_writers_at_once(spark, tmp_path):
    """Two writers of one version, a hundred times: one winner, and a manifest that can be read."""
    path = str(tmp_path / "s")
    tables = [sharding.ShardedTable(spark, path) for _ in range(2)]
    for i in range(100):
        base, won, ready = {"version": i}, [], threading.Barrier(2)

        def go(k):
            ready.wait()
            try:
                won.append((k, tables[k]._commit(base, "{}", [{"file": f"{k}-{i}", "bytes": 1}])["version"]))
            except FileExistsError:
                pass

        threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        ((k, version),) = won
        assert version == i + 1 and tables[0].manifest()["shards"] == [{"file": f"{k}-{i}", "bytes": 1}]


def test_arrivals_and_compactions_at_once(spark, tmp_path):
    path, errors = str(tmp_path / "s"), []
    text = "x" * 3000

    def write(k):
        try:
            table = sharding.ShardedTable(spark, path, fanout=2)
            for i in range(4):
                table.append(spark.createDataFrame([(10 * k + i, text)], f"doc_id long, text{k} string"), 1)
                if k:
                    table.compact()
        except Exception as e:  # the threads' errors are the test's
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = sharding.ShardedTable(spark, path, fanout=2)
    assert not errors and table.compact()["version"] >= 12
    rows = table.read().select("doc_id", "text0", "text1", "text2").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(10 * k + i for k in range(3) for i in range(4))
    assert all(r[f"text{r['doc_id'] // 10}"] == text for r in rows) and table.vacuum() >= 0 and table.read().count() == 12


def test_very_long_texts(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=2)
    long = "é" * 3_000_000
    for i in range(4):
        table.append(spark.createDataFrame([(i, long + str(i)), (i, "")], DOC))
    table.compact()
    assert {r[0]: r[1] for r in table.read().filter("text <> ''").collect()} == {i: long + str(i) for i in range(4)} and table.read().count() == 8
