import json
import random

import pyarrow as pa
import pytest

from larkspur.sources import formats


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def events(df):
    return sorted((r["event"] for r in df.collect()), key=str)


def written(spark, folder, texts):
    """The files as splits, and as whole texts."""
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"f{i}").write_text(t)
    lines = formats.split_lines(spark, str(folder))
    assert lines.select("file", "block").distinct().count() > len(texts)
    return lines, spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, value string")


def test_records_over_splits(small_splits, tmp_path):
    random.seed(1)

    def text(n, share, end="\n"):
        return end.join(random.choice(["2024 at", " more", "  ", "x" * 60]) if random.random() < share else "y" * random.randrange(90) for _ in range(n)) + end

    texts = [text(200, 0.5), text(100, 0.05), text(150, 0, "\r\n"), "head\n" * 300 + "2024 a\n" + "tail\n" * 900, text(300, 1), "2024 only", ""]
    lines, whole = written(small_splits, tmp_path / "in", texts)
    for most in (500, 7, 1):
        assert events(formats.multiline_of_splits(lines, r"^\d{4}", most)) == events(formats.multiline(whole, r"^\d{4}", most))


def test_headers_over_splits(small_splits, tmp_path):
    random.seed(2)
    texts = []
    for i in range(4):
        out = ["#Version: 1.0"]
        for k in range(400):
            if random.random() < (0.02 if i else 0.003):
                names = random.sample(["date", "time", "a", "b", "c"], random.randrange(1, 6))
                out.append("#Fields: " + " ".join(names))
            out.append(" ".join(random.choice(["1", "-", "xy"]) for _ in range(random.randrange(1, 6))))
        texts.append("\n".join(out))
    lines, whole = written(small_splits, tmp_path / "in", texts)
    assert events(formats.w3c_of_splits(lines)) == events(formats.w3c(whole))


def test_cells_over_splits(small_splits, tmp_path):
    texts = ["\n\n" * (i % 2) + f"a,b{i},c\n" + "".join(f'{k},"x, ""{k}""",{"" if k % 3 else k}\n' for k in range(200)) for i in range(3)] + ["only\n"]
    lines, whole = written(small_splits, tmp_path / "in", texts)
    got = events(formats.cells_of_splits(lines, ","))
    assert got == events(formats.cells(whole, ",")) and len(got) == 600 and json.loads(got[0])


def test_lines_of_splits_stay_where_they_are_read(small_splits, tmp_path):
    """F8: no lines are sorted or meet but the runs at the ends of splits, so memory doesn't grow with a split or a file."""
    lines, whole = written(small_splits, tmp_path / "in", ["2024 a\n  b\n" * 500])
    found = formats.multiline_of_splits(lines, r"^\d{4}")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "collect_list(struct(line" not in plan
    assert events(found) == events(formats.multiline(whole, r"^\d{4}"))
    batch = pa.RecordBatch.from_pylist([{"file": "f", "block": 0, "id": i, "value": "x", "opens": True, "first": 0, "opened": None} for i in (2, 1)])
    with pytest.raises(ValueError, match="order they were read in"):
        list(formats._runs(5)(iter([batch])))
