"""Token-ID output: Parquet list columns with delta encoding, small row groups and page indexes.

`write_tokens` writes one file per range of doc_id, in ascending order, with the columns doc_id, n_tokens,
local_start, part and ids. The ids are delta-packed 32-bit integers; the other columns can be read without
them, and the sorted doc_id lets a reader skip row groups and pages. `read_index` gives each document's place
from the metadata columns alone, `read_tokens` the ids of whole files or of chosen documents.

Null texts count as empty; every document ends with END_ID. Rows with equal doc_id stay separate rows, in the
order of their texts' hashes; null doc_ids come last. An empty table gives an empty index. Further columns of
the input are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.encoding import END_ID, encoded, text_slices
from larkspur.llm.shared import giving_back, partitions, plain, worker_for

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",  # ids then get DELTA_BINARY_PACKED
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, n_tokens long, local_start long, part int, ids array<int>"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, files: int | None = None) -> None:
    """Write the ids of all documents to `path` in ascending doc_id order."""
    end = END_ID.to_bytes(4, "little")

    def encode(batches):
        worker_for("tokens")
        start, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in text_slices(batch, 1):
                ids = [x + end for x in encoded(tokenizer, rows.column(1).to_pylist())]
                sizes = [len(x) // 4 for x in ids]
                starts = [start]
                for n in sizes:
                    starts.append(starts[-1] + n)
                offsets = pa.array([s - start for s in starts], pa.int32())
                values = pa.Array.from_buffers(pa.int32(), starts[-1] - start, [None, pa.py_buffer(b"".join(ids))])
                columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(starts[:-1], pa.int64())]
                columns += [pa.array([part] * len(ids), pa.int32()), pa.ListArray.from_arrays(offsets, values)]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)
                start = starts[-1]

    n = files or partitions(docs.sparkSession)
    keyed = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(giving_back(encode), SCHEMA).write.options(**FORMAT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, part, local_start: each document's place in the whole sequence; reads no ids."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens", "local_start", "part")
    return _placed(rows, rows)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files with each document's start; filters on doc_id reach the files' indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _placed(rows, rows)


def _placed(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    # one row per file, which is what is broadcast: a file's first id comes after all ids of the files before it
    sums = metadata.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def digest(batches):
        for b in batches:
            ids, offsets = b.column(3), b.column(3).offsets.to_pylist()
            data = memoryview(ids.values.buffers()[1])[4 * ids.values.offset :]
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(offsets, offsets[1:])]
            columns = [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
