"""Token-ID files (operator 7): Parquet with one row per document in ascending doc_id order.

Columns: ``doc_id``, ``n_tokens`` (with the end id), ``n_chars``, ``ids`` (list<int>).
Texts are range-partitioned by doc_id before they are encoded, so ids themselves are never
shuffled. Ids are dictionary-encoded (a vocabulary fits one dictionary page) and
zstd-compressed; row groups and pages are kept small and the writer adds column and offset
indexes, so a reader that filters on doc_id or asks for metadata columns touches only their
pages. Reading back needs no order between tasks: a file holds a range of doc_ids, per-file
sums give each file's first position, and a window over the row numbers inside the file
gives each row's.

NULL or empty texts hold the end id only; rows with the same id stand next to each other;
a NULL id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from washbay.llm.common import NULL_ID, doc_rows, given_id
from washbay.llm.token_ids import token_ids

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(2 << 20),
}


def encode_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, n_chars, ids (with the end id) per document, in no order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_ids(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                packed = [t.packed(x) + end for x in texts]
                n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                off = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(n, out=off[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array([len(x) for x in texts], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(ids))],
                    names=["doc_id", "n_tokens", "n_chars", "ids"])

    return doc_rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_chars bigint, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1,
                      options: dict[str, str] | None = None) -> None:
    """Write the table's ids below ``path`` (a new folder) in ascending doc_id order."""
    ordered = doc_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encode_rows(ordered, tokenizer_path, end_id).write.options(**(WRITE_OPTIONS | (options or {}))).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None,
                     first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Selected columns of the documents with ids in first_id..last_id; column and page
    indexes keep other columns, row groups and pages from being read."""
    df = spark.read.parquet(path)
    if first_id is not None:
        df = df.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.where(F.col("doc_id") <= last_id)
    return df.select(*(columns or df.columns))


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            off = np.zeros(len(lists) + 1, dtype=np.int64)
            np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=off[1:])
            body = memoryview(values.tobytes())
            crc = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(crc, pa.int64()),
                                              batch.column(2), batch.column(3)],
                                             names=["doc_id", "n_tokens", "ids_crc32", "file", "seat"])

    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("seat")]
    rows = (spark.read.parquet(path).select("doc_id", "ids", *place)
            .mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, seat bigint"))
    meta = spark.read.parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files = meta.groupBy("file").agg(F.min("doc_id").alias("lo"), F.sum("n_tokens").alias("n"))      # a row per file
    files = files.select("file", (F.sum("n").over(Window.orderBy("lo")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("file").orderBy("seat").rowsBetween(Window.unboundedPreceding, 0)   # one file's rows, as they stand
    return (rows.join(files, "file")
            .select(given_id(), (F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"),
                    "n_tokens", "ids_crc32"))
