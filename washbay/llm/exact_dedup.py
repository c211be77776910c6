"""Exact deduplication by distributed MSD radix partitioning (operator 13).

Texts are compared as UTF-8 bytes after lower-casing A-Z only. A level takes the next run
of bytes of every text still open (its digit) and splits each group by it: the groups are
counted with a partial aggregate on (group, digit, ended), so a group that holds a third of
all rows is one row per task, and only groups of two rows or more get a number. Rows then
meet their group in a sort-merge join of two staged tables, whose large partitions Spark
splits (skew join), whatever share of the rows one group has. A row leaves

* as a singleton, when nobody shares its bytes up to here;
* as a member of its group, when the text ends within the digit: equal bytes and equal
  length, so no digest takes part in the comparison.

All others carry the rest of their text to the next level. Digits grow sixteenfold (64
bytes, 1 KB, 16 KB, 256 KB) up to ``MAX_DIGIT``, so a level handles a bounded run of bytes
and the number of levels is small; texts that part early never move again.

NULL texts count as empty (all empty texts are equal); a NULL id is smaller than every
other and comes back as NULL; repeated rows count as rows of the group, and all rows with
the id that stays are marked kept (they are the same document); an empty table gives an
empty result; columns not named here are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import _LOWER, doc_rows, given_id, passes, staged

FIRST_DIGIT = 64
GROWTH = 16
MAX_DIGIT = 4 << 20


def _keys(part: pa.RecordBatch, t) -> tuple[pa.Array, np.ndarray]:
    """The normalised texts of a pass as a binary column, and their lengths."""
    low = _LOWER[t.buf[:t.size]]
    offsets = t.off.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), t.n, [None, pa.py_buffer(offsets), pa.py_buffer(low)]), np.diff(t.off)


def _first_digits(rows: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in passes(batches):
            key, size = _keys(part, t)
            yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_slice(key, 0, width), pa.array(size <= width)],
                                             names=["doc_id", "digit", "ended"])

    return rows.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, digit binary, ended boolean") \
               .withColumn("part", F.lit(0).cast("bigint"))


def _normalised(rows: DataFrame) -> DataFrame:
    """doc_id, rest (the whole normalised text), text_sha256 and what else the rows carry."""
    given = [f for f in rows.schema.fields if f.name == "given"]
    schema = ", ".join(["doc_id bigint", "rest binary", "text_sha256 string"] + [f"given {f.dataType.simpleString()}" for f in given])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in passes(batches):
            key, _ = _keys(part, t)
            low = memoryview(key.buffers()[2]) if t.size else memoryview(b"")
            sha = [hashlib.sha256(low[a:b]).hexdigest() for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), key, pa.array(sha, pa.string())]
                                             + [part.column(part.schema.get_field_index(f.name)) for f in given],
                                             names=["doc_id", "rest", "text_sha256"] + [f.name for f in given])

    return rows.mapInArrow(run, schema).withColumn("part", F.lit(0).cast("bigint"))


def _digits(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("*", F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended"))


def exact_groups(docs: DataFrame, carry: tuple[str, ...] = (), first_digit: int = FIRST_DIGIT,
                 growth: int = GROWTH, max_digit: int = MAX_DIGIT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, and ``given`` (the
    columns of ``carry``)."""
    extra = [F.struct(*carry).alias("given")] if carry else []
    rows = doc_rows(docs, *extra)
    keep = ["doc_id", "text_sha256"] + (["given"] if carry else [])
    by = ["part", "digit", "ended"]
    open_rows, width, done = _normalised(rows), first_digit, []
    digits = _first_digits(rows, width)
    while True:
        groups = staged(digits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
                        .where("n > 1").withColumn("child", F.monotonically_increasing_id()), "radix-groups")
        found = _digits(open_rows, width).join(groups.hint("merge"), by, "left")
        still = F.col("n").isNotNull() & ~F.col("ended")
        level = staged(found.select(
            *keep, F.when(still, F.col("child")).alias("part"), F.when(still, F.substring("rest", width + 1, 1 << 30)).alias("rest"),
            F.when(F.col("ended"), F.col("last")).alias("last"), F.when(F.col("ended"), F.col("n")).alias("n")), "radix-rows")
        done.append(level.where("part IS NULL").select(
            *keep, F.coalesce("last", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size")))
        open_rows = level.where("part IS NOT NULL").select(*keep, "part", "rest")
        if open_rows.isEmpty():
            break
        width = min(width * growth, max_digit)
        digits = _digits(open_rows, width).select("part", "digit", "ended", "doc_id")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(given_id(), given_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
                      *keep[1:])


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_groups(docs, carry=tuple(f"`{c}`" for c in docs.columns)).where("kept").select("given.*")
