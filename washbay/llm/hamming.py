"""Exact top-k search over binary codes by multi-index hashing (operator 1).

A vector's code is the signs of its components (bit set: > 0). Codes are cut into m
segments of about log2(number of codes) bits, and an index row (segment, value, code) is
made for each. Queries look up segment values at Hamming radius 0, then 1, 2, ... When all
segment values within radius r have been looked up, every code at distance
<= m * (r + 1) - 1 has been met (pigeonhole), so a query stops once its k-th verified
distance is within that bound; the others go on. The result is exact.

Index and query codes are numbered, so postings, probes and pairs move numbers; codes are
fetched once for every distinct pair, to verify it. No table of codes is broadcast: all of
them grow with the data, so every join is a sort-merge join of staged tables, whose
large partitions (a segment value that many codes share) Spark splits. A segment has about
log2(number of codes) bits, so all of its radii together look up about as many values
as there are codes, never more than a scan would compare.

Equal codes are one index entry that holds the k + 1 smallest ids (all that can matter),
and equal query codes are searched once, so a very common vector costs one entry.
Neighbours are ordered by distance, then id; a row is never its own neighbour.

NULL ids, NULL or empty vectors are not indexed and find nothing; NULL and NaN components
count as not positive; shorter vectors are filled up with unset bits. Rows that repeat an id and
its code are one neighbour; an id with several codes is a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washbay.llm.common import staged


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, code: the signs as 64-bit words, equally many in every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND size(v) > 0")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    words = -(-dims // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n, size = len(lists), lists.value_lengths().to_numpy(zero_copy_only=False)
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            row = np.repeat(np.arange(n), size)
            seat = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            bits = np.zeros((n, words * 64), dtype=np.uint8)
            bits[row, seat] = values > 0
            code = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)
            off = pa.array(np.arange(0, (n + 1) * words, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(code))], names=["id", "code"])

    return rows.mapInArrow(run, "id bigint, code array<bigint>")


def _segments(n_codes: int, words: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    bits = words * 64
    want = min(24, max(8, round(math.log2(max(2, n_codes)))))
    m = -(-bits // want)
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment_rows(codes: DataFrame, number: str, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """seg, value, ``number``: the segment values of numbered codes with exactly ``radius``
    bits flipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for _, width in segments:
            if width not in masks:
                masks[width] = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            n = len(lists)
            if not n:
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bits = np.unpackbits(flat.astype("<i8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
            for s, (first, width) in enumerate(segments):
                flips = masks[width]
                if not len(flips):
                    continue
                value = bits[:, first:first + width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                per = max(1, 200_000 // len(flips))
                for a in range(0, n, per):
                    v = (value[a:a + per, None] ^ flips[None, :]).reshape(-1)
                    take = pa.array(np.repeat(np.arange(a, min(n, a + per)), len(flips)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s, dtype=np.int32)), pa.array(v), batch.column(1).take(take)],
                                                     names=["seg", "value", number])

    return codes.select("code", number).mapInArrow(run, f"seg int, value bigint, {number} bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest other rows of every query id."""
    codes = staged(sign_codes(vectors, id_col, vector_col).distinct(), "codes")
    wanted = queries.select(F.col(id_col).cast("long").alias("id")).distinct().join(codes.hint("merge"), "id")
    wanted = staged(wanted, "query-codes")
    by_code = Window.partitionBy("code").orderBy("id")
    first_ids = codes.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1)      # limited before the shuffle
    index = staged(first_ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                   .withColumn("c", F.monotonically_increasing_id()), "code-index")
    shape = index.agg(F.count(F.lit(1)), F.max(F.size("code")), F.sum(F.size("ids"))).first()
    if not shape[0]:
        return wanted.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbor_id"),
                             F.lit(0).alias("distance")).where("false")
    segments = _segments(shape[0], shape[1])
    need, m = min(k + 1, int(shape[2])), len(segments)
    postings = staged(_segment_rows(index, "c", segments, 0), "postings")
    asked = staged(wanted.select("code").distinct().withColumn("q", F.monotonically_increasing_id()), "query-numbers")
    query_codes = asked.select("q", F.col("code").alias("asked")).hint("merge")
    active, found, done = asked, None, []
    best = Window.partitionBy("q").orderBy("distance", "id")
    last = max(w for _, w in segments)
    for radius in range(last + 1):
        probes = _segment_rows(active, "q", segments, radius)
        pairs = probes.join(postings.hint("merge"), ["seg", "value"]).select("q", "c").distinct()
        met = (pairs.join(index.hint("merge"), "c").join(query_codes, "q")
               .withColumn("distance", F.expr("aggregate(zip_with(asked, code, (a, b) -> bit_count(a ^ b)), 0, (s, x) -> s + x)"))
               .select("q", "distance", F.explode("ids").alias("id")))
        pool = met if found is None else met.union(found)
        nearest = (pool.distinct().withColumn("seat", F.row_number().over(best)).where(F.col("seat") <= need).drop("seat"))
        nearest = staged(nearest, f"nearest-{radius}")
        state = nearest.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        enough = (F.col("n") >= need) & (F.col("far") <= m * (radius + 1) - 1)
        covered = staged((state.where(enough) if radius < last else active).select("q"), "covered")
        done.append(nearest.join(covered.hint("merge"), "q", "left_semi"))
        active = staged(active.join(covered.hint("merge"), "q", "left_anti"), "active")
        if active.isEmpty():
            break
        found = nearest.join(active.select("q").hint("merge"), "q", "left_semi")
    hits = done[0]
    for d in done[1:]:
        hits = hits.union(d)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    numbered = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).join(query_codes, "asked")
    return (numbered.select("query_id", "q").join(hits.hint("merge"), "q")
            .where("id <> query_id").select("query_id", F.col("id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", "distance"))
