"""Line deduplication with two Bloom filters (operator 10).

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents keep
their lines only in the largest doc_id that holds them.

Pass 1 fills, per task, two Bloom filters of ``filter_bits`` bits over key hashes: seen in
one document, seen in two. Merging ORs them and adds (once & once) to "twice", so "twice"
holds every repeated key. Filters have a fixed size, so merging and broadcasting them is
bounded whatever the input; a fuller filter only lets more lines through. Pass 2 shuffles
the 128-bit hashes of suspected repeats only, counts their documents exactly (partial sums
per task, so a line of a third of all documents is one row per task) and picks the holder.
The rows (document, dropped key) are then joined to the documents by id.

NULL or empty texts are one empty line; rows that repeat an id are one document when
documents are counted, and the rows of the largest id all keep the line; a NULL id is
smaller than every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import (_BYTE_CODE, _LOWER, _WHITE, Texts, as_signed, doc_rows, given_id, mix, passes,
                                span_hash, staged)

FILTER_BITS = 1 << 26
CHUNK_BYTES = 1 << 18


class Lines:
    """All lines of Texts in order: row, byte span, and key span / hashes / length."""

    def __init__(self, t: Texts):
        n, raw = t.size, t.buf[:t.size]
        nl = np.flatnonzero(raw == 10)
        row = np.concatenate([np.arange(t.n), np.searchsorted(t.off, nl, side="right") - 1])
        start = np.concatenate([t.off[:-1], nl + 1])
        order = np.lexsort((start, row))
        self.row, self.start = row[order], start[order]
        end = np.append(self.start[1:] - 1, n)[:len(self.start)]
        last = np.append(self.row[1:] != self.row[:-1], True)[:len(self.row)]
        end[last] = t.off[self.row[last] + 1]
        self.end = end
        solid = np.flatnonzero(~_WHITE[raw])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        self.has = b > a
        solid = np.append(solid, 0)
        key_start = np.where(self.has, solid[np.minimum(a, len(solid) - 1)], self.start)
        key_end = np.where(self.has, solid[np.maximum(b - 1, 0)] + 1, self.start)
        points = np.zeros(n + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        self.chars = points[key_end] - points[key_start]
        code = _BYTE_CODE[_LOWER[raw]]
        self.h1 = span_hash(code, key_start, key_end)
        self.h2 = span_hash(mix(code), key_start, key_end)
        self.count = np.bincount(self.row, minlength=t.n)


def _document_keys(lines: Lines, min_chars: int) -> np.ndarray:
    """Indices of the first line of every distinct long key of every row."""
    at = np.flatnonzero(lines.chars >= min_chars)
    order = np.lexsort((at, lines.h2[at], lines.h1[at], lines.row[at]))
    at = at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = ((lines.row[at][1:] != lines.row[at][:-1]) | (lines.h1[at][1:] != lines.h1[at][:-1])
               | (lines.h2[at][1:] != lines.h2[at][:-1]))
    return at[new]


class Bloom:
    """``bits`` (a power of two) bits, two probes per 64-bit hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, dtype=np.uint8) if data is None else data

    def _probes(self, h: np.ndarray):
        for p in (h & self.mask, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & self.mask):
            yield (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._probes(h):
            np.bitwise_or.at(self.data, at, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at, bit in self._probes(h):
            out &= (self.data[at] & bit) != 0
        return out


def repeated_filter(rows: DataFrame, min_chars: int, filter_bits: int) -> np.ndarray:
    """The merged "seen twice" filter as bytes (filter_bits / 8 of them, on the driver)."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(filter_bits), Bloom(filter_bits)
        for _, t in passes(batches):
            lines = Lines(t)
            keys, times = np.unique(lines.h1[_document_keys(lines, min_chars)], return_counts=True)
            twice.add(keys[(times > 1) | once.has(keys)])
            once.add(keys)
        yield from _chunks({i: (once.data[a:a + CHUNK_BYTES], twice.data[a:a + CHUNK_BYTES])
                            for i, a in enumerate(range(0, len(once.data), CHUNK_BYTES))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for chunk, one, two in zip(*(b.column(i).to_pylist() for i in range(3))):
                one, two = (np.frombuffer(unpack.decompress(x), dtype=np.uint8) for x in (one, two))
                if chunk in held:
                    o, w = held[chunk]
                    one, two = o | one, w | two | (o & one)
                held[chunk] = (one, two)
        yield from _chunks(held)

    schema = "chunk int, once binary, twice binary"
    part = rows.select("text").mapInArrow(fill, schema)
    # a tree of two levels: a chunk's filters of all tasks never meet in one task unmerged
    part = part.repartition("chunk", F.spark_partition_id() % 16).mapInArrow(merge, schema)
    part = part.repartition("chunk").mapInArrow(merge, schema)
    twice = np.zeros(filter_bits // 8, dtype=np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for r in part.select("chunk", "twice").collect():           # filter_bits / 8 bytes in all
        data = np.frombuffer(unpack.decompress(bytes(r["twice"])), dtype=np.uint8)
        twice[r["chunk"] * CHUNK_BYTES:r["chunk"] * CHUNK_BYTES + len(data)] = data
    return twice


def _chunks(parts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for chunk, (one, two) in parts.items():
        if one.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()),
                                              "once": [pack.compress(one.tobytes())],
                                              "twice": [pack.compress(two.tobytes())]})


def dropped_keys(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, h1, h2: the keys whose lines each document loses."""
    spark = docs.sparkSession
    rows = doc_rows(docs)
    twice = spark.sparkContext.broadcast(repeated_filter(rows, min_chars, filter_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bloom(filter_bits, twice.value)
        for part, t in passes(batches):
            lines = Lines(t)
            at = _document_keys(lines, min_chars)
            at = at[seen.has(lines.h1[at])]
            ids = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[lines.row[at]]), pa.array(as_signed(lines.h1[at])),
                                              pa.array(as_signed(lines.h2[at]))], names=["doc_id", "h1", "h2"])

    found = staged(rows.mapInArrow(suspects, "doc_id bigint, h1 bigint, h2 bigint").distinct(), "line-suspects")
    repeated = staged(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
                      .where(F.col("n") >= min_docs), "repeated-lines")
    # two staged tables: Spark splits the partition of a line that a third of all documents hold
    return found.join(repeated.hint("merge"), ["h1", "h2"]).where("doc_id < holder").select("doc_id", "h1", "h2")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bits: int = FILTER_BITS,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept_text, n_lines (before), n_dropped per document, and ``given`` (the
    columns of ``carry``)."""
    lost = (dropped_keys(docs, min_chars, min_docs, filter_bits)
            .groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))   # one document's lines
    extra = [F.struct(*carry).alias("given")] if carry else []
    rows = doc_rows(docs, *extra).join(lost.hint("shuffle_hash"), "doc_id", "left")
    given = [f for f in rows.schema.fields if f.name == "given"]
    schema = ", ".join(["doc_id bigint", "kept_text string", "n_lines bigint", "n_dropped bigint"]
                       + [f"given {f.dataType.simpleString()}" for f in given])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in passes(batches):
            col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            texts, dropped = col["text"], np.zeros(t.n, dtype=np.int64)
            n_lines = np.bincount(np.searchsorted(t.off, np.flatnonzero(t.buf[:t.size] == 10), side="right") - 1,
                                  minlength=t.n) + 1
            touched = np.flatnonzero(~np.asarray(col["lost"].is_null()))
            if len(touched):
                lines = Lines(t)
                first = np.searchsorted(lines.row, np.arange(t.n + 1))
                texts = texts.to_pylist()
                for i in touched:
                    lose = {(x["h1"], x["h2"]) for x in col["lost"][int(i)].as_py()}
                    span = range(first[i], first[i + 1])
                    h1, h2 = as_signed(lines.h1[span.start:span.stop]).tolist(), as_signed(lines.h2[span.start:span.stop]).tolist()
                    long = lines.chars[span.start:span.stop] >= min_chars
                    keep = [k for k, a, b, c in zip(span, h1, h2, long) if not (c and (a, b) in lose)]
                    dropped[i] = len(span) - len(keep)
                    texts[i] = b"\n".join(t.buf[lines.start[k]:lines.end[k]].tobytes() for k in keep).decode()
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], texts, pa.array(n_lines.astype(np.int64)), pa.array(dropped)]
                + [col["given"] for _ in given],
                names=["doc_id", "kept_text", "n_lines", "n_dropped"] + [f.name for f in given])

    return rows.mapInArrow(cut, schema).withColumn("doc_id", given_id())
