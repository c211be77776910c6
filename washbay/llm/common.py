"""Helpers of the text operators: columns in and out, staged tables, sorted groups, and
numpy passes over whole Arrow batches of text (no per-row Python)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washbay.plans.staging import staged, staged_path  # noqa: F401  (used by the operators)

#: Stands for a NULL doc_id inside the operators (restored on output).
NULL_ID = -(1 << 63)
#: Bytes of text that one numpy pass holds at a time (a longer single text is one pass).
PASS_BYTES = 2 << 20


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (NULL: NULL_ID) and text (NULL: empty) of a documents table, and ``more``."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def given_id(name: str = "doc_id") -> Column:
    """The id as given: NULL_ID becomes NULL again."""
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


# --- sorted groups -----------------------------------------------------------------

def map_sorted_groups(df: DataFrame, keys: list[str], within: list[str], schema: str,
                      fn: Callable[[pa.Table], pa.Table | None], spread: list[str] | None = None,
                      at_once: int = 8 << 20) -> DataFrame:
    """Shuffle by ``spread`` (default ``keys``), sort, and hand ``fn`` tables that hold
    whole groups of ``keys`` (many small groups at a time, about ``at_once`` bytes of them)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def emit(table: pa.Table):
            out = fn(table)
            if out is not None and out.num_rows:
                yield from out.to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000 and sum(b.nbytes for b in held) < at_once:
                continue
            table = pa.Table.from_batches(held)
            cut = _last_group_start(table, keys)
            if cut == 0:
                continue
            yield from emit(table.slice(0, cut))
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield from emit(pa.Table.from_batches(held))

    shuffled = df.repartition(*(spread or keys)).sortWithinPartitions(*keys, *within).select(*names)
    return shuffled.mapInArrow(run, schema)


def _last_group_start(table: pa.Table, keys: list[str]) -> int:
    n = table.num_rows
    same = np.ones(n, dtype=bool)
    for k in keys:
        col = table[k]
        same &= np.asarray(pc.equal(col, col[n - 1]).combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def group_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in sorted columns, and the end."""
    n = len(cols[0])
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


# --- numpy over texts --------------------------------------------------------------

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and its inverses modulo 2**64 (kept; grown when a longer text comes)."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(PASS_BYTES + (1 << 16), n)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", _BASE_INV)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                _powers[name] = np.cumprod(table, out=table)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Some rows of a text column as one byte buffer: ``buf`` (with 64 spare bytes of
    zeros) and ``off`` (row starts and the end)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @property
    def size(self) -> int:
        return int(self.off[-1])


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    buf = np.zeros(len(body) + 64, dtype=np.uint8)
    buf[:len(body)] = body
    return Texts(buf, off - off[0])


def passes(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most PASS_BYTES of text (or one row), as Texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + PASS_BYTES, side="right")))
            part = batch.slice(at, to - at)
            yield part, texts_of(part.column(part.schema.get_field_index(column)))
            at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of Texts: byte spans, 64-bit hashes of the words
    (A-Z lower-cased unless ``lower`` is False), and ``first``: row i has the words
    first[i]..first[i+1]."""

    def __init__(self, t: Texts, lower: bool = True):
        n = t.size
        raw = t.buf[:n]
        word = ~_WHITE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[t.off] = True                                  # no word crosses two texts
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, t.off)
        code = _BYTE_CODE[_LOWER[raw] if lower else raw]
        self.hash = span_hash(code, self.start, self.end)
        self.is_word = word

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def span_hash(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of code[start:end] for many spans, equal for equal sequences wherever they stand."""
    p, q = powers(len(code) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code * p[:len(code)], out=total[1:])
        return mix((total[end] - total[start]) * q[start])


def byte_codes(t: Texts) -> np.ndarray:
    return _BYTE_CODE[t.buf[:t.size]]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word shingles: hashes, their row, and the word each starts at. A row with fewer
    words (but some) has one shingle, its whole sequence; it differs from longer ones."""
    count = w.count()
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), made)
    begin = np.cumsum(made) - made
    at = np.arange(len(row)) - begin[row] + w.first[:-1][row]
    length = np.minimum(count, size)[row]
    with np.errstate(over="ignore"):
        h = np.full(len(row), 0x51ED270B, dtype=np.uint64) + length.astype(np.uint64)
        for j in range(size):
            use = slice(None) if (count[count > 0] >= size).all() else length > j
            h[use] = mix(h[use] * np.uint64(0xD6E8FEB86659FD93) + w.hash[at[use] + j])
    return h, row, at


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# --- the package on the executors ----------------------------------------------------

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors (as --py-files does), once per application, so
    that their Python finds it whatever folder the driver was started in."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import os
    import tempfile
    import zipfile

    import washbay
    root = os.path.dirname(os.path.abspath(washbay.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="washbay-pkg-"), "washbay_pkg.zip")   # read by this driver only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("washbay", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
