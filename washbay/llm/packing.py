"""Best-fit packing with swap-based local search (operator 8).

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces
are dealt by hash into groups of a bounded size; each group is packed by best fit in
descending order and then improved: bins that are not full trade one piece for one, two
for one, or move one or two pieces wherever the sum of squared fills grows, until no such
exchange is left; the emptiest bins run empty. Groups are bounded (GROUP_PIECES on average), so no task
holds more however large the table is, and each leaves less than a bin or so of waste.

NULL or empty texts are one piece with the end id; repeated rows are pieces of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import doc_rows, given_id, staged
from washbay.llm.token_ids import token_ids

CAPACITY = 2048
GROUP_PIECES = 1 << 15


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row (tells repeated ids apart), piece, start, length, ids_crc32 per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_ids(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, seats = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for doc, text, seat in zip(ids, batch.column(1).to_pylist(), seats):
                body = t.packed(text) + end
                for k, a in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[a:a + 4 * capacity]
                    rows.append((doc, seat, k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = doc_rows(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first into the bin that it fills best."""
    bins_with = [[] for _ in range(capacity + 1)]           # free space -> bins
    free_mask, out, made = 0, np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fitting = free_mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = bins_with[free].pop()
            if not bins_with[free]:
                free_mask &= ~(1 << free)
        else:
            free, b = capacity, made
            made += 1
        out[i] = b
        rest = free - need
        if rest:
            bins_with[rest].append(b)
            free_mask |= 1 << rest
    return out


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, sweeps: int | None = None) -> np.ndarray:
    """Improve ``bins`` in place by moves and swaps between bins that are not full, in ``sweeps``
    passes over them (default: until a pass finds none).

    Open bins are indexed by their slack: ``nearest[s, col[v]]`` is the shortest piece of at
    least ``v`` tokens in any bin of slack ``s`` (0, nothing, is in every bin: a move is a swap
    for nothing). What a bin gives, ``g`` tokens in one or two pieces, fits a bin of slack s for
    a piece of g - s or more, and the shortest of these gains most, so one lookup for each sum
    and slack sees every exchange. Each raises the sum of squared fills, which is bounded."""
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
    pieces = np.flatnonzero(fill[bins] < capacity)
    sizes = np.unique(np.append(lengths[pieces], 0))
    col = np.searchsorted(sizes, np.arange(capacity + 1))
    nothing = capacity + 1
    nearest = np.empty((capacity + 1, len(sizes) + 1), dtype=np.int32)   # rows are filled when a bin has that slack
    bins_at = np.zeros(capacity + 1, dtype=np.int64)
    holders: dict[tuple[int, int], dict[int, None]] = {}                 # (slack, length) -> bins
    members: dict[int, dict[int, list[int]]] = {}                        # bin -> length -> pieces
    for p, b, x in zip(pieces.tolist(), bins[pieces].tolist(), lengths[pieces].tolist()):
        members.setdefault(b, {}).setdefault(x, []).append(p)

    def enter(b: int) -> None:
        s = capacity - int(fill[b])
        if not 0 < s < capacity:
            return
        row = nearest[s]
        if not bins_at[s]:
            row[:] = nothing
            row[0] = 0
        bins_at[s] += 1
        for y in (0, *members[b]):
            held = holders.setdefault((s, y), {})
            if not held:
                part = row[:col[y] + 1]
                np.minimum(part, y, out=part)
            held[b] = None

    def leave(b: int) -> None:
        s = capacity - int(fill[b])
        row = nearest[s]
        bins_at[s] -= 1
        for y in (0, *members[b]):
            held = holders[s, y]
            del held[b]
            if not held and y:
                part = row[:col[y] + 1]
                part[part == y] = row[col[y] + 1]

    def carry(x: int, a: int, b: int) -> None:
        same = members[a][x]
        p = same.pop()
        if not same:
            del members[a][x]
        members[b].setdefault(x, []).append(p)
        bins[p] = b
        fill[a] -= x
        fill[b] += x

    for b in members:
        enter(b)
    done = 0
    while sweeps is None or done < sweeps:
        gained = 0
        givers = np.flatnonzero((fill > 0) & (fill < capacity))
        for a in givers[np.argsort(fill[givers], kind="stable")].tolist():
            if fill[a] == capacity:                          # an earlier giver filled it
                continue
            leave(a)
            while members[a]:
                have = sorted(members[a])
                gives = {x: (x,) for x in have}
                for i, x in enumerate(have):
                    for z in have[i if len(members[a][x]) > 1 else i + 1:]:
                        gives.setdefault(x + z, (z, x))
                slack, give = np.flatnonzero(bins_at), np.fromiter(gives, np.int64, len(gives))[:, None]
                if not len(slack):
                    break
                back = nearest[slack, col[np.maximum(give - slack, 0)]]
                gain = give - back
                worth = np.where(gain > 0, gain * (capacity - slack - fill[a] + gain), 0)
                k = int(worth.argmax())
                if worth.flat[k] <= 0:
                    break
                y, s, given = int(back.flat[k]), int(slack[k % len(slack)]), gives[int(give[k // len(slack), 0])]
                b = next(iter(holders[s, y]))
                leave(b)
                if y:
                    carry(y, b, a)
                for x in given:
                    carry(x, a, b)
                enter(b)
                gained += 1
            enter(a)
        done += 1
        if not gained:
            break
    return bins


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    names = [c for c in pieces.columns if c != "row"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        length = pdf.length.to_numpy()
        bins = local_search(length, best_fit(length, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        pdf, bins, length = pdf.iloc[order].copy(), bins[order], length[order]
        before = np.cumsum(length) - length
        first = np.append(True, bins[1:] != bins[:-1])
        pdf["sequence_id"] = pdf["grp"].astype("int64") * (1 << 32) + bins
        pdf["offset"] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pdf[names + ["sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "row")
    return (pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)))
            .groupBy("grp").applyInPandas(pack, schema + ", sequence_id bigint, offset bigint"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    pieces = staged(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity).withColumn("doc_id", given_id())
