"""N-gram Jaccard join (operator 2): groups of documents linked by word shingles.

1.  Documents with the same shingle set are one *node* (hash of the sorted set), so exact
    copies are joined without pairs.
2.  A shared total order puts rare shingles first: a table of ``ORDER_CELLS`` counters
    over word hashes, summed over all documents, ranks a shingle by its rarest word's
    counter and then its hash (a shingle with a rare word is rare, and words stay countable
    in a fixed table long after shingles do not). The table is broadcast at any scale; the
    order only steers how many candidates there are, never which links are found. A shingle
    is one 64-bit number, its rank above 56 bits of its hash, so a sorted set is in order.
3.  Prefix filter: two sets with Jaccard >= t share one of their first |x| - ceil(t|x|) + 1
    shingles, and the shorter of them one of its first |x| - ceil(2t/(1+t) |x|) + 1. Prefix
    entries (shingle, node, size, position) are shuffled by shingle;
    shingles of one node stop there.
4.  Entries that met others carry a bitmap of the set (parity of hashed elements, two to
    four bits per element, ``MAP_BITS`` at most). Inside a shingle's bucket the length, positional and suffix filters
    (the bitmaps' differing bits bound the symmetric difference from below) discard pairs.
    A shingle's nodes are numbered as they stream by; every ``BLOCK`` of them are a block,
    so a shingle of very many nodes is spread over tasks.
5.  Round one verifies, per block, only a spanning forest of the surviving pairs: linked
    groups of near copies need n - 1 links, not all pairs. Of a shingle with several blocks,
    one entry per component then stands for its block, and a forest of these is verified.
    Round two verifies every surviving pair whose ends are still in different components;
    only shingles that still hold several components take part, and only there every block
    meets every other, so a hot shingle of near copies is never multiplied. Each pair is verified
    once, on the whole sets. No surviving pair is ever dropped, so components are exact.

Texts without words are in no group; NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import (Words, as_signed, doc_rows, given_id, group_bounds, map_sorted_groups, mix, passes,
                                shingles, staged)
from washbay.plans.components import components

ORDER_CELLS = 1 << 22
BLOCK = 1024
MAP_BITS = 1024                        # the most bits of a set's bitmap, which travels with its prefix entries
_SLICE = 1 << 16                       # counters per shuffled row
_FILTER_BITS = 1 << 23                 # bits of the filter over nodes whose sets are wanted


def _sets(t, size: int, order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingles per row, rare ones first, and the node of each row (0: no words)."""
    w = Words(t)
    h, row, at = shingles(w, size)
    word_rank = order[_cell(w.hash)]
    rank, length = word_rank[at], np.minimum(w.count(), size)[row]
    for j in range(1, size):
        use = length > j
        rank[use] = np.minimum(rank[use], word_rank[at[use] + j])
    h = (rank.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    bounds = np.searchsorted(row, np.arange(t.n + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    with np.errstate(over="ignore"):
        node = np.array([_node(s) for s in sets], dtype=np.int64)
    return sets, node


def _node(s: np.ndarray) -> int:
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        v = mix(np.array([s.sum(dtype=np.uint64) + mix(s).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                          + np.uint64(len(s))], dtype=np.uint64))
    return int(v.view(np.int64)[0]) or 1


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (ORDER_CELLS - 1)


def word_order(rows: DataFrame) -> np.ndarray:
    """uint8 rank of every counter cell: the logarithm of its count of words over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(ORDER_CELLS, dtype=np.uint32)
        for _, t in passes(batches):
            cells += np.bincount(_cell(Words(t).hash), minlength=ORDER_CELLS).astype(np.uint32)
        yield from send({i: cells[i * _SLICE:(i + 1) * _SLICE] for i in range(ORDER_CELLS // _SLICE)})

    def send(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for i, c in parts.items():
            if c.any():
                small = c.astype(np.uint16) if c.max() < 1 << 16 else c.astype(np.uint64)
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "width": pa.array([small.itemsize], pa.int32()),
                                                  "cells": [pack.compress(small.tobytes())]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i, width, cells in zip(*(b.column(k).to_pylist() for k in range(3))):
                c = np.frombuffer(unpack.decompress(cells), dtype=f"<u{width}").astype(np.uint64)
                held[i] = held[i] + c if i in held else c
        yield from send(held)

    schema = "part int, width int, cells binary"
    sums = rows.select("text").mapInArrow(count, schema)
    sums = sums.repartition("part", F.spark_partition_id() % 16).mapInArrow(add, schema)
    sums = sums.repartition("part").mapInArrow(add, schema)
    order = np.zeros(ORDER_CELLS, dtype=np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for r in sums.collect():                                 # ORDER_CELLS counters in all
        c = np.frombuffer(unpack.decompress(bytes(r["cells"])), dtype=f"<u{r['width']}").astype(np.float64)
        order[r["part"] * _SLICE:(r["part"] + 1) * _SLICE] = np.minimum(255, np.floor(8 * np.log2(1 + c)))
    return order


def _bitmap_bits(n: int) -> int:
    return min(MAP_BITS, max(64, 2 << (n - 1).bit_length()))


def _bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set; folding the longer of two halves it until sizes agree."""
    bits = _bitmap_bits(len(s))
    odd = np.bincount(((s >> np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(maps: list[bytes], bits: int) -> np.ndarray:
    out = np.zeros((len(maps), bits // 8), dtype=np.uint8)
    for i, m in enumerate(maps):
        a = np.frombuffer(m, dtype=np.uint8)
        out[i] = a if len(a) == bits // 8 else np.bitwise_xor.reduce(a.reshape(-1, bits // 8), axis=0)
    return out.view(np.uint64)


def _need(a, b, num: int, den: int):
    """Smallest overlap of two sets of these sizes with Jaccard >= num/den."""
    return -(-num * (a + b) // (num + den))


def jaccard_groups(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) per document; links
    are pairs with den * intersection >= num * union."""
    spark, rows = docs.sparkSession, doc_rows(docs)
    order = spark.sparkContext.broadcast(word_order(rows))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part, t in passes(batches):
            sets, node = _sets(t, size, order.value)
            n = [len(s) for s in sets]
            entries, places = [], []
            for s, v in zip(sets, node.tolist()):
                if v == 0 or v in met:                      # a task lists the prefix of a node once
                    entries.append(None)
                    continue
                met.add(v)
                p = len(s) - -(-num * len(s) // den) + 1
                entries.append(as_signed(s[:p]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array(n, pa.int64()),
                                              pa.array(entries, pa.list_(pa.int64()))],
                                             names=["doc_id", "node", "n_shingles", "prefix"])

    described = rows.mapInArrow(describe, "doc_id bigint, node bigint, n_shingles bigint, prefix array<bigint>")
    members = staged(described, "shingle-sets")
    listed = members.where("prefix IS NOT NULL")
    entries = listed.select("node", "doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    met = staged(_met(entries, block), "prefix-entries")
    holders = staged(listed.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "holders")
    maps = _node_values(rows, holders, met.select("node"), size, order, "map binary", _bitmap)
    met = staged(met.join(maps, "node"), "prefix-maps")

    def candidates(only_forest: bool, root: bool):
        told: set[tuple[int, int]] = set()                    # pairs of earlier buckets of the same task

        def run(table: pa.Table) -> pa.Table:
            if len(told) > 2_000_000:
                told.clear()
            return _block_pairs(table, num, den, only_forest, root, told)
        return run

    keys = ["gram", "i", "j"]

    def forest(listed: DataFrame, name: str) -> DataFrame:
        """Verified pairs of a spanning forest of each block's candidates; blocks meet no other."""
        own = listed.select("gram", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", "n", "pos", "map")
        pairs = map_sorted_groups(own, keys, ["node"], "a bigint, b bigint", candidates(True, False)).distinct()
        return staged(_verify(rows, holders, staged(pairs, f"pairs-{name}"), size, order, num, den), f"checked-{name}")

    def rooted(links: DataFrame) -> DataFrame:
        roots = staged(components(links.where("linked").select("a", "b")), "roots-so-far")
        return met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    first = forest(met, "1")
    now = rooted(first)
    hot = met.where("own > 0").select("gram").distinct()
    if not hot.isEmpty():                                     # blocks of one shingle: one entry for each of their components
        heads = now.join(hot, "gram").groupBy("gram", "root").agg(F.min(F.struct("node", "n", "pos", "map")).alias("e"))
        heads = staged(heads.select("gram", "e.*"), "block-heads")
        many = heads.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        heads = heads.join(many, "gram").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        first = staged(first.union(forest(heads, "heads")).distinct(), "checked-blocks")
        now = rooted(first)
    apart = (now.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("own").alias("last"))
             .where("x <> y").select("gram", "last"))
    spread = (now.join(apart, "gram").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
              .select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "pos", "map", "root"))
    second = map_sorted_groups(spread, keys, ["node"], "a bigint, b bigint", candidates(False, True)).distinct()
    second = staged(second.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs-2")
    checked = _verify(rows, holders, second, size, order, num, den)
    links = staged(first.union(checked).where("linked").select("a", "b"), "links")
    roots = staged(components(links), "roots")
    sets = members.select("doc_id", "node", "n_shingles").join(roots, "node", "left")
    sets = sets.withColumn("root", F.coalesce("root", "node"))
    lowest = sets.where("node <> 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (sets.join(lowest, "root", "left")
            .select(given_id(), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("component_id", given_id("component_id")))


def _met(entries: DataFrame, block: int) -> DataFrame:
    """gram, node, n, pos, own: one row per node of the shingles that at least two nodes hold;
    every ``block`` nodes of a shingle are a block (``own``: 0, 1, ...). A shingle's nodes
    stream by in order, a batch at a time, and are never gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                                           # the row before, where it is its shingle's first
        gram_before, node_before, seat_before = None, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = len(gram)
            fresh = np.ones(n, dtype=bool)                    # a shingle's first row in this batch
            fresh[1:] = gram[1:] != gram[:-1]
            new = fresh.copy()                                # not a node's copy from another task
            new[1:] |= node[1:] != node[:-1]
            goes_on = gram_before is not None and gram[0] == gram_before
            if goes_on:
                new[0] = node[0] != node_before
            count = np.cumsum(new)
            begin = np.flatnonzero(fresh)
            seat = count - np.repeat(count[begin] - new[begin], np.diff(np.append(begin, n))) - 1
            if goes_on:
                seat[:begin[1] if len(begin) > 1 else n] += seat_before + 1
            at = np.flatnonzero(new)
            seats, grams = seat[at], gram[at]
            paired = seats > 0
            paired[:-1] |= grams[1:] == grams[:-1]
            if last is not None and len(at) and goes_on and grams[0] == gram_before:
                yield last
            if len(at):
                last = None
            rows = batch.take(pa.array(at)).append_column("own", pa.array(seats // block))
            yield rows.filter(pa.array(paired))
            if len(at) and not paired[-1]:
                last = rows.slice(len(at) - 1)
            gram_before, node_before, seat_before = gram[-1], node[-1], seat[-1]

    ordered = entries.select("gram", "node", "n", "pos").repartition("gram").sortWithinPartitions("gram", "node")
    return ordered.mapInArrow(run, "gram bigint, node bigint, n bigint, pos int, own bigint")


def _node_values(rows: DataFrame, holders: DataFrame, nodes: DataFrame, size: int, order, column: str, value) -> DataFrame:
    """node and one value of its set, for every node in ``nodes``: a scan that computes
    the sets of the nodes' holders again, found by a fixed-size filter over their ids."""
    bits, nodes = _FILTER_BITS, nodes.distinct()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            _probe(seen, b.column(0).to_numpy(), True)
        if seen.any():
            yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "f": [zstandard.ZstdCompressor(level=1).compress(seen.tobytes())]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_seen = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for f in b.column(1).to_pylist():
                all_seen |= np.frombuffer(zstandard.ZstdDecompressor().decompress(f), dtype=np.uint8)
        if all_seen.any():
            yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "f": [zstandard.ZstdCompressor(level=1).compress(all_seen.tobytes())]})

    parts = holders.join(nodes, "node", "left_semi").select("doc_id").mapInArrow(fill, "k int, f binary")
    parts = parts.repartition(8, F.spark_partition_id()).mapInArrow(merge, "k int, f binary")
    seen = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.collect():                                # at most 8 filters of fixed size
        seen |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["f"])), dtype=np.uint8)
    wanted = rows.sparkSession.sparkContext.broadcast(seen)
    name = column.split()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        kept = (b.filter(pa.array(_probe(wanted.value, b.column(0).to_numpy(), False))) for b in batches)
        for _, t in passes(kept):
            sets, node = _sets(t, size, order.value)
            out_nodes, out = [], []
            for i, v in enumerate(node.tolist()):
                if v and v not in done:
                    done.add(v)
                    out_nodes.append(v)
                    out.append(value(sets[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", name])

    found = rows.mapInArrow(scan, f"node bigint, {column}")
    exact = found.join(nodes, "node", "left_semi")
    return exact.groupBy("node").agg(F.first(name).alias(name))


def _probe(bits: np.ndarray, nodes: np.ndarray, add: bool) -> np.ndarray | None:
    h = mix(nodes.astype(np.int64).view(np.uint64)) & np.uint64(len(bits) * 8 - 1)
    at, bit = (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)
    if add:
        np.bitwise_or.at(bits, at, bit)
        return None
    return (bits[at] & bit) != 0


def _block_pairs(table: pa.Table, num: int, den: int, only_forest: bool, rooted: bool, told: set) -> pa.Table:
    """Pairs of each (shingle, block, block) group that pass the filters; a spanning forest
    of them, or all whose ends have different roots; none of ``told``, which grows by them."""
    gram, i, j = (table[c].to_numpy() for c in ("gram", "i", "j"))
    own, node, n, pos = (table[c].to_numpy() for c in ("own", "node", "n", "pos"))
    root = table["root"].to_numpy() if rooted else None
    maps = table["map"].to_pylist()
    bounds = group_bounds(gram, i, j)
    out_a, out_b = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2 or rooted and (root[lo:hi] == root[lo]).all():
            continue
        order = lo + np.argsort(n[lo:hi], kind="stable")
        sizes, places, sides, names = n[order], pos[order], own[order], node[order]
        two_sides = i[lo] != j[lo]
        top = np.searchsorted(sizes, sizes * den // num, side="right")          # length filter
        bits = _bitmap_bits(int(sizes[0]))
        indexed = sizes - _need(sizes, sizes, num, den) + 1    # the shorter set's prefix can be shorter still
        step, packed, packed_bits = 0, None, 0
        forest = {int(v): int(v) for v in names} if only_forest else None
        for x in range(len(order) - 1):
            a, b = x + 1, int(top[x])
            if b <= a or places[x] >= indexed[x]:
                continue
            own_bits = _bitmap_bits(int(sizes[x]))
            if packed is None or own_bits != packed_bits:     # maps of this size or folded to it
                packed, packed_bits, step = _fold([maps[k] for k in order[x:]], own_bits), own_bits, x
            other = np.arange(a, b)
            if two_sides:
                other = other[sides[other] != sides[x]]
            if rooted:
                other = other[root[order[other]] != root[order[x]]]
            if not len(other):
                continue
            need = _need(sizes[x], sizes[other], num, den)
            # positional filter: what can still come after this shingle in both
            other = other[1 + np.minimum(sizes[x] - places[x] - 1, sizes[other] - places[other] - 1)
                          + np.minimum(places[x], places[other]) >= need]
            if not len(other):
                continue
            differ = np.bitwise_count(packed[x - step] ^ packed[other - step]).sum(axis=1).astype(np.int64)
            need = _need(sizes[x], sizes[other], num, den)
            other = other[(sizes[x] + sizes[other] - differ) // 2 >= need]       # suffix filter
            for y in other.tolist():
                u, v = int(names[x]), int(names[y])
                if forest is not None:
                    ru, rv = _find(forest, u), _find(forest, v)
                    if ru == rv:
                        continue
                    forest[ru] = rv
                pair = (u, v) if u < v else (v, u)
                if pair not in told:
                    told.add(pair)
                    out_a.append(pair[0])
                    out_b.append(pair[1])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _find(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _verify(rows: DataFrame, holders: DataFrame, pairs: DataFrame, size: int, order, num: int, den: int) -> DataFrame:
    """a, b, linked: the exact test of every pair on the whole sets."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = staged(_node_values(rows, holders, ends, size, order, "shingles binary", lambda s: s.tobytes()), "sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    return both.mapInArrow(test, "a bigint, b bigint, linked boolean")


def one_per_group(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (rows that repeat this id
    are the same document and stay); documents in no group stay."""
    groups = jaccard_groups(docs, size, num, den)
    first = groups.where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
