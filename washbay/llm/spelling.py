"""Spelling variant grouping by Bloom-guided neighbourhoods (operator 11).

Words are counted per pass of text and summed by partial aggregates. Two words are near if
they differ by exactly one inserted, deleted or replaced code point. Every pair is looked
for from one side only: each word generates its deletions (the pair's longer word) and its
replacements by a larger letter of the vocabulary's alphabet, as 64-bit hashes worked out
from the word's own hash. The hashes are probed against a broadcast Bloom filter sharded by
word length (64-bit blocks, four bits a word); only positives are shuffled, as (hash, word
number, edit), to an exact join with the vocabulary, where the edit is applied to the
real word and compared with the real partner: false positives and collisions go there.

A filter has ``BITS`` bits per word of its length, so its rate of false positives does not
depend on the size of the vocabulary. Filters are sent in rounds of at most ``ROUND_WORDS``
words; a length with more words is cut by hash over several rounds. What is broadcast at
once is bounded, and a larger vocabulary takes more rounds.

Forms are aggregated per word (a word has at most about 180 near words a letter), and roots
come from pointer doubling: a form is at least ten times as frequent as its word, so chains
have no more links than the largest count has digits.

NULL texts have no words; a NULL doc_id is written as the empty string where ids enter;
repeated rows count again; equal counts go by the words' code points; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import _BASE, _BYTE_CODE, _LOWER, NULL_ID, as_signed, doc_rows, mix, passes, powers, staged

MIN_CHARS = 7
BITS = 16                      # filter bits per word
ROUND_WORDS = 4 << 20          # words whose filters are filled (64 MB of blocks to the driver) and broadcast (8 MB) at once
LENGTHS = 64                   # words of this length or more share a shard
PROBES = 1 << 20               # edits generated at a time

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True

_T = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _T = np.where(_T & 1, (_T >> 1) ^ np.uint32(0xEDB88320), _T >> 1).astype(np.uint32)


# --- words -------------------------------------------------------------------------

def _crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 of many byte spans, going on from ``crc`` (unfinished values)."""
    crc, order = crc.copy(), np.argsort(start - end, kind="stable")          # longest first
    size = (end - start)[order]
    for j in range(int(size[0]) if len(size) else 0):
        at = order[:np.searchsorted(-size, -j, side="left")]                  # spans longer than j
        crc[at] = _T[(crc[at] ^ buf[start[at] + j]) & np.uint32(255)] ^ (crc[at] >> np.uint32(8))
    return crc


def _runs(ids: list, t, min_chars: int, damage: int) -> pa.Array:
    """The words of the texts, in order: lower-cased runs of letters, one of ``damage`` with
    a code point deleted, of ``min_chars`` code points or more."""
    low = _LOWER[t.buf[:t.size]]
    lead = low == 0xC3                                   # U+00C0..U+00FF are C3 80..BF
    letter = _LETTER[low] | lead
    letter[1:] |= lead[:-1]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = letter
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[t.off] = True                                   # no run crosses two texts
    start = np.flatnonzero(letter & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = letter[1:]
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    points = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum((low & 0xC0) != 0x80, out=points[1:])
    size = points[end] - points[start]
    start, end, size = start[size >= min_chars], end[size >= min_chars], size[size >= min_chars]
    if not len(start):
        return pa.array([], pa.string())
    keep = np.ones(len(low), dtype=bool)
    if damage:
        row = np.searchsorted(t.off, start, side="right") - 1
        heads = [f"{'' if i == NULL_ID else i}:".encode() for i in ids]
        head = np.frombuffer(b"".join(heads), dtype=np.uint8)
        to = np.cumsum([len(h) for h in heads])
        crc = _crc32(head, np.append(0, to[:-1]), to, np.full(len(heads), 0xFFFFFFFF, dtype=np.uint32))
        crc = (_crc32(low, start, end, crc[row]) ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
        hit = np.flatnonzero(crc % damage == 0)
        lost = np.flatnonzero((low & 0xC0) != 0x80)[points[start[hit]] + crc[hit] % size[hit]]
        keep[lost] = False
        keep[(lost + 1)[low[lost] == 0xC3]] = False
        size[hit] -= 1
        start, end = start[size >= min_chars], end[size >= min_chars]
    kept = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    length = kept[end] - kept[start]
    inside = np.zeros(len(low) + 1, dtype=np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    data = low[(np.cumsum(inside[:-1]) > 0) & keep]
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(length, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, damage: int = 0) -> DataFrame:
    """word, n over all texts. ``damage``: every run whose crc32 of ``doc_id:run`` it divides
    loses a code point (0: none)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part, t in passes(batches):
            counted = pc.value_counts(_runs(part.column(0).to_pylist() if damage else [], t, min_chars, damage))
            held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
            rows += len(counted)
            if rows > 200_000:
                held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                rows = 0
                if held[0].num_rows > 200_000:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held = []
        if held:
            last = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            yield from last.to_batches(max_chunksize=50_000)

    return doc_rows(docs).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- hashes of words and their edits ------------------------------------------------

_POINT_CODE = mix(_BYTE_CODE ^ np.uint64(0x5851F42D4C957F2D))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _points(words: pa.Array, length: int) -> np.ndarray:
    """The code points (below 256) of words of one length, a row each."""
    joined = "".join(words.to_pylist()).encode("latin-1")
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(words), length)


def _plain(points: np.ndarray) -> np.ndarray:
    """Unfinished polynomial hashes: sum of code[p_i] * base**i."""
    p, _ = powers(points.shape[1] + 1)
    with np.errstate(over="ignore"):
        return (_POINT_CODE[points] * p[:points.shape[1]]).sum(axis=1, dtype=np.uint64)


def word_hash(words: pa.Array) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for i in range(0, len(at), step := max(1, PROBES // int(n))):
            part = at[i:i + step]
            out[part] = mix(_plain(_points(words.take(pa.array(part)), int(n))))
    return out


def edits(points: np.ndarray, letters: np.ndarray, deletions: bool = True, replacements: bool = True):
    """(hash, word, position, letter) arrays of the deletions (letter 0) and of the
    replacements by a larger letter; of a run of one letter only the last may be deleted.
    At most about PROBES edits come at a time."""
    n, length = points.shape
    p, _ = powers(length + 1)
    whole = _plain(points)
    with np.errstate(over="ignore"):
        left = np.zeros(n, dtype=np.uint64)
        for i in range(length):
            mine = _POINT_CODE[points[:, i]] * p[i]
            if deletions:
                at = np.flatnonzero(points[:, i] != points[:, i + 1]) if i + 1 < length else np.arange(n)
                yield mix(left[at] + (whole - left - mine)[at] * _INVERSE), at, i, np.zeros(len(at), dtype=np.uint8)
            for k in range(0, len(letters) if replacements else 0, step := max(1, PROBES // max(1, n))):
                new = letters[k:k + step]
                word, which = np.nonzero(new[None, :] > points[:, i][:, None])
                yield mix((whole - mine)[word] + _POINT_CODE[new[which]] * p[i]), word, i, new[which]
            left = left + mine


class Shards:
    """Bloom filters by word length over 64-bit blocks; shard -> (first block, blocks)."""

    def __init__(self, words: dict[int, int], bits: int):
        blocks = {s: max(1, -(-n * bits // 64)) for s, n in words.items()}
        ends = np.cumsum([0, *blocks.values()])
        self.at = {s: (int(a), b) for (s, b), a in zip(blocks.items(), ends)}
        self.data = np.zeros(int(ends[-1]), dtype=np.uint64)


def _block(h: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    first, blocks = span
    return first + ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _mask(h: np.ndarray) -> np.ndarray:
    one, out = np.uint64(1), np.zeros(len(h), dtype=np.uint64)
    for j in range(4):
        out |= one << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return out


def _rounds(sizes: dict[int, int], most: int) -> list[dict[int, tuple[int, int, int]]]:
    """Rounds of {shard: (slice, slices, words)}: at most about ``most`` words a round."""
    out, now, held = [], {}, 0
    for shard, n in sorted(sizes.items()):
        slices = -(-n // most)
        for i in range(slices):
            part = -(-n // slices)
            if now and (held + part > most or shard in now):
                out.append(now)
                now, held = {}, 0
            now[shard] = (i, slices, part)
            held += part
    return out + ([now] if now else [])


def _slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(slices)).astype(np.int64)


def _filters(vocabulary: DataFrame, turn: dict, bits: int) -> Shards:
    """The round's filters, filled from the vocabulary by the tasks: each task ships the
    blocks it set (distinct, ORed on the way), never more than the words it read."""
    layout = Shards({s: n for s, (_, _, n) in turn.items()}, bits)
    at = layout.at

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            shard = b.column(1).to_numpy()
            for s, (i, slices, _) in turn.items():
                mine = h[shard == s]
                mine = mine[_slice_of(mine, slices) == i] if slices > 1 else mine
                yield pa.RecordBatch.from_arrays([pa.array(_block(mine, at[s])), pa.array(as_signed(_mask(mine)))], names=["place", "bits"])

    filled = vocabulary.select("h", "shard").mapInArrow(fill, "place bigint, bits bigint") \
                       .groupBy("place").agg(F.expr("bit_or(bits)").alias("bits"))
    got = filled.toArrow()                                   # at most ROUND_WORDS rows of 16 bytes
    layout.data[got["place"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return layout


def near_pairs(vocabulary: DataFrame, bits: int = BITS, round_words: int = ROUND_WORDS) -> DataFrame:
    """a, b: the numbers of all near words, each pair once. ``vocabulary``: id, word, h, shard
    (staged, so that the numbers stay)."""
    spark = vocabulary.sparkSession
    sizes = {r["shard"]: r["n"] for r in vocabulary.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}   # <= LENGTHS rows
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("l")).distinct().where("l <> ''").collect()  # <= 90
    alphabet = np.array(sorted(ord(r["l"]) for r in letters), dtype=np.uint8)
    found = None
    for turn in _rounds(sizes, round_words):
        filters = _filters(vocabulary, turn, bits)
        data, at = spark.sparkContext.broadcast(filters.data), filters.at

        def probe(batches: Iterator[pa.RecordBatch], turn=turn, data=data, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, words = b.column(0).to_numpy(), b.column(1)
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
                for n in np.unique(size):
                    n, rows = int(n), np.flatnonzero(size == n)
                    less, same = min(n - 1, LENGTHS) in turn, min(n, LENGTHS) in turn       # shards that this round holds
                    if not (less or same):
                        continue
                    for i in range(0, len(rows), step := max(1, PROBES // (64 + n))):
                        part = rows[i:i + step]
                        for h, word, place, letter in edits(_points(words.take(pa.array(part)), n), alphabet, less, same):
                            if not len(h):
                                continue
                            out = min(n, LENGTHS) if letter[0] else min(n - 1, LENGTHS)
                            index, slices, _ = turn[out]
                            mask = _mask(h)
                            hit = (data.value[_block(h, at[out])] & mask) == mask
                            if slices > 1:
                                hit &= _slice_of(h, slices) == index
                            if hit.any():
                                k = int(hit.sum())
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(as_signed(h[hit])), pa.array(ids[part[word[hit]]]), pa.array(np.full(k, place, dtype=np.int32)),
                                     pa.array(letter[hit].astype(np.int32))], names=["h", "a", "place", "letter"])

        positive = vocabulary.select("id", "word").mapInArrow(probe, "h bigint, a bigint, place int, letter int")
        met = positive.join(vocabulary.select("h", F.col("id").alias("b"), F.col("word").alias("other")).hint("merge"), "h")
        own = vocabulary.select(F.col("id").alias("a"), "word")
        put = F.when(F.col("letter") == 0, F.lit("")).otherwise(F.expr("decode(unhex(lpad(hex(letter), 4, '0')), 'UTF-16BE')"))
        edited = F.concat(F.expr("substring(word, 1, place)"), put, F.expr("substring(word, place + 2)"))
        true = staged(met.join(own.hint("merge"), "a").where(edited == F.col("other")).select("a", "b"), "near-words")
        data.unpersist()
        found = true if found is None else found.unionByName(true)
    return found if found is not None else vocabulary.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)


def _with_hash(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(0)
            size = np.minimum(pc.utf8_length(word).to_numpy(zero_copy_only=False), LENGTHS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([word, b.column(1), pa.array(as_signed(word_hash(word))), pa.array(size)],
                                             names=["word", "n", "h", "shard"])

    return words.mapInArrow(run, "word string, n bigint, h bigint, shard int")


def variant_forms(docs: DataFrame, min_chars: int = MIN_CHARS, min_n: int = 2, times: int = 10, damage: int = 0,
                  bits: int = BITS, round_words: int = ROUND_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``min_chars`` code points found
    ``min_n`` times or more: its form is the near word of largest n (ties: smallest), if that
    is at least ``times`` n; its root the end of the chain of forms."""
    counted = word_counts(docs, min_chars, damage).where(F.col("n") >= min_n).select("word", "n")
    vocabulary = staged(_with_hash(counted).withColumn("id", F.monotonically_increasing_id()), "vocabulary").select("id", "word", "n", "h", "shard")
    pairs = near_pairs(vocabulary, bits, round_words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocabulary.select(F.col("id").alias("b"), F.col("word").alias("w"), F.col("n").alias("m"))
    near = both.join(other.hint("merge"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "w", "b")).alias("top"))
    top = -F.col("top.less")
    words = vocabulary.join(near.withColumnRenamed("a", "id"), "id", "left")
    is_form = F.coalesce(top >= times * F.col("n"), F.lit(False))
    words = staged(words.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                F.when(is_form, F.col("top.b")).alias("to"), F.when(is_form, F.col("top.w")).alias("form"),
                                F.when(is_form, top).alias("form_n")), "word-forms")
    jump = words.where("to IS NOT NULL").select("id", "to", F.col("form").alias("root"))
    while True:                                                # doubling: a chain has log10(largest n) links at most
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("beyond"))
        stepped = staged(jump.join(ahead, "to", "left").select(
            "id", F.coalesce("next", "to").alias("to"), F.coalesce("beyond", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        jump = stepped.select("id", "to", "root")
        if stepped.where("moved").isEmpty():
            break
    return words.join(jump.select("id", "root"), "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
