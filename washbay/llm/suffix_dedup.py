"""Removal of repeated passages by prefix-free parsing (operator 4).

A byte goes when a string of ``MATCH`` (50) bytes covers it that also starts in a document
with a smaller doc_id; strings are judged on the input, and never cross documents.

Parsing. A rolling hash over ``GRAM`` bytes is taken at every position; the smallest hash
under each 50-byte window is its trigger, and a maximal run of windows with one trigger is a
phrase (it overlaps the next by 49 bytes). Trigger and phrase borders depend on the window's
bytes only, so equal passages are parsed equally wherever they stand, and every window
lies in exactly one phrase: comparing 50 bytes of two corpus suffixes never needs the phrase
that follows. The dictionary is the set of distinct phrases, the parse their order.

1.  Parse: per task (trigger, phrase hash, smallest doc_id) are shuffled by trigger in
    packed blocks. A phrase that a smaller document holds is removed whole; that settles
    the inside of copies. A trigger with several phrases in several documents may hide
    partial matches: the first holder of each of its phrases is asked for the bytes.
2.  Dictionary: the asked phrases meet by trigger; the suffixes of all phrases of a block are
    sorted by their 50 bytes (the dictionary's suffix array to that depth), equal
    neighbours are the same string, and those with a smaller holder are removed.
3.  Corpus: both kinds of hits are joined to the documents by id and applied.

A phrase's later holders within a task are settled there, so a passage of a third of all
documents is shuffled once per task. A trigger with many phrases (the edge of such a
passage) is dealt by phrase in step 1, and in step 2 by single windows, so it is spread too.

NULL texts are empty; a NULL id is smaller than all others; rows with the same id do not
remove each other's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import (PASS_BYTES, Texts, as_signed, byte_codes, doc_rows, given_id, group_bounds,
                                map_sorted_groups, mix, passes, span_hash, staged)

MATCH, GRAM = 50, 20
_WINDOW = MATCH - GRAM + 1
#: Phrases of one trigger, within a task or in all, from which it is dealt by phrase and window.
TASK_HOT, HOT = 64, 4096
#: Phrases that a task holds before it sends them off.
FLUSH = 2_000_000
WHOLE, ASK, ASK_WINDOWS = 0, 1, 2                    # what a hit says (two low bits of its key)
_FIRST, _SPREAD, _NOTE, _LATER = 0, 1, 2, 3          # kinds of shuffled phrase entries
_U = np.uint64


class Phrases:
    """The phrases of Texts: row, first and last window start, trigger and phrase hash."""

    def __init__(self, t: Texts):
        n, buf = t.size, t.buf
        words = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(n + 56,), strides=(1,))
        h = np.zeros(n + _WINDOW - 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at, c in ((0, 0x9E3779B97F4A7C15), (8, 0xC2B2AE3D27D4EB4F), (GRAM - 8, 0x165667B19E3779F9)):
                h += words[at:at + len(h)] * _U(c)
                h ^= h >> _U(31)
                h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        step = 1
        while step * 2 <= _WINDOW:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if step < _WINDOW:
            h = np.minimum(h[:len(h) - (_WINDOW - step)], h[_WINDOW - step:])
        h = h[:n]
        short = np.zeros(n + 1, dtype=np.int32)              # windows that would leave their text
        np.add.at(short, np.maximum(t.off[1:] - (MATCH - 1), t.off[:-1]), 1)
        np.add.at(short, t.off[1:], -1)
        valid = np.cumsum(short[:n]) == 0
        new = np.zeros(n + 1, dtype=bool)
        new[1:n] = (h[1:] != h[:-1]) | ~valid[:-1] | ~valid[1:] if n else False
        new[t.off] = True
        first = np.flatnonzero(new[:n] & valid)
        last = np.flatnonzero(new[1:] & valid)
        self.row = np.searchsorted(t.off, first, side="right") - 1
        self.first, self.last = first, last
        self.trigger = mix(h[first])
        self.hash = span_hash(byte_codes(t), first, last + MATCH)

    def keys(self) -> np.ndarray:
        """64-bit name of each phrase with the two low bits free."""
        return _key(self.trigger & _U(0xFFFFFFFF), self.hash & _U((1 << 40) - 1))


def _key(trigger32: np.ndarray, hash40: np.ndarray) -> np.ndarray:
    return ((hash40 << _U(24)) | (trigger32 & _U(0xFFFFFF))) & ~_U(3)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


# --- packed blocks -------------------------------------------------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) * a.itemsize for a in arrays], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join([np.ascontiguousarray(a).tobytes() for a in arrays]))


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes, at, out = np.frombuffer(raw, dtype="<u8", count=len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def _id_planes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids as their smallest and the byte planes of the offsets (high planes are zeros)."""
    low = ids.min() if len(ids) else np.int64(0)
    planes = (ids - low).astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max([1] + [i + 1 for i in range(8) if planes[i].any()])
    return np.array([low, used], dtype="<i8"), planes[:used].reshape(-1)


def _ids_of(head: np.ndarray, planes: np.ndarray) -> np.ndarray:
    low, used = int(head[0]), int(head[1])
    wide = np.zeros((len(planes) // used, 8), dtype=np.uint8)
    wide[:, :used] = planes.reshape(used, -1).T
    return wide.reshape(-1).view("<i8") + low


def _min_holders(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (keys, id) entries: indices of each key's smallest id, and one index for each
    larger id that holds it."""
    order = np.lexsort((ids, *reversed(keys)))
    key_at = group_bounds(*[k[order] for k in keys])
    both_at = group_bounds(*[k[order] for k in keys], ids[order])[:-1]
    first = np.isin(both_at, key_at[:-1], assume_unique=True)
    return order[both_at[first]], order[both_at[~first]]


# --- step 1 --------------------------------------------------------------------------

def _parse_blocks(rows: DataFrame, buckets: int, task_hot: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def send():
            trigger, phrase, ids = (np.concatenate(c) for c in zip(*held))
            phrase = phrase & _U((1 << 40) - 1)
            first, later = _min_holders([trigger, phrase], ids)
            runs = group_bounds(trigger[first])
            many = np.repeat(np.diff(runs) >= task_hot, np.diff(runs))
            note = first[runs[:-1]][np.diff(runs) >= task_hot]
            spread = mix(trigger ^ phrase)
            place = np.concatenate([_bucket(trigger[first[~many]], buckets), _bucket(spread[first[many]], buckets),
                                    _bucket(trigger[note], buckets), _bucket(spread[later], buckets)])
            entry = np.concatenate([first[~many], first[many], note, later])
            kind = np.repeat(np.array([_FIRST, _SPREAD, _NOTE, _LATER], dtype=np.uint8),
                             [int((~many).sum()), int(many.sum()), len(note), len(later)])
            order = np.argsort(place, kind="stable")
            place, entry, kind = place[order], entry[order], kind[order]
            bounds = group_bounds(place)
            for a in range(0, len(bounds) - 1, 64):
                part = [(int(place[x]), _pack((trigger[e := entry[x:y]] & _U(0xFFFFFFFF)).astype("<u4"), phrase[e].astype("<u4"),
                                              (phrase[e] >> _U(32)).astype(np.uint8), kind[x:y], *_id_planes(ids[e])))
                        for x, y in zip(bounds[a:a + 65][:-1], bounds[a:a + 65][1:])]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.binary())],
                                                 names=["bucket", "block"])

        for part, t in passes(batches):
            p = Phrases(t)
            if len(p.row):
                held.append((p.trigger, p.hash, part.column(0).to_numpy()[p.row]))
                count += len(p.row)
            if count >= FLUSH:
                yield from send()
                held, count = [], 0
        if held:
            yield from send()

    return rows.mapInArrow(run, "bucket int, block binary")


def _phrase_hits(table: pa.Table, hot_from: int = HOT) -> pa.Table | None:
    """(doc_id, key with what it says) of one or more whole buckets of phrase entries."""
    parts = []
    for bucket, block in zip(table["bucket"].to_pylist(), table["block"].to_pylist()):
        t, lo, hi, kind, head, planes = _unpack(block, "<u4", "<u4", "u1", "u1", "<i8", "u1")
        parts.append((np.full(len(t), bucket, dtype=np.int64), t.astype(np.uint64),
                      lo.astype(np.uint64) | hi.astype(np.uint64) << _U(32), kind, _ids_of(head, planes)))
    bucket, t, h, kind, ids = (np.concatenate(c) for c in zip(*parts))
    out_ids, out_keys = [ids[kind == _LATER]], [_key(t, h)[kind == _LATER] | _U(WHOLE)]
    for lane in (_FIRST, _SPREAD):
        use = np.flatnonzero(kind == lane)
        if not len(use):
            continue
        use = use[np.lexsort((ids[use], h[use], t[use], bucket[use]))]
        b, tt, hh, dd = bucket[use], t[use], h[use], ids[use]
        key = _key(tt, hh)
        phrase_at = group_bounds(b, tt, hh)
        size = np.diff(phrase_at)
        low = np.repeat(dd[phrase_at[:-1]], size)
        out_ids.append(dd[dd > low])
        out_keys.append(key[dd > low] | _U(WHOLE))
        head = phrase_at[:-1]                                # each phrase's smallest holder
        if lane == _SPREAD:
            says = np.full(len(head), ASK_WINDOWS)
        else:
            trigger_at = group_bounds(b, tt)
            n_phrases = np.diff(np.searchsorted(head, trigger_at))
            several = np.minimum.reduceat(dd, trigger_at[:-1]) < np.maximum.reduceat(dd, trigger_at[:-1])
            noted = _noted(b[trigger_at[:-1]], tt[trigger_at[:-1]], bucket[kind == _NOTE], t[kind == _NOTE])
            hot = noted | (n_phrases > hot_from)
            says = np.where(hot, ASK_WINDOWS, np.where((n_phrases > 1) & several, ASK, -1))
            says = np.repeat(says, n_phrases)
        head, says = head[says >= 0], says[says >= 0]
        out_ids.append(dd[head])
        out_keys.append(key[head] | says.astype(np.uint64))
    return pa.table({"doc_id": pa.array(np.concatenate(out_ids)), "hit": pa.array(as_signed(np.concatenate(out_keys)))})


def _noted(b, t, note_b, note_t) -> np.ndarray:
    return np.isin(b.astype(np.uint64) << _U(32) | t, note_b.astype(np.uint64) << _U(32) | note_t)


# --- texts and their hits --------------------------------------------------------------

def _packed_texts(rows: DataFrame) -> DataFrame:
    """doc_id, compressed text, and other columns: what is shuffled to meet the hits."""
    names = [c for c in rows.columns if c != "text"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            z = [pack.compress(x.as_buffer() or b"") for x in col["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([col[n] for n in names] + [pa.array(z, pa.binary())], names=names + ["z"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {fields[n]}" for n in names) + ", z binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.Array], Texts]]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        z = batch.column(batch.schema.get_field_index("z"))
        sizes = [max(0, zstandard.frame_content_size(x.as_buffer())) for x in z]
        at = 0
        while at < batch.num_rows:
            to, total = at, 0
            while to < batch.num_rows and (to == at or total + sizes[to] <= PASS_BYTES):
                total += sizes[to]
                to += 1
            part = batch.slice(at, to - at)
            col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            raw = [unpack.decompress(x.as_buffer()) for x in col["z"]]
            off = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in raw], out=off[1:])
            yield col, Texts(np.frombuffer(b"".join(raw) + bytes(64), dtype=np.uint8), off)
            at = to


class _Lookup:
    """Which of a batch's per-row hit lists hold a key, and at which place."""

    def __init__(self, lists: pa.Array):
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        flat = flat.field(0) if pa.types.is_struct(flat.type) else flat
        keys = flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.says = (keys & _U(3)).astype(np.int64)
        at = _with_row(keys & ~_U(3), np.repeat(np.arange(len(lists)), size))
        self.order = np.lexsort((self.says, at))            # "whole" before "ask"
        self.keys = at[self.order]

    def find(self, keys: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Place in the flattened lists, or -1."""
        want = _with_row(keys & ~_U(3), row)
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        good = (self.keys[at] == want) if len(self.keys) else np.zeros(len(want), dtype=bool)
        out = np.full(len(want), -1, dtype=np.int64)
        out[good] = self.order[at[good]]
        return out


def _with_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + row.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _window_hash(t: Texts, at: np.ndarray) -> np.ndarray:
    return span_hash(byte_codes(t), at, at + MATCH)


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions first[i]..last[i], and the i of each."""
    size = last - first + 1
    which = np.repeat(np.arange(len(first)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which], which


# --- step 2 --------------------------------------------------------------------------

def _dictionary_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of asked phrases (or single windows): id, key, length, bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col, t in _unpacked(batches):
            p, hits = Phrases(t), _Lookup(col["hits"])
            keys = p.keys()
            at = hits.find(keys, p.row)
            says = np.where(at >= 0, hits.says[np.maximum(at, 0)] if len(hits.says) else -1, -1)
            ids = col["doc_id"].to_numpy()
            ask = np.flatnonzero(says == ASK)
            wide = np.flatnonzero(says == ASK_WINDOWS)
            starts, which = _runs(p.first[wide], p.last[wide])
            wkey = _window_hash(t, starts) & ~_U(3) if len(starts) else np.zeros(0, np.uint64)
            wid = ids[p.row[wide[which]]] if len(starts) else np.zeros(0, np.int64)
            first, later = _min_holders([wkey], wid)
            # one entry per (document, phrase); windows: the smallest holder here, the others are settled
            keep = group_order(ids[p.row[ask]], keys[ask])
            ask = ask[keep]
            e_id = np.concatenate([ids[p.row[ask]], wid[first], wid[later]])
            e_key = np.concatenate([keys[ask], wkey[first], wkey[later]])
            e_from = np.concatenate([p.first[ask], starts[first], starts[later]])
            e_len = np.concatenate([p.last[ask] - p.first[ask] + MATCH, np.full(len(first), MATCH), np.zeros(len(later), np.int64)])
            place = np.concatenate([_bucket(p.trigger[ask], buckets), _bucket(mix(wkey[first]), buckets), _bucket(mix(wkey[later]), buckets)])
            order = np.argsort(place, kind="stable")
            bounds = group_bounds(place[order])
            out = []
            for x, y in zip(bounds[:-1], bounds[1:]):
                e = order[x:y]
                body, _ = _runs(e_from[e], e_from[e] + e_len[e] - 1)
                out.append((int(place[e[0]]), _pack(e_key[e], e_len[e].astype("<u4"), t.buf[body], *_id_planes(e_id[e]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())],
                                                 names=["bucket", "block"])

    return texts.mapInArrow(run, "bucket int, block binary")


def group_order(*cols: np.ndarray) -> np.ndarray:
    """One index for each distinct combination."""
    order = np.lexsort(cols[::-1])
    return order[group_bounds(*[c[order] for c in cols])[:-1]]


def _window_hits(table: pa.Table) -> pa.Table | None:
    """(doc_id, key, spans of removed windows inside the phrase) from the suffix order of
    the phrases of whole buckets. An empty span list: the window that the key names."""
    parts = []
    for block in table["block"].to_pylist():
        key, size, body, head, planes = _unpack(block, "<u8", "<u4", "u1", "<i8", "u1")
        parts.append((key, size.astype(np.int64), body, _ids_of(head, planes)))
    key, size, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    body = np.concatenate([p[2] for p in parts] + [np.zeros(64, np.uint8)])
    settled = size == 0
    base = np.cumsum(size) - size
    full = np.flatnonzero(~settled)
    starts, which = _runs(base[full], base[full] + size[full] - MATCH)
    entry = full[which]
    holder = ids[entry]
    # order of the suffixes by their first 50 bytes (big-endian words compare as bytes do)
    words = np.lib.stride_tricks.as_strided(body[:8].view(">u8"), shape=(len(body) - 8,), strides=(1,))
    columns = [words[starts + o].astype(np.uint64) for o in (0, 8, 16, 24, 32, 40, MATCH - 8)]
    order = np.lexsort((holder, *columns[::-1]))
    bounds = group_bounds(*[c[order] for c in columns])
    low = np.repeat(holder[order[bounds[:-1]]], np.diff(bounds))
    gone = np.zeros(len(starts), dtype=bool)
    gone[order] = holder[order] > low
    at = np.flatnonzero(gone)
    run_new = np.ones(len(at), dtype=bool)
    run_new[1:] = (at[1:] != at[:-1] + 1) | (entry[at[1:]] != entry[at[:-1]])
    a, b = at[run_new], at[np.append(run_new[1:], True)[:len(at)]] if len(at) else at
    e = entry[a]
    spans: dict[int, list[int]] = {}
    for i, x, y in zip(e.tolist(), (starts[a] - base[e]).tolist(), (starts[b] - base[e]).tolist()):
        spans.setdefault(i, []).extend((x, y))
    named = np.array(list(spans), dtype=np.int64)
    lists = [np.array(v, dtype="<u4").tobytes() for v in spans.values()] + [b""] * int(settled.sum())
    return pa.table({"doc_id": pa.array(np.concatenate([ids[named], ids[settled]])),
                     "key": pa.array(as_signed(np.concatenate([key[named], key[settled]]))),
                     "spans": pa.array(lists, pa.binary())})


# --- step 3 --------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), task_hot: int = TASK_HOT, hot: int = HOT) -> DataFrame:
    """doc_id, kept (bytes), kept_text (characters that are cut through go), n_bytes,
    n_removed, n_spans, and ``given`` (the columns of ``carry``)."""
    spark = docs.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = doc_rows(docs, *([F.struct(*carry).alias("given")] if carry else []))
    hits = map_sorted_groups(_parse_blocks(rows, buckets, task_hot), ["bucket"], [], "doc_id bigint, hit bigint",
                             lambda table: _phrase_hits(table, hot))
    hits = staged(hits, "phrase-hits")
    by_doc = hits.groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))              # one document's phrases
    asking = hits.where(f"(hit & 3) <> {WHOLE}").groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))
    asked = _packed_texts(rows.select("doc_id", "text")).join(asking.hint("shuffle_hash"), "doc_id")
    parts = map_sorted_groups(_dictionary_blocks(asked, buckets), ["bucket"], [], "doc_id bigint, key bigint, spans binary", _window_hits,
                              at_once=2 << 20)
    parts = staged(parts, "window-hits").groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("parts"))
    joined = (_packed_texts(rows).join(by_doc.hint("shuffle_hash"), "doc_id", "left")
              .join(parts.hint("shuffle_hash"), "doc_id", "left"))
    given = [f"given {f.dataType.simpleString()}" for f in rows.schema.fields if f.name == "given"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col, t in _unpacked(batches):
            removed = _removed(t, col)
            kept = [t.buf[a:b][~removed[a:b]].tobytes() for a, b in zip(t.off[:-1], t.off[1:])]
            edge = np.zeros(t.size, dtype=bool)
            edge[1:] = removed[1:] & ~removed[:-1]
            starts = t.off[:-1][t.off[:-1] < t.off[1:]]
            edge[starts] = removed[starts]
            total, spans = np.zeros(t.size + 1, np.int64), np.zeros(t.size + 1, np.int64)
            np.cumsum(removed, out=total[1:])
            np.cumsum(edge, out=spans[1:])
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                 pa.array(np.diff(t.off)), pa.array(total[t.off[1:]] - total[t.off[:-1]]), pa.array(spans[t.off[1:]] - spans[t.off[:-1]])]
                + [col["given"] for _ in given],
                names=["doc_id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans"] + ["given" for _ in given])

    schema = ", ".join(["doc_id bigint", "kept binary", "kept_text string", "n_bytes bigint", "n_removed bigint",
                        "n_spans bigint", *given])
    return joined.mapInArrow(run, schema).withColumn("doc_id", given_id())


def _removed(t: Texts, col: dict[str, pa.Array]) -> np.ndarray:
    """Mask of the removed bytes."""
    change = np.zeros(t.size + MATCH + 1, dtype=np.int32)
    if col["hits"].null_count == len(col["hits"]):
        return np.zeros(t.size, dtype=bool)
    p, hits, parts = Phrases(t), _Lookup(col["hits"]), _Lookup(col["parts"])
    keys = p.keys()
    at = hits.find(keys, p.row)
    says = np.where(at >= 0, hits.says[np.maximum(at, 0)] if len(hits.says) else -1, -1)

    def cut(first, last):
        np.add.at(change, first, 1)
        np.add.at(change, last + MATCH, -1)

    whole = np.flatnonzero(says == WHOLE)
    cut(p.first[whole], p.last[whole])
    if len(parts.keys):
        flat = col["parts"].flatten()
        spans = flat.field(1) if pa.types.is_struct(flat.type) else flat
        ask = np.flatnonzero(says == ASK)
        where = parts.find(keys[ask], p.row[ask])
        for i, k in zip(ask[where >= 0].tolist(), where[where >= 0].tolist()):
            s = np.frombuffer(spans[k].as_py(), dtype="<u4").astype(np.int64) + p.first[i]
            cut(s[0::2], s[1::2])
        wide = np.flatnonzero(says == ASK_WINDOWS)
        if len(wide):
            starts, which = _runs(p.first[wide], p.last[wide])
            found = parts.find(_window_hash(t, starts), p.row[wide[which]]) >= 0
            cut(starts[found], starts[found])
    return np.cumsum(change[:t.size]) > 0


def kept_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
