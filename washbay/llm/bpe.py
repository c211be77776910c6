"""BPE encoding and decoding from a tokenizer file (operator 6).

Encoding: a priority queue of (merge rank, position) over a doubly linked list of symbols;
entries whose symbols have changed since they were queued are skipped. Decoding concatenates
the vocabulary strings (with a space between tokens, as a file without a decoder asks for).
Texts are split at white space first; runs between white space and the pieces that the Split
pattern cuts them into are kept in bounded tables per worker, so the queue runs once per
distinct piece. Symbols are integers, a pair of them is one dictionary key.

The file must hold a BPE model with byte-level symbols and an end-of-word suffix, the
normalizers NFC, white-space squeeze and lower case, and a Split pattern; other settings
raise ValueError instead of giving other ids. NULL or empty texts give no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from washbay.llm.common import doc_rows, given_id

#: Distinct runs in each of a worker's two tables (a memory bound, not a limit on input).
KEPT_RUNS = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A BPE tokenizer read from a tokenizers-format JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        steps = [x["type"] for x in pre.get("pretokenizers", [])]
        if (model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"]
                or spec["decoder"] is not None or spec["post_processor"] is not None or not model["end_of_word_suffix"]):
            raise ValueError(f"unsupported tokenizer settings in {path}")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        number: dict[str, int] = {}                         # symbols as integers, also those without an id
        of = lambda s: number.setdefault(s, len(number))
        self.inner = [of(s) for s in byte_symbols()]
        self.last = [of(s + self.suffix) for s in byte_symbols()]
        self.merges: dict[int, int] = {}                    # left << 32 | right -> rank
        self.merged: list[int] = []                         # rank -> symbol
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[of(a) << 32 | of(b)] = rank
            self.merged.append(of(a + b))
        self.id_of = [self.vocab.get(s) for s in number]    # symbol -> id, None outside the vocabulary
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        # inside ASCII, letters are a-z and numbers 0-9
        self.ascii_piece = re.compile(pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9")).findall
        self.special_in = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search
        self.squeeze = regex.compile(norm["normalizers"][1]["pattern"]["Regex"])

    def encode_piece(self, piece: str) -> list[int]:
        """Merge the byte symbols of one piece, lowest rank first, leftmost among equals.
        A queue entry is rank << 32 | position; it is stale once the pair there has another rank."""
        body = piece.encode("utf-8")
        if not body:
            return []
        inner, rank_of = self.inner, self.merges.get
        sym = [inner[b] for b in body]
        sym[-1] = self.last[body[-1]]
        n = len(sym)
        rank = [rank_of(a << 32 | b, -1) for a, b in zip(sym, sym[1:])]
        queue = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if queue:
            heapq.heapify(queue)
            rank.append(-1)                                 # nothing follows the last symbol
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            while queue:
                top = heapq.heappop(queue)
                i = top & 0xFFFFFFFF
                r = top >> 32
                if rank[i] != r:
                    continue                                # stale: a neighbour has been merged meanwhile
                j = right[i]
                new = sym[i] = self.merged[r]
                sym[j] = rank[j] = -1
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    r = rank[i] = rank_of(new << 32 | sym[k], -1)
                    if r >= 0:
                        heapq.heappush(queue, r << 32 | i)
                else:
                    rank[i] = -1
                k = left[i]
                if k >= 0:
                    r = rank[k] = rank_of(sym[k] << 32 | new, -1)
                    if r >= 0:
                        heapq.heappush(queue, r << 32 | k)
        id_of = self.id_of
        return [x for s in sym if s >= 0 and (x := id_of[s]) is not None]

    def pieces_of(self, run: str) -> list[str] | None:
        """The normalised pieces of a run without white space; None where it holds a special token."""
        if self.special_in(run):
            return None
        if run.isascii():
            return self.ascii_piece(run.lower())
        return self.piece.findall(self._normal(run))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special_at.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def _normal(self, text: str) -> str:
        if text.isascii():
            return self.squeeze.sub(" ", text).lower()
        text = self.squeeze.sub(" ", unicodedata.normalize("NFC", text))
        return "".join([c.lower() for c in text])

    def _plain(self, text: str) -> list[int]:
        return [i for piece in self.piece.findall(self._normal(text)) for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_open: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


#: ASCII separators that str.split() cuts at but the squeeze pattern keeps inside a run.
_ODD = "\x1c\x1d\x1e\x1f"


class _Young(dict):
    """The young generation: looks a missing run up in the old one, else makes its value."""

    __slots__ = ("old", "value")

    def __missing__(self, run: str):
        v = self.old.get(run)
        if v is None:
            v = self.value(run)
        self[run] = v
        return v


class RunTable:
    """run -> value(run), made on demand. Two generations of about KEPT_RUNS: when the
    young one is full it becomes the old one, so runs in use stay and memory is bounded."""

    def __init__(self, value):
        self.value = value
        self._renew({})

    def _renew(self, old: dict) -> None:
        self.young = _Young()
        self.young.old, self.young.value = old, self.value

    def of(self, runs: list[str]) -> list:
        if len(self.young) > KEPT_RUNS:
            self.young.old = {}
            self._renew(dict(self.young))
        return list(map(self.young.__getitem__, runs))


def runs_of(text: str) -> list[str] | None:
    """The runs between white space, or None where they can't be cut apart safely."""
    return None if any(c in text for c in _ODD) else text.split()


_tables: dict[str, RunTable] = {}


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (token ids) per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        pieces = _tables.setdefault("piece-ids:" + path, RunTable(lambda p: array("i", t.encode_piece(p)).tobytes()))

        def entry(run: str) -> bytes:
            cut = t.pieces_of(run)
            return array("i", t.encode(run)).tobytes() if cut is None else b"".join(pieces.of(cut))

        table = _tables.setdefault("ids:" + path, RunTable(entry))
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                runs = runs_of(text)
                packed.append(b"".join(table.of(runs)) if runs is not None else array("i", t.encode(text)).tobytes())
            ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return doc_rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>").withColumn("doc_id", given_id())


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (ids outside the vocabulary are skipped; NULL ids give an empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = [t.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids as text and of the decoded text: encode and
    decode in one pass, so that neither ids nor texts leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)

        def made(ids: list[int]):
            return len(ids), " ".join(map(str, ids)), t.decode(ids)

        pieces = _tables.setdefault("pieces:" + path, RunTable(lambda p: made(t.encode_piece(p))))

        def entry(run: str):
            cut = t.pieces_of(run)
            if cut is None:
                return made(t.encode(run))
            found = [p for p in pieces.of(cut) if p[0]]
            if len(found) < 2:
                return found[0] if found else (0, "", "")
            n, a, b = zip(*found)
            return sum(n), " ".join(a), " ".join(b)

        table = _tables.setdefault("digest:" + path, RunTable(entry))
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                runs = runs_of(text)
                parts = [p for p in (table.of(runs) if runs is not None else [made(t.encode(text))]) if p[0]]
                counts, ids, words = zip(*parts) if parts else ((), (), ())
                n.append(sum(counts))
                a.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                b.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                                              pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (doc_rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
            .withColumn("doc_id", given_id()))
