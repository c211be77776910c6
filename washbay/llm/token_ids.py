"""Token ids of whole tables with the tokenizers library, shared by the token files and
the packing. A run between white space is encoded once per worker and kept in a bounded
table: runs are normalised, cut by the file's own Split pattern and handed to the library's
BPE model; runs with a special token and texts with odd separators go through the
library's encode()."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import regex

from washbay.llm.bpe import RunTable, byte_symbols, runs_of

_open: dict[str, "TokenIds"] = {}


class TokenIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = RunTable(self._whole)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        if ([x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
                and spec["post_processor"] is None):
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            self.any_piece = regex.compile(pattern)
            # inside an ASCII run \p{L} is a-z and \p{N} is 0-9
            self.piece = re.compile(pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9"))
            self.model = self.library.model
            self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
            self.stand_in = {b: s for b, s in enumerate(byte_symbols()) if chr(b) != s}      # over Latin-1 code points
            self.table = RunTable(self._run)
            self.by_run = True
        else:
            self.by_run = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if self.special.search(run):
            return self._whole(run)
        tokenize = self.model.tokenize
        if run.isascii():
            pieces = self.piece.findall(run.lower())
            if run.isprintable():                          # printable ASCII stands for itself
                return array("I", [t.id for p in pieces for t in tokenize(p)]).tobytes()
        else:                                              # per character, as the library lower-cases
            low = "".join([c.lower() for c in unicodedata.normalize("NFC", run)])
            pieces = [p if p.isascii() else p.encode().decode("latin-1") for p in self.any_piece.findall(low)]
        return array("I", [t.id for p in pieces for t in tokenize(p.translate(self.stand_in))]).tobytes()

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        runs = runs_of(text) if self.by_run else None
        return self._whole(text) if runs is None else b"".join(self.table.of(runs))


def token_ids(path: str) -> TokenIds:
    if path not in _open:
        _open[path] = TokenIds(path)
    return _open[path]
