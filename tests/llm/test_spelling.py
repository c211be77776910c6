"""Operator 11 against all pairs of a small vocabulary."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from washbay.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near_words(words):
    """Per word all near ones: words less a letter in the vocabulary, and words that agree
    but for one place."""
    close, gaps = collections.defaultdict(set), collections.defaultdict(list)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].append(w)
            if (less := w[:i] + w[i + 1:]) in words:
                close[w].add(less)
                close[less].add(w)
    for same in gaps.values():
        for w in same:
            close[w].update(x for x in same if x != w)
    return close


def brute(rows, damage=31):
    counts = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, close = {}, {}
    others_of = near_words(words)
    for w, n in words.items():
        others = others_of[w]
        close[w] = len(others)
        top = min(others, key=lambda o: (-words[o], o.encode()), default=None)
        forms[w] = top if top and words[top] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, close[w], words[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def variants(rng, docs):
    """Texts over a few words, their edits and edits of those, with counts from 2 to thousands."""
    letters = "abcdeàéÿÑ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(25)] + ["aaaaaaaa", "abababab"]

    def edit(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
    rare = [edit(w) for w in base for _ in range(2)]
    rarer = [edit(w) for w in rare for _ in range(2)]
    rows = []
    for i in range(docs):
        words = rng.choices(base, k=300) + rng.choices(rare, k=30) + rng.choices(rarer, k=2)
        rng.shuffle(words)
        rows.append((i, "".join(w.upper() if rng.random() < .2 else w + rng.choice([" ", "1", ", ", "_", "日"]) for w in words)))
    return rows


@pytest.mark.parametrize("seed,round_words,bits", [(1, 1 << 20, 16), (2, 40, 16), (3, 1 << 20, 1)])
def test_forms(llm, seed, round_words, bits):
    """One round, many rounds with cut lengths, and filters so full that all is positive."""
    rows = variants(random.Random(seed), 250) + [(None, "Wörterbuch wörterbuch Wörterbucher wörterbucher"), (5, None), (6, ""), (6, "abcdefgh abcdefgh")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute(rows)
    assert any(r[1] for r in expected) and any(r[1] and r[2] != r[1] for r in expected)
    assert got(spelling.variant_forms(df, damage=31, bits=bits, round_words=round_words)) == expected


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(spelling.variant_forms(odd_docs, damage=31)) == brute(odd_rows)
    assert got(spelling.variant_forms(no_docs)) == []


def test_very_long_words(llm):
    """A word of 3,000 letters and its edits, in texts of their own."""
    rng = random.Random(8)
    w = "".join(rng.choice("abcdé") for _ in range(3000))
    rows = [(i, " ".join([w] * 20)) for i in range(2)] + [(10, f"{w[:1500]}{w[1501:]} " * 2), (11, f"{w[:-1]}z {w[:-1]}z"), (12, f"x{w} x{w}")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert got(spelling.variant_forms(df)) == brute(rows, 0)


def test_hashes_of_edits_are_hashes_of_words():
    words = ["aabbcéz", "zzzzzzz", "abcdefg"]
    letters = np.array(sorted({ord(c) for w in words for c in w} | {ord("ÿ")}), dtype=np.uint8)
    for hashes, word, place, letter in spelling.edits(spelling._points(pa.array(words), 7), letters):
        for h, k, c in zip(hashes.tolist(), word.tolist(), letter.tolist()):
            made = words[k][:place] + (chr(c) if c else "") + words[k][place + 1:]
            assert spelling.word_hash(pa.array([made]))[0] == np.uint64(h)


def test_rounds_are_bounded_and_cover_all():
    sizes = {7: 100, 8: 1000, 9: 10}
    rounds = spelling._rounds(sizes, 300)
    assert all(sum(n for _, _, n in r.values()) <= 300 for r in rounds)
    assert sorted((s, i, k) for r in rounds for s, (i, k, _) in r.items()) == [(7, 0, 1)] + [(8, i, 4) for i in range(4)] + [(9, 0, 1)]
