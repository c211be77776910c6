"""Tokenisation, token files, packing and code search against the library and brute force."""

import random
import zlib

import numpy as np
import pytest

from washbay.llm import bpe, hamming, packing, token_files
from washbay.llm.common import staged_path
from washbay.llm.registry import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def odd_texts():
    rng = random.Random(8)
    pools = ["abcdefghij'  \n\t.,!0123", "éÀÉñß漢字ΣςİıΩ ½٣Ⅷ’“ a's", "\x1c\x1d\x85\xa0 ​́e̊ a", "<|endoftext|> startof", "😀👩‍👧 xyz"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in pools for _ in range(80)]
    return texts + ["", "I'LL they've don't 's", "<|startoftext|>hello<|endoftext|> <|endoftext|>x", "ﬁ ǅ ẞ", "a" * 3000, "the " * 2000]


def test_bpe_equals_the_library(library):
    encode, decode = library
    own = bpe.Bpe(PATH)
    for text in odd_texts():
        ids = encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == decode(ids)
        runs = bpe.runs_of(text)
        if runs is not None:
            assert [i for r in runs for i in own.encode(r)] == ids


def test_bpe_skips_stale_entries():
    own = bpe.Bpe(PATH)
    assert own.encode_piece("aaaaaaa") and own.encode_piece("") == []


def test_bpe_rejects_other_settings(tmp_path):
    import json
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["end_of_word_suffix"] = None
    other = tmp_path / "t.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(other))


def test_bpe_documents(llm, odd_docs, odd_rows, no_docs, library):
    import hashlib
    encode, decode = library
    got = sorted((tuple(r) for r in bpe.round_trip_digests(odd_docs, PATH).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in odd_rows:
        ids = encode(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(decode(ids))))
    assert got == sorted(want, key=repr)
    small = llm.createDataFrame([(1, "Hello there"), (2, None)], "doc_id bigint, text string")
    back = bpe.decode_documents(bpe.encode_documents(small, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "hello</w> there</w>", 2: ""}
    assert bpe.round_trip_digests(no_docs, PATH).count() == 0 and bpe.encode_documents(no_docs, PATH).count() == 0


def test_packed_ids_equal_the_library(library):
    from washbay.llm.token_ids import token_ids
    for text in odd_texts():
        assert np.frombuffer(token_ids(PATH).packed(text), "<u4").tolist() == library[0](text), repr(text)


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(llm, odd_docs, odd_rows, no_docs, library):
    path = staged_path(llm, "token-files")
    token_files.write_token_files(odd_docs, path, PATH, end_id=1)
    want, at = {}, 0
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:                                      # rows of one id are equal here
        ids = library[0](t) + [1]
        want.setdefault(i, []).append((at, len(ids), digest(ids)))
        at += len(ids)
    got = {}
    for r in token_files.token_positions(llm, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == want
    some = token_files.read_token_files(llm, path, ["doc_id", "n_tokens"], first_id=3, last_id=10)
    assert sorted(r.doc_id for r in some.collect()) == sorted(i for i, _ in odd_rows if i is not None and 3 <= i <= 10)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1]
    empty = staged_path(llm, "token-files")
    token_files.write_token_files(no_docs, empty, PATH)
    assert token_files.token_positions(llm, empty).count() == 0


def test_token_positions_of_repeated_ids(llm):
    """More rows of one id than an Arrow batch holds: starts are gapless from 0 in file order."""
    rows = [(None, "one two three " * i) for i in range(10)] + [(5, "four")] * 7 + [(9, None)]
    path = staged_path(llm, "token-files")
    given = llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        token_files.write_token_files(llm.createDataFrame(rows, "doc_id bigint, text string"), path, PATH)
        got = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id) for r in token_files.token_positions(llm, path).collect())
    finally:
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n
    assert [g[3] for g in got] == [None] * 10 + [5] * 7 + [9]


def check_packing(rows, pieces, library, capacity):
    bins, parts = {}, {}
    for p in pieces:
        assert 1 <= p.length <= capacity
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault(p.doc_id, []).append((p.piece, p.start, p.length, p.ids_crc32))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    want = {}
    for i, t in rows:
        ids = library[0](t) + [0]
        want.setdefault(i, []).extend((k, a, len(ids[a:a + capacity]), digest(ids[a:a + capacity])) for k, a in enumerate(range(0, len(ids), capacity)))
    assert {i: sorted(v) for i, v in parts.items()} == {i: sorted(v) for i, v in want.items()}
    return len(bins)


def test_packing(odd_docs, odd_rows, no_docs, library):
    pieces = packing.pack_documents(odd_docs, PATH, capacity=2048).collect()
    n = check_packing(odd_rows, pieces, library, 2048)
    total = sum(p.length for p in pieces)
    assert n <= -(-total // 2048) + 2
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_local_search_improves_a_bad_packing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 600)
    bins = np.arange(600)                                     # one piece a bin
    fill = lambda b: np.bincount(b, weights=sizes)
    better = packing.local_search(sizes, bins.copy(), 2048, sweeps=60)
    assert fill(better).max() <= 2048
    assert (fill(better) ** 2).sum() > (fill(bins) ** 2).sum()
    best = packing.local_search(sizes, packing.best_fit(sizes, 2048), 2048)
    assert len(set(best)) <= -(-sizes.sum() // 2048) + 1
    assert packing.best_fit(np.zeros(0, dtype=np.int64), 10).size == 0


def test_local_search_swaps_empty_a_bin():
    # best fit leaves three bins (6+3, 5+4, 2); one for one and a move need two
    sizes = np.array([6, 3, 5, 4, 2])
    out = packing.local_search(sizes, np.array([0, 0, 1, 1, 2]), 10)
    assert len(set(out)) == 2 and np.bincount(out, weights=sizes).max() <= 10


def improving_exchange(sizes, bins, capacity):
    """Some (giver, given, taken) that raises the sum of squared fills, by trying them all; or None."""
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
    for a in open_bins:
        own = sizes[bins == a]
        gives = {int(x) for x in own} | {int(x + z) for i, x in enumerate(own) for z in own[i + 1:]}
        others = np.isin(bins, open_bins) & (bins != a)
        rest = open_bins[open_bins != a]
        back, to = np.append(sizes[others], np.zeros(len(rest), np.int64)), np.append(fill[bins[others]], fill[rest])
        for g in gives:
            gain = g - back
            better = (gain > 0) & (gain <= capacity - to) & (to - fill[a] + gain > 0)
            if better.any():
                return int(a), g, int(back[better][0])
    return None


@pytest.mark.parametrize("low,high,n", [(600, 1100, 3600), (1, 1500, 2000), (300, 800, 1500)])
def test_local_search_ends_only_where_no_exchange_helps(low, high, n):
    sizes = np.random.default_rng(n).integers(low, high, n)   # best fit leaves many bins open
    start = packing.best_fit(sizes, 2048)
    out = packing.local_search(sizes, start.copy(), 2048)     # as the query calls it
    assert np.bincount(out, weights=sizes).max() <= 2048
    assert len(set(out)) <= len(set(start))
    assert improving_exchange(sizes, out, 2048) is None


@pytest.mark.parametrize("dims,n", [(64, 400), (20, 150), (130, 120)])
def test_top_k(llm, dims, n):
    rng = np.random.default_rng(dims)
    centre = rng.normal(size=(6, dims))
    v = [(i * 13 % n, (centre[i % 6] + 0.7 * rng.normal(size=dims)).tolist()) for i in range(n)]
    v += [(1000 + i, v[0][1]) for i in range(30)] + [v[3], (2000, None), (2001, []), (None, v[1][1]), (2002, [float("nan"), None, 1.0])]
    df = llm.createDataFrame(v, "vec_id bigint, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 10 = 0")
    codes = {}
    for i, x in v:
        if i is not None and x:
            bits = [c is not None and c > 0 for c in x] + [False] * (dims - len(x))
            codes[i] = bits
    want = []
    for q in [i for i in codes if i % 10 == 0]:
        near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:10]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in hamming.top_k(df, queries, k=10).collect()) == sorted(want)


def test_top_k_clashing_columns(llm):
    clash = ["id", "code", "q", "c", "seg", "value", "n", "ids", "distance", "rank", "query_id", "neighbor_id", "asked"]
    rows = [(i, [1.0 if i >> b & 1 else -1.0 for b in range(8)], *clash) for i in range(40)]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>, " + ", ".join(f"{c} string" for c in clash))
    want = []
    for q in (0, 10, 20, 30):
        near = sorted((bin(q ^ i).count("1"), i) for i in range(40) if i != q)[:3]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in hamming.top_k(df, df.where("vec_id % 10 = 0"), k=3).collect()) == want


def test_top_k_small_tables(llm):
    df = llm.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in hamming.top_k(df, df.where("vec_id = 0"), k=5).collect()] == [(0, 1, 1, 1)]
    none = df.limit(0)
    assert hamming.top_k(none, none).collect() == []
    assert hamming.top_k(df, none).collect() == []
