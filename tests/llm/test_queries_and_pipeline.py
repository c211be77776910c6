"""Registered queries against their SQL, and the pipeline against brute-force stages."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck_connect
from test_text_operators import brute_groups, brute_lines, brute_repeats, key
from test_tokens_and_search import check_packing, library  # noqa: F401

NAMES = sorted(E.LLM_QUERIES)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES


@pytest.mark.parametrize("name", [n for n in NAMES if n != "pipeline"])
def test_query(llm, sf_dir, name):
    r = compare(llm, duck_connect(sf_dir), name, E.queries()[name], E.oracle_sql().get(name), sf_dir)
    assert r["status"] in ("ok", "rows-only") and r["spark_rows"] > 0, r


def test_pipeline(llm, sf_dir, library):  # noqa: F811
    import corpus_pipeline as P
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(llm, docs, sf_dir).cache()
        assert docs.columns == P.COLUMNS
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name == "quality rules"
        seen[name] = (before, after)
    before, after = seen["quality rules"]
    assert set(after) <= set(before) and 0 < len(after) < len(before)
    before, after = seen["line dedup"]
    assert sorted(after) == sorted((i, t) for i, t, _, _ in brute_lines(before))
    before, after = seen["ngram jaccard join"]
    firsts = {c for _, _, c in brute_groups(before, 5, 8, 10)}
    assert sorted(after) == sorted(r for r in before if r[0] in firsts)
    before, after = seen["suffix array dedup"]
    lost = {i: n for i, _, n, _, _ in brute_repeats(before)}
    assert sorted((i, len(t.encode())) for i, t in after if not lost[i]) == sorted((i, len(t.encode())) for i, t in before if not lost[i])
    assert all(0 <= len(t.encode()) + lost[i] - len(dict(before)[i].encode()) + 3 * 100 for i, t in after)
    pieces = P.STAGES[-1][1](llm, docs, sf_dir).collect()
    assert check_packing(after, pieces, library, 2048) > 0
    whole = P.run(llm, sf_dir).collect()
    assert sorted((p.doc_id, p.piece, p.ids_crc32) for p in whole) == sorted((p.doc_id, p.piece, p.ids_crc32) for p in pieces)


def test_pipeline_odd_rows(llm, odd_docs, no_docs, sf_dir):
    import corpus_pipeline as P
    for docs in (odd_docs, no_docs):
        n = docs.count()
        for _, stage in P.STAGES[:-1]:
            out = stage(llm, docs, sf_dir)
            assert out.columns == P.COLUMNS and out.count() <= n
        assert (P.STAGES[-1][1](llm, docs, sf_dir).count() > 0) == (n > 0)
