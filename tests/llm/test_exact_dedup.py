"""Operator 13 against a dictionary of whole normalised texts."""

import collections
import hashlib
import random

import pytest

from washbay.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = -(1 << 63)


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(LOW if i is None else i)
    out = []
    for i, t in rows:
        k = (t or "").translate(LOWER)
        keep = max(groups[k])
        out.append((i, None if keep == LOW else keep, len(groups[k]), (LOW if i is None else i) == keep,
                    hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(exact_dedup.exact_groups(odd_docs)) == brute(odd_rows)
    empty = exact_dedup.exact_groups(no_docs)
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0


@pytest.mark.parametrize("first,growth,most", [(1, 1, 1), (2, 2, 5), (64, 16, 1 << 22)])
def test_every_level_splits(llm, first, growth, most):
    """Texts that part at, before and after every border of the digits, and end on one."""
    rng = random.Random(first)
    base = "".join(rng.choice("aB é") for _ in range(20))
    rows = [(i, base[:rng.randint(0, 20)] + rng.choice(["", "x", "X", "É"])) for i in range(150)] + [(1000, None), (None, ""), (7, base)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(exact_dedup.exact_groups(df, first_digit=first, growth=growth, max_digit=most)) == brute(rows)


def test_hot_group_and_long_shared_start(llm):
    """A third of the rows are copies, a third share 5,000 bytes and then differ."""
    head = "The same long head. " * 250
    rows = [(i, head) for i in range(300)] + [(1000 + i, head + str(i // 2)) for i in range(300)] + [(5000 + i, f"own {i}") for i in range(300)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(exact_dedup.exact_groups(df)) == brute(rows)


def test_drop_copies_keeps_all_columns(odd_docs, odd_rows):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted([(i, t) for (i, t), r in zip(odd_rows, odd_rows) if (i, t) in
                   {(a, b) for a, b in odd_rows if any(x[0] == a and x[3] and x[4] == hashlib.sha256((b or "").translate(LOWER).encode()).hexdigest()
                                                       for x in brute(odd_rows))}], key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want


def test_counting_is_a_partial_aggregate(llm):
    df = llm.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    digits = exact_dedup._first_digits(exact_dedup.doc_rows(df), 64)
    plan = digits.groupBy("part", "digit", "ended").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan
