"""Operators over texts against brute force, on small odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from washbay.llm import licenses, line_dedup, maxent_lm, ngram_join, quality, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = -(1 << 63)


def same(df, expected):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def key(i):
    return LOW if i is None else i


# --- operator 2 ----------------------------------------------------------------------

def brute_groups(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    by_id = {}
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                up[find(a)] = find(b)
    for a, (i, _) in enumerate(rows):
        by_id.setdefault(find(a), []).append(key(i))
    back = lambda v: None if v == LOW else v
    return [(i, len(sets[a]), back(min(by_id[find(a)])) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def near_copies(n, seed, words=90):
    rng = random.Random(seed)
    lex = ["w%d" % i for i in range(60)]
    base = [rng.choice(lex) for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(lex)
        if rng.random() < .3:
            w = w[:rng.randint(60, words)]
        if rng.random() < .2:
            w = [rng.choice(lex) for _ in range(rng.randint(1, 40))]
        rows.append((i * 37 % n, " ".join(w)))
    return rows


@pytest.mark.parametrize("size,num,den,block", [(3, 9, 10, 1024), (3, 9, 10, 16), (5, 8, 10, 40)])
def test_ngram_groups(llm, size, num, den, block):
    rows = near_copies(150, size)
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    same(ngram_join.jaccard_groups(df, size, num, den, block=block), brute_groups(rows, size, num, den))


def test_ngram_hot_shingle(llm):
    """One rare shingle in all texts: near copies in one group and texts that share nothing else,
    far more of both than a block holds."""
    rng = random.Random(11)
    base = [f"base{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(5, 120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:5] + [f"w{i}x{k}" for k in range(8)])) for i in range(150)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, 5, 8, 10, block=16).collect()}
    want = {i: c for i, _, c in brute_groups(rows, 5, 8, 10)}
    assert got == want and len(set(want.values())) == 151


@pytest.mark.parametrize("at_once", [1, 2, 3, 7, 10_000])
def test_ngram_blocks_of_a_stream(llm, at_once):
    """Nodes are numbered right wherever batches end; copies of a node and lone nodes go."""
    rng = random.Random(at_once)
    rows = [(g, v, 5, 1) for g in range(40) for v in range(rng.choice([1, 1, 2, 9])) for _ in range(rng.choice([1, 1, 3]))]
    rng.shuffle(rows)
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_once))
    try:
        got = ngram_join._met(llm.createDataFrame(rows, "gram bigint, node bigint, n bigint, pos int"), 4).collect()
    finally:
        llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes = collections.defaultdict(set)
    for g, v, *_ in rows:
        nodes[g].add(v)
    assert sorted((r.gram, r.node, r.own) for r in got) == sorted((g, v, v // 4) for g, vs in nodes.items() if len(vs) > 1 for v in vs)


def test_ngram_odd_rows(odd_docs, odd_rows, no_docs):
    small = [r for r in odd_rows if len(r[1] or "") < 10_000]
    got = [tuple(r) for r in ngram_join.jaccard_groups(odd_docs, 5, 8, 10).collect() if r[0] not in (7, 8)]
    assert sorted(got, key=repr) == sorted(brute_groups(small, 5, 8, 10), key=repr)
    assert ngram_join.jaccard_groups(no_docs, 5, 8, 10).count() == 0


def test_one_document_of_each_group_stays(odd_docs, odd_rows):
    kept = ngram_join.one_per_group(odd_docs, 5, 8, 10)
    assert kept.columns == odd_docs.columns
    groups = {i: c for i, _, c in brute_groups([r for r in odd_rows if r[0] not in (7, 8)], 5, 8, 10)}
    ids = [r.doc_id for r in kept.collect() if r.doc_id not in (7, 8)]
    assert sorted(set(map(key, ids))) == sorted({key(c) for c in groups.values()})


# --- operator 3 ----------------------------------------------------------------------

def brute_counts(text):
    w = WORDS.findall(text or "")
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(odd_docs, odd_rows, no_docs):
    df = quality.quality_counts(odd_docs)
    expected = []
    for i, t in odd_rows:
        n, chars, symbols, dup, rep = brute_counts(t)
        expected.append((key(i), n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n))
    same(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), expected)
    assert quality.quality_counts(no_docs).count() == 0


@pytest.mark.parametrize("n,p", [(1, .5), (40, .05), (300, .02), (2000, .3)])
def test_binomial_tail_is_exact(n, p):
    for k in {0, 1, n // 20, n // 2, n - 1, n}:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
                   for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(min(1.0, want), rel=1e-9, abs=1e-12)


def labelled(llm, n_good, n_bad):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n_good + n_bad):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        if i >= n_good:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None))
        labels.append((i, int(i < n_good), 0))
    return (llm.createDataFrame(rows, "doc_id bigint, text string, lang string"),
            llm.createDataFrame(labels + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int"))


def test_quality_verdict_catches_bad_and_keeps_good(llm, no_docs):
    docs, labels = labelled(llm, 900, 120)
    judged = quality.quality_filter(docs, labels).collect()
    assert len(judged) == 1020
    lost = [r.doc_id for r in judged if not r.kept]
    assert sum(i >= 900 for i in lost) == 120                 # every bad one
    strata = collections.defaultdict(list)
    for r in judged:
        if r.doc_id < 900:
            strata[r.stratum].append(r.kept)
    for kept in strata.values():                              # false rejections: what the method promises per stratum
        assert kept.count(False) <= 0.05 * len(kept)
    assert len(strata) == 2
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == set(range(1020)) - set(lost)
    # without labels (or without enough of them) only the base rules decide
    none = quality.quality_filter(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert quality.quality_filter(no_docs, labels).count() == 0


def test_quality_cut_that_hurts_is_not_chosen(llm):
    """Labels say nothing about the text: every cut rejects as many good as bad ones, at a loss."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)), "en") for i in range(1500)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = llm.createDataFrame([(i, int(rng.random() < .97), 0) for i in range(1500)], "doc_id bigint, quality int, toxic int")
    for r in quality.fit_rules(quality.quality_counts(docs), labels).collect():
        assert r.cut is None or r.k_bad > 20 * r.k_good       # the default weight of a good document


def test_quality_cut_needs_evidence(llm):
    docs, labels = labelled(llm, 60, 10)
    rules = {r.stratum: r for r in quality.fit_rules(quality.quality_counts(docs), labels, max_false_rejection=0.01).collect()}
    assert all(r.cut is None for r in rules.values())        # (1 - 0.01) ** 60 > 0.05


# --- operator 4 ----------------------------------------------------------------------

def brute_repeats(rows, m=50):
    seen, out = {}, []
    for i, x in rows:
        b = (x or "").encode()
        for j in range(len(b) - m + 1):
            s = b[j:j + m]
            seen[s] = min(seen.get(s, key(i)), key(i))
    for i, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b) + 1)
        for j in range(len(b) - m + 1):
            if seen[b[j:j + m]] < key(i):
                gone[j:j + m] = b"\1" * m
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"task_hot": 2, "hot": 2}, {"task_hot": 3, "hot": 1000}])
def test_repeats(llm, options):
    rng = random.Random(len(options))
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice("xyz ") for _ in range(rng.choice([0, 5, 30, 80])))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 380)
            t += rng.choice(base)[a:a + rng.randint(20, 200)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 20)))
        rows.append((i * 7 % 120, t))
    passage = base[0][:60]                                    # one passage between ever other neighbours
    rows += [(200 + i, f"{i * 7919} {passage} {i * 104729}") for i in range(60)]
    rows += [(500, None), (None, base[0]), (501, base[0]), (503, ""), (504, "a" * 300), (505, "b" * 20 + "a" * 120),
             (506, "ab" * 100), (507, "ba" * 60), (501, base[0]), (-5, base[1][:200])]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    same(suffix_dedup.kept_digests(df, **options), brute_repeats(rows))


def test_repeats_odd_rows(odd_docs, odd_rows, no_docs):
    same(suffix_dedup.kept_digests(odd_docs), brute_repeats(odd_rows))
    assert suffix_dedup.kept_digests(no_docs).count() == 0


# --- operator 5 ----------------------------------------------------------------------

def check_lm(df, rows):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append(r)
    tokens = [WORDS.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for t, o in zip(tokens, out) if not o for w in t)
    total, distinct = sum(c.values()), len(c)
    for (i, _), t, o in zip(rows, tokens, out):
        r = got[i].pop()
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        if len(got[i]) == 0 and [j for j, _ in rows].count(i) == 1:
            assert r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.held_out == o
            assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.train_tokens == total and r.score < 0
    assert not any(got.values())
    return out


def test_lm(llm, sf_dir, monkeypatch):
    monkeypatch.setattr(maxent_lm, "KNOWN", 1500)             # so that rarer words take the join
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = maxent_lm.score_documents(docs).cache()
    check_lm(df, rows)
    held = [r for r in df.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)       # better on texts it has not seen


def test_lm_learns_order(llm):
    rng = random.Random(1)
    text = lambda: " ".join(f"a{k} b{k}" for k in (rng.randrange(20) for _ in range(100)))
    rows = [(i, text()) for i in range(120)]
    df = maxent_lm.score_documents(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = [r for r in df if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)   # the second word follows from the first


def test_lm_learns_order_of_rare_words(llm):
    rng = random.Random(3)
    text = lambda: " ".join(f"first{k} second{k}" for k in (rng.randrange(3000) for _ in range(100)))
    rows = [(i, text()) for i in range(300)]                  # 6,000 words, most of them without a slot of their own
    df = maxent_lm.score_documents(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = [r for r in df if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def lm_counts(rows, out):
    """Training words, and n-grams of each kind by context."""
    words, grams = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(3)]
    for (_, text), held in zip(rows, out):
        w = [None, None, *WORDS.findall((text or "").translate(LOWER)), ""]
        for i in range(2, len(w)):
            if not held:
                words[w[i]] += 1
                for kind, context in enumerate((w[i - 2], w[i - 1], (w[i - 2], w[i - 1]))):
                    grams[kind][context][w[i]] += 1
    return words, grams


@pytest.mark.parametrize("options", [{}, {"KNOWN": 800, "BLOCK_BYTES": 3000, "PART_KEYS": 500, "HOT": 60, "HOT_BLOCK": 2}])
def test_lm_counts_reach_every_token(llm, monkeypatch, options):
    """Scores of an untrained slot model are its probabilities refined by the exact counts, however
    blocks and groups are cut, and where hot contexts are spread; shuffle files go with each round."""
    import glob
    import numpy as np
    for name, value in options.items():
        monkeypatch.setattr(maxent_lm, name, value)
    rng = random.Random(8)
    vocabulary = [f"{'the' if k < 3 else 'w'}{k}" for k in range(2000)]
    rows = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.02 if rng.random() < .7 else 0.001)), 1999)] for _ in range(rng.randrange(90))))
            for i in range(150)] + [(200, None), (201, "the0"), (None, "the1 the0"), (3, "the1 the0 new")]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    given = llm.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    files = lambda: set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))
    local = llm.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0].rsplit("/blockmgr-", 1)[0]
    before = files()
    df = maxent_lm.score_documents(docs, rounds=0)
    left = files() - before
    assert not left and llm.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == given
    out = check_lm(df, rows)
    words, grams = lm_counts(rows, out)
    model = maxent_lm.Model(maxent_lm.Vocabulary(maxent_lm._word_counts(
        maxent_lm.doc_rows(docs).where(~maxent_lm.held_out(docs.doc_id)))))
    got = collections.defaultdict(list)
    for x in df.collect():
        got[x.doc_id].append(x.score)
    for i, text in rows:
        t = maxent_lm.Tokens(maxent_lm.Texts(np.frombuffer((text or "").encode() + bytes(64), np.uint8), np.array([0, len(text or "")])))
        slot = model.v.slots(t.hash)
        w = [None, None, *WORDS.findall((text or "").translate(LOWER)), ""]
        want = 0.0
        for k, (s, room) in enumerate(zip(model.score(slot, t.first), model.v.log_room[slot])):
            p = 10 ** (s - room) * (words[w[k + 2]] + 1 if slot[k] >= maxent_lm.OWN else 1)
            for kind, context in enumerate((w[k], w[k + 1], (w[k], w[k + 1]))):
                seen = grams[kind].get(context, {})
                if seen:
                    p = (seen.get(w[k + 2], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
            want += math.log10(p)
        assert min(abs(x / want - 1) for x in got[i]) < 1e-6


def test_lm_holds_little_of_a_block(llm, monkeypatch, tmp_path):
    """Scoring a block, and counting a group, take few bytes a token (two workers share an executor)."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", 2 << 20)
    monkeypatch.setattr(maxent_lm, "PART_KEYS", 1 << 20)
    folder = str(tmp_path)

    def peak(name, fn, *tables):
        import tracemalloc
        import uuid
        tracemalloc.start()
        try:
            out = fn(*tables)
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w") as f:
            f.write(str(most))
        return out

    count, score = PandasGroupedOpsMixin.applyInArrow, PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow",
                        lambda self, fn, schema: count(self, lambda asked: peak("count", fn, asked), schema))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow",
                        lambda self, fn, schema: score(self, lambda texts, found: peak("score", fn, texts, found), schema))
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(20_000)]
    rows = [(3 * i, " ".join(rng.choices(vocabulary, k=1000))) for i in range(700)]     # two or three blocks
    df = maxent_lm.score_documents(llm.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), rounds=0).collect()
    assert len(df) == len(rows) and sum(r.n_tokens for r in df) == 700 * 1001
    most = {name: max(int(p.read_text()) for p in tmp_path.glob(f"{name}-*")) for name in ("count", "score")}
    assert most["score"] < 120 << 20 and most["count"] < 64 << 20              # 400,000 tokens a block


def test_lm_run_sums():
    import numpy as np
    rng = np.random.default_rng(2)
    size = np.concatenate([rng.integers(1, 30, 200), [1, 8, 9, 700]])
    rows, at = rng.normal(size=(size.sum(), 32)).astype(np.float32), np.cumsum(size) - size
    assert np.array_equal(maxent_lm.run_sums(rows, at, size), np.add.reduceat(rows, at, axis=0))


def test_lm_refined_probabilities_sum_to_one():
    import numpy as np
    words, texts = "abcd", ["abacabd", "bad", "", "aabbaacc"]
    codes = {w: np.uint64(1000 + i) for i, w in enumerate(words)}
    after = lambda x: np.array([codes[w] for w in x], np.uint64)
    grams = collections.defaultdict(collections.Counter)
    for x in texts:
        for context, key in maxent_lm.ngram_keys(after(x), np.array([0, len(x)])) if x else []:
            for a, b in zip(context.tolist(), key.tolist()):
                grams[a][b] += 1
    for history in ("", "a", "ba", "ab", "dd"):
        p = np.array([0.4, 0.3, 0.2, 0.1])
        each = [maxent_lm.ngram_keys(after(history + w), np.array([0, len(history) + 1])) for w in words]
        for kind in range(3):
            seen = [grams[int(e[kind][0][-1])] for e in each]
            c = np.array([s[int(e[kind][1][-1])] for s, e in zip(seen, each)])
            p = maxent_lm.nested(p, c, np.array([sum(s.values()) for s in seen]), np.array([len(s) for s in seen]))
        assert p.sum() == pytest.approx(1.0)


def test_lm_probabilities_sum_to_one(llm):
    import numpy as np
    docs = llm.createDataFrame([(1, "a b a c"), (3, "a b")], "doc_id bigint, text string")
    counts = maxent_lm._word_counts(maxent_lm.doc_rows(docs))
    v = maxent_lm.Vocabulary(counts)
    m = maxent_lm.Model(v)
    m.w1 += np.random.default_rng(0).normal(size=m.w1.shape).astype(np.float32)
    slot, first = np.arange(maxent_lm.SLOTS), np.arange(maxent_lm.SLOTS + 1)     # every slot as a first token
    assert (10 ** m.score(slot, first)).sum() == pytest.approx(1.0, abs=1e-3)


def test_lm_odd_rows(odd_docs, odd_rows, no_docs):
    check_lm(maxent_lm.score_documents(odd_docs), odd_rows)
    assert maxent_lm.score_documents(no_docs).count() == 0


# --- operator 9 ----------------------------------------------------------------------

def brute_license(text, templates, threshold):
    norm = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.translate(LOWER).encode())
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    words, found = norm(text or ""), []
    for name, t in templates.items():
        tw = norm(t)
        tg, best = grams(tw), None
        for s in range(max(1, len(words) - len(tw) + 1)):
            g = grams(words[s:s + len(tw)])
            dice = 2 * len(g & tg) / (len(g) + len(tg))
            if dice >= threshold and (best is None or dice > best[0]):
                best = (dice, len(tw), name, s)
        if best:
            found.append(best)
    top = min(found, key=lambda m: (-m[0], -m[1], m[2])) if found else (None,) * 4
    return top[2], top[0], top[3], sorted(m[2] for m in found)


def test_licenses(llm, odd_docs, odd_rows, no_docs):
    t, rng = licenses.TEMPLATES, random.Random(2)
    rows = [(i, x) for i, x in odd_rows if len(x or "") < 10_000]
    for k, (name, body) in enumerate(t.items()):
        w = body.split()
        for j in range(6):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 8))):
                v[rng.randrange(len(v))] = "changed"
            rows.append((100 + 10 * k + j, " ".join(["before"] * rng.randint(0, 9) + v + ["after"] * rng.randint(0, 9)).upper() if j % 2 else "\n".join(v)))
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    same(licenses.scan_licenses(df), [(i, *brute_license(x, t, 0.8)) for i, x in rows])
    assert licenses.scan_licenses(odd_docs).count() == len(odd_rows)
    assert licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, {"x": "word"})


NEAR_RELATIVES = {
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                      "option) any later version.",
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                           "Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                       "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                       "(at your option) any later version.",
    "LGPL-3.0-header": "This file is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                       "(at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                       "(at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                      "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def best_of(found):
    return min(found, key=lambda m: (-m[0], -m[1], m[2]))[2] if found else None


def test_license_relatives_get_their_own_names():
    import pyarrow as pa
    from washbay.llm.common import texts_of
    chosen = licenses.Templates(licenses.TEMPLATES, 0.8)
    names, bodies = list(licenses.TEMPLATES), list(licenses.TEMPLATES.values())
    around = [f"Some words before it.\n{b}\nAnd some words after it." for b in bodies]
    assert [best_of(f) for f in chosen.scan(texts_of(pa.array(around)))] == names
    assert [best_of(f) for f in chosen.scan(texts_of(pa.array(list(NEAR_RELATIVES.values()))))] == list(NEAR_RELATIVES)


# --- operator 10 ---------------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    strip = lambda s: s.strip(" \t\n\v\f\r").translate(LOWER)
    holders = collections.defaultdict(list)
    for r, (i, t) in enumerate(rows):
        for k in {strip(x) for x in (t or "").split("\n")}:
            holders[k].append((key(i), r))
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            k = strip(x)
            if not (len(k) >= min_chars and len({d for d, _ in holders[k]}) >= min_docs and key(i) < max(holders[k])[0]):
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(llm, odd_docs, odd_rows, no_docs):
    rng = random.Random(4)
    pool = [("Ünïcode " if k % 3 == 0 else "line ") + "".join(rng.choice("abc D") for _ in range(rng.randint(30, 45))) for k in range(40)]
    rows = [(i * 11 % 90, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(0, 8))))
            for i in range(90)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    same(line_dedup.dedup_lines(df), brute_lines(rows))
    same(line_dedup.dedup_lines(df, filter_bits=1 << 12), brute_lines(rows))           # a crowded filter changes nothing
    same(line_dedup.dedup_lines(odd_docs), brute_lines(odd_rows))
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_count_documents_not_rows(llm):
    """Four rows of one id and one of another hold a line: two documents, so it stays."""
    line = "x" * 45
    rows = [(1, line)] * 4 + [(2, line)] + [(10 + i, "y" * 45) for i in range(5)] + [(14, "y" * 45)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = line_dedup.dedup_lines(df).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in out) == sorted([(1, 0)] * 4 + [(2, 0)] + [(10 + i, 1) for i in range(4)] + [(14, 0)] * 2)
    same(line_dedup.dedup_lines(df), brute_lines(rows))
