"""Quality rules with risk-controlled thresholds (operator 3).

Every text gets a few surface measures (shares of symbols, repeated lines, repeated words,
capitals, ...). Labelled documents are split by crc32 of their id into two folds. Per
stratum (language), fold 0 ranks a measure's value by the share of good documents that are
at least as extreme; a document's ``score`` is the smallest rank over the useful rules, so
"reject when score <= cut" is one family of nested rules. Fold 1, the holdout, tests the
cuts from mild to strict with the exact binomial tail: a cut passes when
P(Bin(n, max_false_rejection) <= k) <= error / strata for its k rejections among n good
holdout documents, and testing stops at the first that fails (fixed-sequence testing, so
no further correction over the cuts; Bonferroni over the strata). Among the passed cuts the
one with the best ``rejected bad - weight * rejected good`` is used. A stratum without
enough labels passes no cut and loses nothing beyond the base rules.

Nulls: a NULL text is empty (0 words, so it fails the base rules), a NULL stratum is a
stratum of its own, labels with a NULL id or quality are ignored, repeated label rows
count once per (id, quality). Without labels every document that passes the base is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.llm.common import (NULL_ID, Texts, Words, byte_codes, doc_rows, given_id, mix, passes, row_sums,
                                shingles, span_hash, staged)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout",
          "n_digits"]
#: rule -> (bin expression over the counts, True when large values are bad); 256 bins each
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1) * 128", True),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1) * 256", True),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1) * 256", True),
    "long_words": ("word_chars / greatest(n_words, 1) * 8", True),
    "short_words": ("word_chars / greatest(n_words, 1) * 8", False),
    "capitals": ("n_upper / greatest(word_chars, 1) * 256", True),
    "shouting": ("n_shout / greatest(n_words, 1) * 128", True),
    "digits": ("n_digits / greatest(word_chars, 1) * 256", True),
    "few_words": ("16 * log2(n_words + 1)", False),
}
BINS = 256
#: cuts from mild to strict, as shares of the good documents of fold 0
CUTS = [0.0] + [round(0.0005 * 1.5 ** i, 6) for i in range(12)]


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _SHOUT, _DIGIT = _members(b"#*$%&|<>"), _members(b"!?"), _members(b"0123456789")
_UPPER = _members(bytes(range(65, 91)))
_CODE_POINT = ~_members(bytes(range(0x80, 0xC0)))


def text_counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every text, in whole-batch numpy passes."""
    n, raw = t.size, t.buf[:t.size]
    w = Words(t, lower=False)
    out = {"n_words": w.count(), "word_chars": row_sums(w.is_word & _CODE_POINT[raw], t.off)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_shout", _SHOUT), ("n_digits", _DIGIT)):
        out[name] = row_sums(table[raw], t.off)
    # lines with a word that equal an earlier line of the text
    nl = np.flatnonzero(raw == 10)
    row = np.concatenate([np.arange(t.n), np.searchsorted(t.off, nl, side="right") - 1])
    start = np.concatenate([t.off[:-1], nl + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.append(start[1:] - 1, n)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end[last] = t.off[row[last] + 1]
    out["n_lines"] = np.bincount(row, minlength=t.n)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    row, start, end = row[has_word], start[has_word], end[has_word]
    key = _row_key(span_hash(byte_codes(t), start, end), row)
    distinct = np.bincount(_rows_of_first(key, row), minlength=t.n)
    out["n_dup_lines"] = np.bincount(row, minlength=t.n) - distinct
    # words inside 3-word windows that the text holds at least twice
    h, row, at = shingles(w, 3)
    full = w.count()[row] >= 3
    h, row, at = h[full], row[full], at[full]
    _, back, times = np.unique(_row_key(h, row), return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    covered = np.zeros(len(w.start), dtype=bool)
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = row_sums(covered, w.first)
    return out


def _row_key(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _rows_of_first(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    return row[np.unique(key, return_index=True)[1]]


def quality_counts(docs: DataFrame, stratum: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the counts and ``base_failed`` per document (and the columns of
    ``carry`` as they are, under ``given``). One scan, no shuffle."""
    rows = doc_rows(docs, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                    *([F.struct(*carry).alias("given")] if carry else []))
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
                       + [f"{c} bigint" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in passes(batches):
            counts = text_counts(t)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in names]
                + [pa.array(counts[c].astype(np.int64)) for c in COUNTS], names=names + COUNTS)

    return rows.mapInArrow(run, schema).withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _bins():
    """One 0..255 bin per rule; larger is always more suspect."""
    exprs = []
    for text, high in RULES.values():
        b = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.expr(text)).cast("int")))
        exprs.append(b if high else F.lit(BINS - 1) - b)
    return F.array(*exprs)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly through the incomplete beta function."""
    if k >= n:
        return 1.0
    if n == 0:
        return 1.0
    return _beta_part(n - k, k + 1, 1.0 - p)


def _beta_part(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        value *= c * d
        if i and abs(c * d - 1.0) < 1e-14:
            break
    return front * (value - 1.0)


def fit_rules(counts: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, error: float = 0.05,
              weight: float = 20.0) -> DataFrame:
    """Per stratum: ``ranks`` (per rule and bin the share of good documents at least as
    extreme; 1.0 throughout for a rule that separates nothing), the chosen ``cut`` (NULL:
    none passed), and what the holdout showed. All labelled documents count; only sums per
    (stratum, rule, bin) leave the executors' map side."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id IS NOT NULL AND quality IS NOT NULL").distinct())
    seen = (counts.where(~F.col("base_failed")).select("doc_id", "stratum", _bins().alias("bins"))
            .join(known, "doc_id")
            .withColumn("holdout", F.expr("crc32(cast(doc_id AS string)) % 2 = 1")))
    tune = (seen.where(~F.col("holdout")).select("stratum", "quality", F.posexplode("bins").alias("rule", "bin"))
            .groupBy("stratum", "rule", "bin", "quality").count())
    n_rules = len(RULES)

    def ranks(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((n_rules, BINS)), np.zeros((n_rules, BINS))
        for part, side in ((good, pdf[pdf.quality == 1]), (bad, pdf[pdf.quality != 1])):
            np.add.at(part, (side.rule.to_numpy(), side.bin.to_numpy()), side["count"].to_numpy())
        out = []
        for g, b in zip(good, bad):
            beyond_g, beyond_b = g[::-1].cumsum()[::-1], b[::-1].cumsum()[::-1]
            rank = beyond_g / max(g.sum(), 1.0)
            at = rank <= 0.01                            # what the mildest percent of the good would reject
            useful = g.sum() > 0 and b.sum() > 0 and (beyond_b[at].max() if at.any() else 0.0) >= 0.02 * b.sum()
            out.append((rank if useful else np.ones(BINS)).tolist())
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "ranks": [out]})

    fitted = staged(tune.groupBy("stratum").applyInPandas(ranks, "stratum string, ranks array<array<double>>"),
                    "quality-ranks")
    holdout = (_with_score(seen.where("holdout"), fitted)
               .withColumn("level", F.expr("size(filter(" + _array(CUTS) + ", c -> score > c))"))
               .groupBy("stratum", "level", "quality").count())
    limit = error / max(1, fitted.count())                   # Bonferroni over the strata

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(len(CUTS) + 1), np.zeros(len(CUTS) + 1)
        for part, side in ((good, pdf[pdf.quality == 1]), (bad, pdf[pdf.quality != 1])):
            np.add.at(part, side.level.to_numpy(), side["count"].to_numpy())
        n, best = int(good.sum()), None
        for i, cut in enumerate(CUTS):
            k, caught = int(good[:i + 1].sum()), int(bad[:i + 1].sum())
            p = binomial_tail(k, n, max_false_rejection)
            if n == 0 or p > limit:
                break
            gain = caught - weight * k
            if gain > (best[0] if best else 0):               # a cut that costs more than it catches is none
                best = (gain, cut, k, caught, p)
        gain, cut, k, caught, p = best or (0, None, 0, 0, None)
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "cut": [cut], "n_good": [n], "k_good": [k],
                             "n_bad": [int(bad.sum())], "k_bad": [caught], "p_value": [p]}).astype(
                                 {"cut": "float64", "p_value": "float64"})

    chosen = holdout.groupBy("stratum").applyInPandas(
        choose, "stratum string, cut double, n_good bigint, k_good bigint, n_bad bigint, k_bad bigint, p_value double")
    return staged(fitted.join(chosen, "stratum", "left"), "quality-rules")


def _array(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v}D" for v in values) + ")"


def _with_score(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``score``: the smallest rank over the rules (1.0 in a stratum without labels)."""
    rank = "transform(sequence(0, %d), i -> ranks[i][bins[i]])" % (len(RULES) - 1)
    joined = rows.join(fitted, "stratum", "left")
    return joined.withColumn("score", F.coalesce(F.expr(f"array_min({rank})"), F.lit(1.0))).drop("ranks")


def apply_rules(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """``kept``: passes the base rules and is not rejected at its stratum's cut."""
    scored = _with_score(counts.withColumn("bins", _bins()), rules.select("stratum", "ranks", "cut"))
    return scored.withColumn("kept", F.expr("NOT base_failed AND coalesce(score > cut, true)")).drop("bins")


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, base verdict and ``kept`` for every document."""
    counts = staged(quality_counts(docs, stratum), "quality-counts")
    rules = fit_rules(counts, labels)
    return apply_rules(counts, rules).withColumn("doc_id", given_id())


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    counts = staged(quality_counts(docs, stratum), "quality-counts")
    rules = fit_rules(counts, labels)
    judged = apply_rules(quality_counts(docs, stratum, carry=tuple(docs.columns)), rules)
    return judged.where("kept").select("given.*")
