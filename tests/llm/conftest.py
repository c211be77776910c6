import random

import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from washbay.llm.common import ship_package
    ship_package(spark)
    return spark


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = " ".join(word(rng) for _ in range(200))
    long = "\n".join(" ".join(word(rng) for _ in range(12)) for _ in range(30_000))
    assert len(long) > 1_500_000
    line = "The same boilerplate line that many of the documents hold."
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n "), (None, base), (7, long), (8, long[5:]),
            (9, "naïve café 日本語 \U0001f600 " + base[:300]), (10, "one two"), (11, "one two"), (3, base + " tail"), (12, "a" * 500),
            (-13, base[40:900]), (14, "x\n\ny\n"), (15, base.upper())]
    return rows + [(20 + i, f"{line}\n{word(rng)} {word(rng)}\n  {line.upper()}  ") for i in range(7)]


@pytest.fixture(scope="session")
def odd_docs(llm, odd_rows):
    """The odd rows with columns whose names clash with those of the operators."""
    clash = ["row", "hits", "node", "n", "kept", "kept_text", "n_words", "score", "ids", "length", "file", "stratum", "given", "h", "z", "bins"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clash)
    rows = [(i, t, None if k % 5 == 0 else "en", "s", None) + tuple(clash) for k, (i, t) in enumerate(odd_rows)]
    return llm.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
