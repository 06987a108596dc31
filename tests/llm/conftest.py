import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is that was for on with as by at from this be are or an it a er ing tion re".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a user's table may have, named like what the operators use inside.
CLASHING = ("k1", "k2", "did", "row", "rest", "stats", "size", "node", "all", "first", "digest", "keep", "group_size", "_words", "_new")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return build


@pytest.fixture
def prose():
    """Random prose of a given number of words."""

    def build(seed, n, per_line=12):
        rng = random.Random(seed)
        words = ["".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)]
        lines = [" ".join(words[i : i + per_line]) for i in range(0, n, per_line)]
        return "\n".join(lines)

    return build


@pytest.fixture
def awkward(prose):
    """Texts that break naive code: null, empty, blank, white space of all kinds, accents, one very long, copies."""
    long = prose(1, 40_000)
    copy = prose(2, 300)
    return [
        (None, "no id here, and the text is of some length so that it is looked at"), (1, None), (2, ""), (3, " \t\n \x0b\x0c\r"), (4, "é" * 300),
        (5, "a\xa0b c  d \n\n\n e\r\nf"), (6, long), (7, copy), (8, copy), (8, copy), (9, copy + " more"), (10, "x"), (11, "\n\nline\n"),
        (12, "a " * 400), (13, "<|endoftext|> and <|endoftext|>"), (14, "TAB\tTab\ttab " * 20), (15, "It's 3 o'clock, isn't it?!  ...\n"),
    ]
