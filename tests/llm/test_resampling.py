"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladespark.llm import resampling
from tests.conftest import rows_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def parsed(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(f) % 10000 for f in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def expected(rows, target, share=25, min_words=20):
    docs = [(r[0], *parsed(r[1])) for r in rows]
    s, t = Counter(f for _, _, fs in docs for f in fs), Counter(f for text in target for f in parsed(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))

    out = []
    for i, n_words, fs in docs:
        weight = sum(gain(f) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    pool = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(pool[: share * len(pool) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(spark, docs, target, **options):
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return rows_of(resampling.draw(resampling.scores(docs, texts), **options), "doc_id", "n_features", "weight", "score", "rank")


def test_awkward_texts(spark, documents, awkward, prose):
    rows = awkward + [(100 + i, prose(i, 5 + i)) for i in range(60)]
    target = [prose(1, 200), None, "", "Benchmark ITEM é"]
    assert found(spark, documents(rows), target) == expected(rows, target)


@pytest.mark.parametrize("share", [0, 1, 50, 100])
def test_shares(spark, documents, prose, share):
    rows = [(i, prose(i % 40, 30)) for i in range(150)]
    assert found(spark, documents(rows), [prose(3, 90)], share=share) == expected(rows, [prose(3, 90)], share)


def test_one_id_in_a_third_of_all_rows(spark, documents, prose):
    """Ties at the cutoff: rows of one id and one text, of one id and other texts, and rows without an id."""
    rows = [(i, prose(i, 25)) for i in range(200)]
    rows += [(7, prose(7, 25))] * 100 + [(9, prose(9, 25 + i % 3)) for i in range(60)] + [(None, prose(9, 25))] * 60
    for share in (10, 25, 60):
        assert found(spark, documents(rows), [prose(3, 90)], share=share) == expected(rows, [prose(3, 90)], share)


def test_ids_at_the_ends_of_a_long(spark, documents, prose):
    rows = [(i, prose(1, 30)) for i in (-(1 << 63), (1 << 63) - 1, 0, -1, 5)] * 4
    assert found(spark, documents(rows), ["x"], share=50) == expected(rows, ["x"], 50)


@pytest.mark.parametrize("need", [1, 2, 17, 400, 999, 1000])
def test_narrowing_finds_the_least_value(spark, need):
    rng = random.Random(need)
    values = sorted(rng.choice([rng.randint(-50, 50), rng.randint(-(1 << 62), 1 << 62)]) for _ in range(1000))
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    value, below = resampling._narrow(rows, "v", values[0], values[-1], need)
    assert value == values[need - 1] and below == sum(v < value for v in values)


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_long_texts_come_in_pieces(limit):
    rng = random.Random(limit)
    for _ in range(80):
        text = "".join(rng.choices(["a", "Zé", "-", " ", "word" * 30, "\n"], k=rng.randint(0, 40)))
        n, fs = 0, []
        for data, bounds, carried in resampling._pieces(pa.array([text], pa.string()), limit):
            words, _, buckets = resampling.features(data, bounds, carried)
            n, fs = n + len(words), fs + buckets.tolist()
        assert (n, sorted(fs)) == (parsed(text)[0], sorted(parsed(text)[1]))


def test_registers_of_words_of_any_length():
    words = [b"", b"a", b"x" * 64, b"y" * 65, b"z" * 5000, b"ab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    got = ~resampling._fold(np.full(len(words), 0xFFFFFFFF, np.uint32), data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_drawn_documents_keep_their_columns(spark, documents, prose):
    rows = [(i, prose(i, 30)) for i in range(40)]
    texts = spark.createDataFrame([("x",)], "text string")
    out = resampling.resampled(documents(rows).withColumn("rank", F.lit("r")), texts)
    got = sorted((r["rank"], r["row"]["doc_id"], r["row"]["text"], r["row"]["rank"]) for r in out.collect())
    want = {r[0]: r[4] for r in expected(rows, ["x"]) if r[4]}
    assert got == sorted((rank, i, prose(i, 30), "r") for i, rank in want.items()) and len(got) == 10


def test_empty_tables(spark, documents, prose):
    assert found(spark, documents([]), ["x"]) == []
    rows = [(i, prose(i, 30)) for i in range(9)]
    assert found(spark, documents(rows), []) == expected(rows, [])
