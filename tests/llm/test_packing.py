"""Packing: exact round trip of ids, gapless sequences, little padding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cladespark.llm import packing

PATH = packing.public_tokenizer()


def check(rows, found, capacity=1024):
    tokenizer = Tokenizer.from_file(PATH)
    left = {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        left.setdefault(i, []).append(ids)
    for i, all_ids in left.items():
        pieces = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        for ids in all_ids:  # rows that repeat share an id and are alike
            at = 0
            while at < len(ids):
                n = next(k for k, r in enumerate(pieces) if r["start"] == at and r["doc_tokens"] == len(ids))
                r = pieces.pop(n)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        assert not pieces
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        short += at < capacity
    assert short <= 1


def test_awkward_texts(documents, awkward):
    docs = documents(awkward)
    check(awkward, packing.pack(docs, PATH).collect())


@pytest.mark.parametrize("capacity", [16, 100])
def test_random_documents(documents, prose, capacity):
    rng = random.Random(capacity)
    rows = [(i, prose(i, rng.randint(0, 60))) for i in range(200)] + [(1000 + i, "the same text") for i in range(150)]
    check(rows, packing.pack(documents(rows).repartition(5), PATH, capacity).collect(), capacity)


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).count() == 0


def test_units_give_the_ids_of_whole_texts(awkward, prose):
    texts = [t or "" for _, t in awkward] + [prose(i, 200) for i in range(5)]
    texts += ["a  b", " a", "a ", "\na", "a\n", "a \nb", "a\n b", "a\n\nb", "don't 've", "x y z", "é ü ß", "　", "日本 語", "<|endoftext|> x"]
    tokenizer = Tokenizer.from_file(PATH)
    units = packing.Units(tokenizer)
    for _ in range(2):  # the second time from the cache
        ids, counts = units.encode(pa.array(texts))
        at = 0
        for text, n in zip(texts, counts.tolist()):
            assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
            at += n
        assert at == len(ids)


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_piece_once_and_fills_all_but_one(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 20))}
    used, filled = {}, {}
    for r in packing.plan(counts, 64):
        for k in range(r.pieces):
            used.setdefault((r.length, r.rank + k), []).append((r.begin, r.size))
            filled.setdefault(r.sequence + k // r.per, []).append((r.offset + k % r.per * r.size, r.size))
    assert set(used) == {(n, k) for n, c in counts.items() for k in range(c)}
    for (length, _), parts in used.items():
        at = 0
        for begin, size in sorted(parts):
            assert begin == at
            at += size
        assert at == length
    ends = []
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        ends.append(at)
    assert sum(e < 64 for e in ends) <= 1 and max(ends) <= 64


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 40}
        chosen = packing.fill(counts, 40)
        assert sum(n * c for n, c in chosen.items()) == max(sums) and all(c <= counts[n] for n, c in chosen.items())


def test_few_runs_whatever_the_number_of_pieces():
    assert len(packing.plan({700: 10**9}, 1024)) < 5000
    assert len(packing.plan({n: 10**7 + n for n in range(1, 1025)}, 1024)) < 60_000
