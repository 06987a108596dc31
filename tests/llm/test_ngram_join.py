"""Shingle similarity against brute force, and the components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cladespark.llm import components, ngram_join
from tests.conftest import rows_of


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def expected(rows):
    sets, holders = sets_of(rows), defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, s in enumerate(sets):
        shared = Counter(other for x in s for other in holders[x])
        for other, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                root[find(at)] = find(other)
        for x in s:
            holders[x].append(at)
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[find(at)] = min(i, least.get(find(at), i))
    return sorted(((i, len(sets[at]), least.get(find(at))) for at, (i, _) in enumerate(rows)), key=repr)


def found(docs):
    return rows_of(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id")


def edited(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=6))
    return " ".join(words)


def test_awkward_texts(documents, awkward):
    assert found(documents(awkward)) == expected(awkward)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_around_the_threshold(documents, prose, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(1000 * seed + g, rng.randint(4, 160)).replace("\n", " ")
        rows += [(len(rows) + k, edited(base, rng, rng.randint(0, 6))) for k in range(rng.randint(1, 14))]
    rng.shuffle(rows)
    assert found(documents(rows)) == expected(rows)


def test_a_large_group_of_near_copies_and_a_shared_passage(documents, prose):
    rng = random.Random(9)
    base, passage = prose(77, 60).replace("\n", " "), prose(78, 40).replace("\n", " ")
    rows = [(i, edited(base, rng, rng.randint(0, 5))) for i in range(400)]
    rows += [(1000 + i, prose(2000 + i, 20).replace("\n", " ") + " " + passage) for i in range(400)]
    rows += [(2000 + i, base) for i in range(300)]
    assert found(documents(rows)) == expected(rows)


def test_chains_link_their_ends(documents, prose):
    words = prose(4, 400).replace("\n", " ").split(" ")
    rows = [(100 - k, " ".join(words[10 * k : 10 * k + 100])) for k in range(20)]  # neighbours share 86 of 106 shingles
    assert found(documents(rows)) == expected(rows) and {r[2] for r in found(documents(rows))} == {81}


def test_empty_table(documents):
    assert found(documents([])) == []


def test_prefixes_of_similar_sets_meet_under_every_order(prose):
    rng = random.Random(3)
    base = prose(6, 120).replace("\n", " ")
    a, b = ngram_join.shingle_sets(pa.array([base, edited(base, rng, 2)]), 5)
    frequent = ngram_join.Frequent(a[:20].copy())
    for order in range(ngram_join.ORDERS):
        x, y = (frequent.prefix(s, order, ngram_join.prefix_size(len(s), 75)) for s in (a, b))
        least = min(1 + -(-75 * len(s) // 100) // ngram_join.EXTRA for s in (a, b))
        assert len(set(x.tolist()) & set(y.tolist())) >= least and len(x) == len(a) - -(-75 * len(a) // 100) + 1 + len(a) // 10


@pytest.mark.parametrize("n", (3, 20, 100, 146, 1000))
def test_similar_sets_share_as_many_tokens_as_their_sizes_ask_for(spark, n):
    rng = random.Random(n)
    rows, shared = [], []
    for other in sorted({-(-3 * n // 4), n - n // 7, n, n + n // 5, 4 * n // 3}):
        common = -(-75 * (n + other) // 175)  # as few as similar sets can share
        tokens = np.array([rng.getrandbits(64) for _ in range(n + other - common)], np.uint64)
        a, b = tokens[:n], tokens[n - common :]
        frequent = ngram_join.Frequent(np.array(rng.sample(tokens.tolist(), len(tokens) // 2), np.uint64))
        for order in range(ngram_join.ORDERS):
            x, y = (frequent.prefix(s, order, ngram_join.prefix_size(len(s), 75)) for s in (a, b))
            rows += [(n, other, other), (other, n, n)]
            shared += 2 * [len(set(x.tolist()) & set(y.tolist()))]
    least = spark.createDataFrame(rows, "n long, low long, high long").select(ngram_join.least_between(75).alias("l")).collect()
    assert all(1 <= r["l"] <= s for r, s in zip(least, shared, strict=True))
    assert n < 100 or least[2 * [low for _, low, _ in rows[::2]].index(n)]["l"] >= 0.18 * n


def test_alike_nodes_that_cannot_be_similar_do_not_meet(table):
    schema = "bucket int, token long, pass long, node long, n long, cluster long, size long"
    alike = [(p, t, p, node, 146, node, 1) for p in range(2) for t in range(22) for node in range(60)]
    similar = [(p, t, p, node, 146, node, 1) for p in range(2) for t in range(100, 132) for node in (100, 101)]
    met = rows_of(ngram_join.met_clusters(table(schema, alike + similar), 75).select("c", "node", "pass").distinct())
    assert met == [(101, 100, 0), (101, 100, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_other_lengths_around_the_threshold(documents, prose, seed):
    rng = random.Random(50 + seed)
    rows = []
    for g in range(10):
        words = prose(300 * seed + g, rng.randint(60, 300)).replace("\n", " ").split(" ")
        for _ in range(rng.randint(2, 20)):
            start, end = rng.randint(0, len(words) // 6), len(words) - rng.randint(0, len(words) // 6)
            rows.append((len(rows), edited(" ".join(words[start:end]), rng, rng.randint(0, len(words) // 50))))
    assert found(documents(rows)) == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.choice((0, 20, 60)))] + [(100 + k, 101 + k) for k in range(30)]
    links += [(500, 600 + k) for k in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = sorted(((x, find(x)) for x in root), key=repr)
    got = rows_of(components.components(spark.createDataFrame(links, "a long, b long")))
    assert got == want
