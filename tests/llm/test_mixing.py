"""Mixing: targets, permutations, exact counts of taken words, reruns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladespark.llm import mixing
from tests.conftest import rows_of


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, cut where they reach a source's limit, until none is above; null is the last source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        rest = total - sum(most * sizes[s] for s in capped)
        over = {s for s in order if s not in capped and weight[s] * rest / free > most * sizes[s]} if free else set()
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * rest / free for s in order}
        capped |= over


def words(text):
    return len((text or "").encode().split())


def check(rows, found, slack=40):
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += words(r[1])
    want, by_id = targets(sizes), defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    taken = Counter()
    for r in found:
        source = by_id[r["doc_id"]][0][2]
        assert r["size"] in {words(x[1]) for x in by_id[r["doc_id"]]}
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert len(found) == len(rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= slack + 0.01 * target
    return taken


def test_sources_come_near_their_targets(documents, prose):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(0, 200)), rng.choice(["b", "b", "b", "a", "ü", "Z", None])) for i in range(400)]
    rows += [(1000, "one two three", "tiny"), (1001, None, "nothing"), (1002, "", "nothing")]
    docs = documents(rows)
    first = mixing.taken_words(docs).collect()
    check(rows, first)
    again = mixing.taken_words(docs.repartition(7, "n_chars", "doc_id")).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_awkward_texts_and_repeated_rows(documents, awkward):
    rows = [(i, t, f"s{(i or 0) % 3}") for i, t in awkward if i != 8] + [(None, "one two", "s0")]
    rows = [r for r in rows if r[0] is not None] + [(50, "same text here", "s0")] * 5
    found = mixing.taken_words(documents(rows)).collect()
    check(rows, found)


def test_counts_of_blocks_are_exact_and_even(spark):
    sources = spark.createDataFrame([(0, 100, 250), (1, 7, 21), (2, 50, 0), (3, 1, 1), (4, 3000, 100)], "sno long, blocks long, slots long")
    found = mixing.taken_blocks(sources, shard_slots=64, seed=1)
    by = defaultdict(list)
    for s, b, n in rows_of(found):
        by[s].append((b, n))
    assert {s: sum(n for _, n in v) for s, v in by.items()} == {0: 250, 1: 21, 3: 1, 4: 100}
    assert {n for _, n in by[0]} == {2, 3} and [n for _, n in by[1]] == [3] * 7 and {n for _, n in by[4]} == {1}
    assert len({b // 300 for b, _ in by[4]}) > 5  # spread over the source


@pytest.mark.parametrize("blocks", [1, 2, 1000, 1073741827])
def test_permutations(spark, blocks):
    n = min(blocks, 5000)
    place = mixing.permuted(F.col("id"), F.lit(blocks).cast("long"), 3, F.lit(1))
    found = [r[0] for r in spark.range(n).select(place).collect()]
    assert len(set(found)) == n and min(found) >= 0 and max(found) < blocks


def test_wide_permutations(spark):
    place = mixing.permuted(F.col("id"), F.lit(1 << 40).cast("long"), 3, F.lit(1))
    found = [r[0] for r in spark.range((1 << 40) - 1000, 1 << 40).select(place).collect()]
    assert len(set(found)) == 1000 and all(0 <= x < 1 << 40 for x in found)


def test_documents_of_the_mix(documents, prose):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randint(1, 300)) + "\n", rng.choice("abc")) for i in range(100)]
    docs = documents(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    text = {r[0]: r[1] for r in rows}
    got = Counter()
    for r in mixed.select("doc_id", "text", "n_chars").collect():
        own = text[r["doc_id"]]
        got[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(own.split())
        assert r["text"] == own or words(r["text"]) < words(own)
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_empty_table_and_no_words(documents):
    assert mixing.taken_words(documents([])).count() == 0 and mixing.mixed_documents(documents([])).count() == 0
    assert rows_of(mixing.taken_words(documents([(1, ""), (2, None)])), "doc_id", "taken") == [(1, 0), (2, 0)]


def test_no_python_in_the_plan(documents, prose):
    docs = documents([(i, prose(i, 30)) for i in range(10)])
    for df in (mixing.taken_words(docs), mixing.mixed_documents(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
