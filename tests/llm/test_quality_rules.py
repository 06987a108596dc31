"""Counts against brute force, rules against their promise."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladespark.llm import quality_rules as q
from tests.conftest import rows_of

LABELS = "doc_id long, quality int, toxic int"


def expected(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def counts(rows):
    stats = F.col("stats")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows_of(q.text_statistics(rows).select("doc_id", *[stats[n] for n in names], q.base_failed(stats)))


def test_awkward_texts(documents, awkward):
    assert counts(documents(awkward)) == sorted(((i, *expected(t)) for i, t in awkward), key=repr)


def test_random_texts(documents):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = rng.choices(["a", "b", "é", "C#", "$%", "|"], k=rng.randint(0, 120)) if i % 2 else [str(rng.random()) for _ in range(rng.randint(0, 90))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words)))
    assert counts(documents(rows)) == sorted(((i, *expected(t)) for i, t in rows), key=repr)


def test_windows_of_texts_beyond_the_packed_places(documents, prose, monkeypatch):
    monkeypatch.setattr(q, "PACKED_BITS", 5)
    rows = [(1, prose(1, 500)), (2, "a b c d " * 40 + prose(2, 100)), (3, prose(3, 20))]
    assert counts(documents(rows)) == sorted(((i, *expected(t)) for i, t in rows), key=repr)


def corpus(prose, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, rng.randint(60, 200)).split()
        kind = i % 6
        if kind == 0:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
        rows.append((i, text))
        labels.append((i, int(kind > 1), 0))
    return rows, labels


def test_rules_tell_bad_from_good_on_documents_without_labels(spark, documents, prose):
    rows, labels = corpus(prose)
    known = spark.createDataFrame(labels[:300] + [(5, None, 0), (None, 0, 0)], LABELS)
    found = {r["doc_id"]: r for r in q.score(documents(rows), known).collect()}
    new = [(found[i]["kept"], bool(good)) for i, good, _ in labels[300:]]
    assert sum(k == g for k, g in new) >= 0.98 * len(new)
    assert not any(r["kept"] and r["base_failed"] for r in found.values())
    kept = q.keep_good(documents(rows), known)
    assert kept.columns == documents(rows).columns
    assert {r[0] for r in rows_of(kept, "doc_id")} == {i for i, r in found.items() if r["kept"]}


def test_rules_are_ordered_expressions(spark, documents, prose):
    rows, labels = corpus(prose, 300)
    stats = q.text_statistics(documents(rows)).select("doc_id", "stats")
    rules = q.learn(q.labelled_rows(stats, spark.createDataFrame(labels, LABELS)))
    assert 1 <= len(rules) <= 4 and all(1 <= len(r) <= 4 for r in rules)
    assert {c.feature for r in rules for c in r} <= set(q.FEATURES) and str(rules[0][0]).split()[1] in (">", "<=")
    assert "CASE WHEN" in str(q.verdict(rules, F.col("stats")))


def planted(spark, prose, defects, n=2400):
    """Documents of 60 words, those of each defect (a set of ids, a change of a word) labelled bad: (stats, labels)."""
    rows = []
    for i in range(n):
        words = prose(i, 60).split()
        for ids, change in defects:
            words = [change(w) if i in ids else w for w in words]
        rows.append((i, " ".join(words)))
    bad = set().union(*[ids for ids, _ in defects])
    stats = q.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "stats")
    return stats, spark.createDataFrame([(i, int(i not in bad), 0) for i in range(n)], LABELS)


def rejected(stats, labels):
    rules = q.learn(q.labelled_rows(stats, labels))
    return {r["doc_id"] for r in stats.select("doc_id", q.verdict(rules, F.col("stats")).alias("rule")).where("rule > 0").collect()}


def test_a_defect_of_one_percent_on_a_continuous_feature(spark, prose):
    rare = set(range(50, 2400, 100))
    stats, labels = planted(spark, prose, [(rare, lambda w: w + "ation")])
    found = rejected(stats, labels)
    assert found >= rare and len(rare) >= 0.9 * len(found)


def test_a_defect_behind_one_that_fails(spark, prose):
    ids = spark.range(2400).select("id", (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(q.ALL_PARTS)) < q.GROW_PARTS).alias("growing")).collect()
    unproven = set([r["id"] for r in ids if r["growing"]][:200])  # no row is left that could show that its rule is right
    other = set(range(2300, 2400))
    stats, labels = planted(spark, prose, [(unproven, lambda w: w + "!"), (other - unproven, lambda w: w + "$")])
    assert rejected(stats, labels) == other - unproven


@pytest.mark.parametrize("labels", [[], [(1, None, 0)], [(1, 1, 0), (2, 1, 1)], [(99, 0, 0)]])
def test_without_usable_labels_only_the_base_decides(spark, documents, prose, labels):
    rows = [(1, prose(1, 80)), (2, prose(2, 10)), (3, None)]
    found = q.score(documents(rows), spark.createDataFrame(labels, LABELS))
    assert rows_of(found, "doc_id", "kept", "rule") == [(1, True, 0), (2, False, 0), (3, False, 0)]


def test_empty_table(spark, documents):
    labels = spark.createDataFrame([], LABELS)
    assert q.score(documents([]), labels).count() == 0 and q.keep_good(documents([]), labels).count() == 0


def test_no_python_in_the_plan(spark, documents, prose):
    rows, labels = corpus(prose, 60)
    plan = q.keep_good(documents(rows), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "PythonUDF", "BatchEvalPython"))
