"""Toxicity: accuracy on held-out documents, features, and the rule that labels of these are never used."""

import random
import zlib

from cladespark.llm import toxicity
from tests.conftest import rows_of

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ("idiot", "moron", "scum")


def corpus(prose, n=1500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, rng.randint(30, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["you ", ""]) + (rng.choice(INSULTS) if i % 8 else "zorb" + rng.choice(["ak", "enti", "uu", "oil"])))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_documents_and_that_their_labels_are_not_used(spark, documents, prose):
    rows, labels = corpus(prose)
    found = rows_of(toxicity.score(documents(rows), spark.createDataFrame(labels, LABELS), trees=8))
    truth = {i: t for i, _, t in labels}
    assert [r[0] for r in sorted(found)] == [r[0] for r in rows] and all(h == held(i) and 0 <= s <= 1 and p == int(s >= 0.5) for i, h, s, p in found)
    test = [(p, truth[i]) for i, h, _, p in found if h]
    assert sum(p == t for p, t in test) >= 0.97 * len(test)
    wrong = [(i, g, 1 - t if held(i) else t) for i, g, t in labels]
    assert rows_of(toxicity.score(documents(rows), spark.createDataFrame(wrong, LABELS), trees=8)) == found


def test_awkward_texts_with_few_or_no_labels(spark, documents, awkward):
    for labels in ([], [(7, 1, None)], [(7, 1, 1)], [(i, 1, i % 2) for i in range(1, 15)]):
        found = rows_of(toxicity.score(documents(awkward), spark.createDataFrame(labels, LABELS)))
        assert sorted((r[0] for r in found), key=repr) == sorted((i for i, _ in awkward), key=repr)
        assert all(0 <= r[2] <= 1 and (r[0] is not None or r[1]) for r in found)


def test_empty_table(spark, documents):
    assert toxicity.score(documents([]), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).count() == 0


def test_the_sample_is_bounded_and_leaves_out_held_out_ids(spark, documents):
    docs = documents([(i, "x") for i in range(100)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(7, 1, 1)], LABELS)
    ids = [r[0] for r in rows_of(toxicity.labelled_sample(docs, labels, 30), "doc_id")]
    assert 10 <= len(ids) == len(set(ids)) <= 30 and not any(map(held, ids)) and max(ids) < 100


def test_features():
    lexicon = {"idiot": 5.0, "zorb-": 4.0}
    names = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT, id1ot! Zorbak i*iot and 1d10t are here?", lexicon), strict=True))
    assert names["word_hits"] == 1 and names["stem_hits"] == 1 and names["strongest"] == 5.0
    assert names["disguised_hits"] * 9 == 2 and names["near_you"] > 0 and names["shouted"] > 0 and names["starred_words"] > 0
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)
