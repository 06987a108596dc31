"""Toxicity of documents: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import stored, table, text_or_empty

TOKEN = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
REACH = 6  # words on either side within which a second person counts as near
# Pronouns of the second person in the four languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
)
# Characters that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = (
    "log_words", "word_hits", "word_density", "stem_hits", "stem_density", "distinct_hits", "strongest", "near_you", "second_person",
    "capitals", "shouted", "exclaims", "questions", "other_marks", "mixed_words", "starred_words", "disguised_hits",
)
ROW = "doc_id long, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def held_out() -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def terms(text: str) -> set[str]:
    """Words of a text in lower case, and as stems (marked by a trailing hyphen) how its longer words begin."""
    found = set(LETTERS.findall(text.lower()))
    return found | {word[:n] + "-" for word in found for n in STEMS if len(word) > n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms(text))
        names = list(counts[0].keys() | counts[1].keys())
        arrays = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "clean", "toxic"])


def learn_lexicon(sample: DataFrame, size: int, min_docs: int) -> dict[str, float]:
    """The ``size`` terms that speak most for a toxic text, with their log odds, from (text, toxic).

    Equal texts count once, so a copied text does not make its words a lexicon. Terms are ranked by log odds
    times the root of the toxic texts that hold them.
    """
    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    totals = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    bad, good = totals[0], totals[1] - totals[0]
    counts = texts.mapInArrow(_count_terms, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= min_docs)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    found = counts.withColumn("odds", odds).where("odds > 2.5").withColumn("rank", F.col("odds") * F.sqrt("toxic"))
    return {r["term"]: r["odds"] for r in found.orderBy(F.desc("rank"), "term").limit(size).collect()}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The numbers that the trees see, of a whole text."""
    tokens = TOKEN.findall(text)
    lower = [t.lower() for t in tokens]
    n, you, hits, strength = len(tokens), [], [], []
    words = stems = mixed = starred = disguised = shouted = 0
    distinct = set()
    for at, (token, word) in enumerate(zip(tokens, lower, strict=True)):
        if word in SECOND_PERSON:
            you.append(at)
        plain = word.isalpha()
        if not plain:
            mixed += any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
            starred += "*" in word
            shown = word.translate(DISGUISES)
            parts = LETTERS.findall(word)
            disguised += shown != word and shown in lexicon
            odds = max((lexicon.get(p, 0.0) for p in parts), default=0.0)
            word = max(parts, key=len, default="")
        else:
            odds = lexicon.get(word, 0.0)
        shouted += len(token) > 2 and token.isupper()
        beginning = max((lexicon.get(word[:k] + "-", 0.0) for k in STEMS if len(word) > k), default=0.0)
        words += odds > 0
        stems += beginning > 0
        if odds or beginning:
            hits.append(at)
            strength.append(max(odds, beginning))
            distinct.add(word)
    near = 0
    if you and hits:
        spots = np.searchsorted(you, hits)
        at = np.array([-REACH - 1 - len(text), *you, len(text) + REACH + n + 1])
        near = int(np.sum(np.minimum(np.array(hits) - at[spots], at[spots + 1] - np.array(hits)) <= REACH))
    letters = sum(map(str.isalpha, text)) or 1
    per = max(n, 1)
    marks = {c: text.count(c) for c in "!?.,;:"}
    return [
        float(np.log1p(n)), words, words / per, stems, stems / per, len(distinct), max(strength, default=0.0), near / per, len(you) / per,
        sum(map(str.isupper, text)) / letters, shouted / per, marks["!"] / per, marks["?"] / per,
        (marks["."] + marks[","] + marks[";"] + marks[":"]) / per, mixed / per, starred / per, disguised / per,
    ]


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            values = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            arrays = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(values[:, i]) for i in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``max_rows`` labelled documents that are not held out: all, or those whose hash of the id is small."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") != 0).cast("int").alias("toxic"))
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    marks = stored(marks, "labels")
    total = marks.count()
    if total > max_rows:  # a little less than the bound, which chance then leaves alone
        marks = marks.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_rows / total)).limit(max_rows)
    return stored(marks, "label-sample")


def score(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, lexicon_size: int = 600, min_docs: int = 4, trees: int = 20, depth: int = 4
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A lexicon, the trees and the calibration learn from at most ``max_rows`` labelled documents, none of them held
    out: half of them give the lexicon, three tenths the trees, which so meet the lexicon as new texts do, and the
    rest the calibration. The features are those of whole
    texts: lexicon densities, hits near a second person, capitals, punctuation and obfuscation. ``lang``, ``source``, ids and labels are
    not among them. Null and empty texts are scored as texts without words. Rows that repeat are scored
    each on their own; an id with several labels is toxic if any says so. With labels of one kind only, or none, in one of these parts
    every score is the share of toxic labels. An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    sample = labelled_sample(docs, labels, max_rows)
    part = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(10))
    texts = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])
    lexicon = learn_lexicon(texts.where(part < 5).select("text", "toxic"), lexicon_size, min_docs)
    scored = stored(rows.mapInArrow(_features(lexicon), ROW), "features")
    seen = stored(scored.join(F.broadcast(sample), "doc_id").withColumn("part", part), "training")

    kinds = seen.agg(F.expr("count_if(toxic = 1)"), F.expr("count_if(toxic = 0)"), F.expr("count_if(toxic = 1 AND part >= 8)"), F.expr("count_if(toxic = 1 AND part BETWEEN 5 AND 7)"), F.expr("count_if(toxic = 0 AND part BETWEEN 5 AND 7)")).first()
    if not all(kinds):
        scored = scored.withColumn("score", F.lit(float(kinds[0] / max(1, kinds[0] + kinds[1]))))
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=1)
        fitted = model.fit(assemble.transform(seen.where(F.col("part").between(5, 7))))

        def boosted(df: DataFrame) -> DataFrame:
            return fitted.transform(assemble.transform(df)).withColumn("margin", vector_to_array("probability")[1])

        isotonic = IsotonicRegression(labelCol="toxic", featuresCol="margin", predictionCol="score")
        scored = isotonic.fit(boosted(seen.where("part >= 8"))).transform(boosted(scored))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
