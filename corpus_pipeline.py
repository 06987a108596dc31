"""From raw documents to packed sequences: every stage works on all that the one before it kept.

``run`` applies the stages to the table ``documents``. A stage takes (spark, docs, sf_dir) and returns a table that is
written and read again as the next one's documents; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from cladespark.llm.common import KEY, row_key, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the rules learned from ``labels`` keep, whole rows with all their columns.

    A null or empty text has no words, fails the base and goes. Rows are judged one by one: rows that repeat, or share an id, stay or go
    each by its own text. Labels of ids that are not there, or without a quality, teach nothing; without usable ones the base alone decides. An
    empty table gives an empty one.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that stay in another one; it may be left empty.

    No row goes: a null text becomes an empty one, and a row without an id loses its shared lines to any with one. Rows that repeat
    hold a line as often as they are there, and all rows with the largest id keep it. ``n_chars`` is counted anew, and all other columns,
    whatever their names, stay as they are. An empty table gives an empty one.
    """
    cleaned = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    n_chars = F.length("text").cast("long").alias("n_chars")
    named = {"text": F.col("text"), "n_chars": n_chars}
    return cleaned.select(*[named.get(c, F.col(f"rest.`{c}`")) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the least doc_id, and of several with that id, or with none, the one of the least hashes.

    Texts without shingles are groups of their own.
    """
    groups = ngram_join.similar_groups(docs, with_component=True)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = first.where(F.col("component").isNull()).select(*KEY)
    one = first.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(*KEY)).alias("key"))
    staying = one.select("key.*").unionByName(alone)
    rows = docs.select(*row_key(), F.struct(*docs.columns).alias("row")).join(staying, list(KEY), "left_semi")
    return rows.dropDuplicates(list(KEY)).select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, wholly or in part.

    A document whose words are taken twice is two rows; one without words, or with a null or empty text, is in no mix. Rows that repeat are
    taken each on their own, null ids too, and a null source is a source, the last. Other columns go with each row. Documents without any words, or an empty
    table, give an empty one.
    """
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document of the mix lies in the training sequences.

    Every row is a document of its own, also where ids repeat or are null; a null or empty text is its end token alone. Columns other
    than the id and the text are not read. An empty table gives no pieces.
    """
    return packing.pack(docs, packing.public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("line dedup", without_shared_lines),
    ("n-gram join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The rules are learned and the tokens come from a tokenizer's file: no SQL for these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
