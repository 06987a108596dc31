"""Exact duplicates by a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import attach, stored, table, text_or_empty
from cladespark.session import shared_folder


LEAST_ID = -(1 << 63)
BUCKETS, ROWS_PER_BUCKET = 32, 4_000_000


def text_digest() -> Column:
    """SHA-256 of the text in UTF-8 as lower-case hex; a null text is an empty one."""
    return F.sha2(text_or_empty().cast("binary"), 256)


class DigestIndex:
    """The digests seen so far, with the document that stands for each: a bucketed, sorted table at ``location``.

    ``add`` takes documents (doc_id, text, any more columns), drops what the index holds by a
    sort-merge anti-join on the digest and appends the rest in the table's layout, so the
    index side is never shuffled. Within one call the largest ``doc_id`` stands for a digest;
    a null id only where no other has it. An empty table adds nothing. Opening the same
    location again, in any session, continues with what is there.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = BUCKETS):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, docs: DataFrame) -> DataFrame:
        """(digest, keep_id) of the texts in ``docs`` that the index lacks."""
        return self._new(docs.select(text_digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id")))

    def _new(self, digests: DataFrame) -> DataFrame:
        found = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        found = found.repartition(self.buckets, "digest").hint("merge")
        return found.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame) -> None:
        self.add_digests(docs.select(text_digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id")))

    def add_digests(self, digests: DataFrame) -> None:
        """As ``add`` for rows (digest, doc_id), for callers that have hashed the texts already."""
        fresh = stored(self._new(digests), "new-digests")
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def forget(self) -> None:
        """Take the index out of the session's catalog; what is written at its location stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self, location: str) -> DigestIndex:
        """The same index at a new location with one sorted file per bucket."""
        other = DigestIndex(self.spark, location, self.buckets)
        self.table().repartition(self.buckets, "digest").write.insertInto(other.name)
        return other


def exact_dedup(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Every document with the one that stays for its text: (doc_id, keep_id, group_size, kept, text_sha256).

    The documents enter the index in ``batches`` ranges of ids, the largest ids first, so
    the largest id of a text is the one indexed; null ids come last and stay only if no other
    row has the text. Rows that repeat both id and text share one result. A text that the
    index held before keeps the id found there and is kept nowhere here. Texts are equal when their
    bytes are; nothing is normalised. An empty table gives an empty result.
    """
    digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")), "digests")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = 0 if low is None else -(-(high - low + 1) // batches)
    for i in range(batches if low is not None else 0):
        first = high - (i + 1) * step
        if first + step < low:
            break  # fewer ids than ranges
        part = F.col("doc_id") <= first + step
        if first >= LEAST_ID:  # the last range may begin below all longs
            part &= F.col("doc_id") > first
        index.add_digests(digests.where(part))
    index.add_digests(digests.where(F.col("doc_id").isNull()))

    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = stored(sizes.join(index.table(), "digest"), "digest-groups")
    out = attach(digests, groups, ["digest"], "group_size", ["keep_id", "group_size"])
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, shared_folder(spark, "digest-index"), max(BUCKETS, docs.count() // ROWS_PER_BUCKET))
    out = exact_dedup(docs, index)
    index.forget()
    return out


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
