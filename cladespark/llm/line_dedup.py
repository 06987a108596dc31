"""Lines that many documents share, dropped from all but one of them; decisions travel as bitmaps, not as text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cladespark.llm.common import HEAVY_SHARE, KEY, keyed, row_key, stored, table, text_or_empty

BLANK = " \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, k1 long, k2 long, n_lines int, at array<int>"
SAMPLE_ROWS = 1_000_000
DROPS = "k1 long, k2 long, n_lines int, at array<int>"


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_keys(text: str, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines a text has, and where each long enough key stands in it."""
    lines = text.split("\n")
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        key = line.strip(BLANK)
        if len(key) >= min_chars:
            found.setdefault(key.encode().lower(), []).append(at)
    return len(lines), found


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for row, text in enumerate(texts):
                n, found = line_keys(text, min_chars)
                for key, at in found.items():
                    h = xxhash.xxh3_128_intdigest(key)
                    rows.append((signed(h >> 64), signed(h & (1 << 64) - 1), ids[row], k1[row], k2[row], n, at))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int32()))
            names = [c.split()[0] for c in LINES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _drops(min_docs: int):
    """Over rows sorted by (hash, document from the largest down): all but the first of each group of ``min_docs``.

    The state between batches is the group's first document, its count and fewer than ``min_docs`` rows
    whose fate is open, whatever the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "n_lines", "at"]
        carry: pa.Table | None = None  # the first rows of the group that the last batch ended in
        seen = 0  # rows of that group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            held = carry.num_rows if carry is not None else 0
            rows = pa.concat_tables([carry, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
            doc = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            sizes = np.diff(np.r_[starts, len(h1)])
            totals = sizes.copy()
            if held:
                totals[0] += seen - held
            firsts = np.repeat(doc[starts], sizes)
            out = np.repeat(totals >= min_docs, sizes) & (doc != firsts)
            if held and seen >= min_docs:
                out[:held] = False  # sent before
            yield from rows.filter(pa.array(out)).select(names).to_batches()
            last = starts[-1]
            keep = min(sizes[-1], max(1, min_docs - 1))
            carry, seen = rows.slice(last, keep).combine_chunks(), int(totals[-1])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, n_lines, at = batch.columns
        bitmaps, dropped = [], []
        for n, places in zip(n_lines.to_pylist(), at.to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[places] = False
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(n - int(keep.sum()))
        arrays = [k1, k2, n_lines, pa.array(dropped, pa.int32()), pa.array(bitmaps, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "n_lines", "n_dropped", "keep"])


def keep_of(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as one boolean per line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Which lines stay, for every document that loses some: (k1, k2, n_lines, n_dropped, keep).

    A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points held by at least ``min_docs`` documents lose their lines
    everywhere but in the largest doc_id that holds them, where all stay. Every row is a document, also one that repeats another's id or text. Hashes of keys are
    range-partitioned and sorted with their documents, the largest first, and each partition
    is streamed once. A range cannot split a key, so keys held by more than one in ``HEAVY_SHARE`` of all
    holders (no more than ``HEAVY_SHARE`` keys, found in a sample of rows) are decided over all
    their rows by a partial aggregate instead; both ways decide alike.

    ``keep`` is a deflated bitmap, one bit per line. Every row counts as a document; rows
    that repeat doc_id and text share one result, null ids come after all others, and rows that
    tie for the largest id all keep their lines. Null texts are one empty line. An empty
    table gives an empty result; further columns are not read.
    """
    lines = stored(keyed(docs).mapInArrow(_lines(min_chars), LINES), "lines")
    total = lines.count()
    # Either way decides alike, so the choice may come from a sample; beyond its size only the shares are estimated.
    sample = lines.sample(min(1.0, SAMPLE_ROWS / max(1, total)), 1)
    frequent = sample.groupBy("h1", "h2").count().where(F.col("count") * HEAVY_SHARE > min(total, SAMPLE_ROWS))
    frequent = stored(frequent.orderBy(F.desc("count")).limit(HEAVY_SHARE).select("h1", "h2"), "frequent-lines")
    kept = lines.join(F.broadcast(frequent), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
    kept = kept.agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).where(F.col("n") >= min_docs)
    by_aggregate = lines.join(F.broadcast(kept), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    light = lines.join(F.broadcast(frequent), ["h1", "h2"], "left_anti")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "k1", "k2"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lines = light.repartitionByRange(partitions, "h1", "h2").sortWithinPartitions(*order)
    drops = sorted_lines.mapInArrow(_drops(min_docs), DROPS).unionByName(by_aggregate.select("k1", "k2", "n_lines", "at"))
    per_doc = drops.groupBy(*KEY).agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))
    return per_doc.mapInArrow(_bitmaps, "k1 long, k2 long, n_lines int, n_dropped int, keep binary")


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, dropped, bitmaps = (batch.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep"))
            out, count, lost = [], [], []
            for text, n, d, bitmap in zip(texts, n_lines, dropped, bitmaps, strict=True):
                if bitmap is not None:
                    text = "\n".join(x for x, stays in zip(text.split("\n"), keep_of(bitmap, n), strict=True) if stays)
                out.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                count.append(text.count("\n") + 1 if bitmap is None else n)
                lost.append(d or 0)
            arrays = [batch.column("rest"), pa.array(count, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["rest", "n_lines", "n_dropped", "text"])

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """(rest, n_lines, n_dropped, text) of every row: its text without the dropped lines, or the SHA-256 of that.

    ``rest`` is a struct of all other columns of the row.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(*row_key(), rest, text_or_empty().alias("text")).join(bitmaps, list(KEY), "left")
    schema = StructType([rows.schema["rest"], *(StructField(c, LongType()) for c in ("n_lines", "n_dropped")), StructField("text", StringType())])
    return rows.mapInArrow(_apply(digest), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs.select("doc_id", "text"), line_bitmaps(docs), digest=True)
    return out.select("rest.doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"))


SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents),
lines AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(split) AS line, generate_subscripts(split, 1) AS i FROM rows)),
keys AS (SELECT key, max(doc_id) AS keep_id FROM lines WHERE length(key) >= 20
         GROUP BY key HAVING count(DISTINCT r) >= 3),
marked AS (SELECT l.r, l.doc_id, l.i, l.line, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keep_id AS dropped
           FROM lines l LEFT JOIN keys k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
