"""What the corpus operators share: row keys, written intermediates, word arrays, joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.session import shared_folder

KEY = ("k1", "k2")
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
HEAVY_SHARE = 1000
PARTS = 1024
BLOCK_BYTES = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the cluster's shared folder and read back: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def row_key() -> list[Column]:
    """Two hashes of (doc_id, text), never null: rows equal in both are one document."""
    return [
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text) of every row, null texts as empty; other columns are left out."""
    return docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def attach(rows: DataFrame, groups: DataFrame, key: Sequence[str], size: str, values: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` with one row per key, safe when one key holds a large share of the rows.

    ``groups`` must be stored and hold the number of rows per key in ``size``. Keys above one
    in ``HEAVY_SHARE`` of all rows are at most ``HEAVY_SHARE`` by arithmetic, so they are
    broadcast and their rows are salted over the shuffle that serves all other keys.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    is_heavy = F.col(size) * HEAVY_SHARE > total
    packed = F.struct(*values)
    heavy = groups.where(is_heavy).select(*key, packed.alias("_heavy"))
    light = groups.where(~is_heavy).select(*key, F.lit(0).alias("_salt"), packed.alias("_light"))
    salt = F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1024)))
    joined = rows.join(F.broadcast(heavy), list(key), "left").withColumn("_salt", salt.cast("int"))
    joined = joined.join(light, [*key, "_salt"], "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return joined.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def most_frequent(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """About the ``limit`` rows with the largest counts, and no more: all above some count, and of those just below it some by hash.

    The count comes from a histogram in eighths of powers of two and the hash from one of that level, so no task sends more than
    it has of these rows.
    """
    level = F.floor(8 * F.log2(count)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(3), *rows.columns), F.lit(PARTS))
    left = limit
    for r in sorted(rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["level"]):
        if r["rows"] > left:
            parts = {p["part"]: p["rows"] for p in rows.where(level == r["level"]).groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()}
            sizes = np.cumsum([parts.get(i, 0) for i in range(PARTS)])
            return rows.where((level > r["level"]) | ((level == r["level"]) & (part < int(np.searchsorted(sizes, left, "right")))))
        left -= r["rows"]
    return rows


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``limit`` bytes of text; one longer text is one slice."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for start, end in zip(starts, [*starts[1:], len(block)], strict=True):
            yield batch.slice(start, end - start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of every text, A-Z in lower case: (offsets of the texts, a code per word, the words of the codes)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, known = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.cast(pa.binary()).to_pylist()
    if b"" in known:  # what leading or trailing space leaves
        full = codes != known.index(b"")
        offsets = np.r_[0, np.cumsum(full)][offsets]
        codes = codes[full]
    return offsets, codes.astype(np.int64), known


def crc_steps() -> np.ndarray:
    """What a byte does to the register of CRC-32, bits taken from the low end."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> np.uint32(1)) ^ np.uint32(0xEDB88320), steps >> np.uint32(1))
    return steps


CRC_STEPS = crc_steps()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.diff(np.r_[starts, len(values)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every (start, count), one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
