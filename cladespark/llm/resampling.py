"""Documents drawn by how much likelier they are in a target corpus: hashed n-gram weights, Gumbel noise, the top share.

The cutoff of the draw is found by narrowing its score, and then the ids of the rows tied at it, with exact counts over
the stored scores; only the rows that are drawn are moved, to be numbered in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import CRC_STEPS, KEY, blocks, row_key, stored, table, text_or_empty

BUCKETS = 10_000
SHARE, MIN_WORDS, SEED = 25, 20, 7
WAYS = 16
PIECE_BYTES = 4 << 20
LONG_WORD = 64
ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[128:] = True


def _fold(register: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC registers after one word each: all words a byte at a time, those of many bytes by themselves."""
    out = register.copy()
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : starts[i] + lengths[i]], int(~register[i])))
    order = np.argsort(np.where(lengths > LONG_WORD, 0, -lengths), kind="stable")
    at, sizes, now = starts[order], lengths[order], register[order]
    live = int(np.count_nonzero(sizes <= LONG_WORD))
    for j in range(LONG_WORD):
        live = int(np.searchsorted(-sizes[:live], -j, "left"))  # the words longer than j
        if not live:
            break
        part = now[:live]
        now[:live] = CRC_STEPS[(part ^ data[at[:live] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    short = sizes <= LONG_WORD
    out[order[short]] = now[short]
    return out


def features(data: np.ndarray, bounds: np.ndarray, carried: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, text of each feature, bucket of each feature) of lower-cased texts in one array of bytes.

    Texts begin at ``bounds``. With ``carried`` the first word was counted before and only makes a pair with the second.
    """
    word = IS_WORD[data]
    first = bounds[bounds < len(data)]
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    before[first] = False
    after[first[first > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    lengths = np.flatnonzero(word & ~after) + 1 - starts
    text = np.searchsorted(bounds, starts, "right") - 1
    register = _fold(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = CRC_STEPS[(register[pair] ^ np.uint32(0x20)) & np.uint32(255)] ^ (register[pair] >> np.uint32(8))
    pairs = _fold(spaced, data, starts[pair + 1], lengths[pair + 1])
    own = slice(int(carried), None)
    buckets = ~np.r_[register[own], pairs] % np.uint32(BUCKETS)
    return text[own], np.r_[text[own], text[pair]], buckets.astype(np.int64)


def _pieces(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Texts as (bytes in lower case, where each begins, whether the first word is known); one long text comes in pieces.

    A piece ends between words and the next one begins with its last word, so no pair is lost.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    if len(texts) > 1 or len(data) <= limit:
        yield data, offsets[:-1] - offsets[0], False
        return
    start = cut = 0
    while cut < len(data):
        end = min(cut + limit, len(data))
        while end < len(data) and IS_WORD[data[end]]:
            gap = np.flatnonzero(~IS_WORD[data[end : end + limit]])
            end = end + int(gap[0]) if len(gap) else min(end + limit, len(data))
        yield data[start:end], np.zeros(1, np.int64), start < cut
        word = np.flatnonzero(IS_WORD[data[start:end]])
        if len(word):
            last = start + int(word[-1])
            gaps = np.flatnonzero(~IS_WORD[data[start:last]])
            start = start + int(gaps[-1]) + 1 if len(gaps) else start
            cut = end
        else:
            start = cut = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in blocks(batches, limit=PIECE_BYTES):
        for data, bounds, carried in _pieces(batch.column("text"), PIECE_BYTES):
            counts += np.bincount(features(data, bounds, carried)[2], minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket; every task sends at most a row per bucket."""
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_count, "bucket long, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, smoothed by one, rounded down."""
    t, s = target.astype(float), source.astype(float)
    odds = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def _weigh(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=PIECE_BYTES):
            n = batch.num_rows
            n_words, n_features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for data, bounds, carried in _pieces(batch.column("text"), PIECE_BYTES):
                words, owners, buckets = features(data, bounds, carried)
                n_words += np.bincount(words, minlength=n)
                n_features += np.bincount(owners, minlength=n)
                np.add.at(total, owners, gains[buckets])
            weight = total // np.maximum(n_features, 1)
            arrays = [pa.array(a) for a in (n_words, n_features, weight)]
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *arrays], [*names, "n_words", "n_features", "weight"])

    return run


def _noise(seed: int) -> Column:
    """Thousandths of a Gumbel variable drawn from the document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_features, weight, score) of every row.

    Words are runs of ASCII letters and digits and of all code points beyond ASCII, A-Z in lower case; features are words and
    pairs of neighbours, hashed to buckets. A bucket's gain compares its share in all texts of ``target`` (text) with that in all of
    ``docs``; the weight of a text is the mean gain of its features, rounded down, and 0 without any. Null texts are empty.
    Rows with one id have one noise, rows without an id that of an empty one. An empty target makes all gains
    follow the documents alone. Texts of any length are read in pieces.
    """
    gains = bucket_gains(bucket_counts(target), bucket_counts(docs))
    rows = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    weighed = rows.mapInArrow(_weigh(gains), "k1 long, k2 long, doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _noise(seed))


def _narrow(rows: DataFrame, column: str, low: int, high: int, need: int) -> tuple[int, int]:
    """The least value in [low, high] with ``need`` rows at or below it, and how many rows are below that value.

    Each round is one exact count of the rows at or below several values, which leaves one part of the range in ``WAYS``.
    """
    below = 0
    while low < high:
        size = -(-(high - low + 1) // WAYS)
        marks = [low + size * i - 1 for i in range(1, WAYS) if low + size * i - 1 < high]
        counts = rows.agg(*[F.count_if(F.col(column) <= m).alias(f"n{i}") for i, m in enumerate(marks)]).first()
        for mark, n in zip(marks, counts, strict=True):
            if n >= need:
                high = mark
                break
            low, below = mark + 1, n
    return low, below


def _drawn(pool: DataFrame, need: int) -> Column:
    """Which rows have the ``need`` highest scores, those tied at the last place by the least id, without an id last.

    Rows that repeat the last id's score may be more than ``need``.
    """
    least, most = pool.agg(F.min("score"), F.max("score")).first()
    negated = pool.select("doc_id", (-F.col("score")).alias("loss"))
    loss, above = _narrow(negated, "loss", -most, -least, need)
    tied = pool.where(F.col("score") == -loss)
    lowest, highest, n = tied.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    at_cutoff = F.col("score") == -loss
    if n > need - above:
        last, _ = _narrow(tied, "doc_id", lowest, highest, need - above)
        at_cutoff &= F.coalesce(F.col("doc_id") <= last, F.lit(False))
    return (F.col("score") > -loss) | at_cutoff


def draw(scored: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``scores`` with their ``rank`` in the draw, null for those not drawn.

    Of the n rows with at least ``min_words`` words, the floor of ``share`` percent with the highest scores are drawn, ties by
    the least id, rows without an id last; rows equal in both rank by their number of features, and equal rows in any
    order. The cutoff comes from exact counts over the stored scores. Only drawn rows are range-partitioned: a rank is the place
    in the partition after all rows of the partitions before. The number of the stored row is part of the order, so rows that repeat one
    id are split over partitions like any others. No rows or a share of none draw nothing.
    """
    numbered = stored(scored.withColumn("at", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= min_words
    pool = numbered.where(fit)
    need = pool.count() * share // 100
    if need == 0:
        return numbered.drop("at").withColumn("rank", F.lit(None).cast("long"))
    is_drawn = fit & _drawn(pool, need)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("at").asc()]
    ordered = numbered.where(is_drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", ROW_BITS).alias("part")
    # One row per partition.
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("part", part).join(F.broadcast(sizes.select("part", first.alias("first"))), "part")
    rank = F.col("first") + F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    columns = [c for c in numbered.columns if c != "at"]
    ranked = ranked.select(*columns, F.when(rank <= need, rank).alias("rank"))
    return ranked.unionByName(numbered.where(~is_drawn).select(*columns), allowMissingColumns=True)


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(rank, row) of the documents drawn, ``row`` a struct of all columns; rows equal in id and text are one document."""
    ranks = draw(scores(docs, target, seed), share, min_words).where(F.col("rank").isNotNull())
    ranks = ranks.groupBy(*KEY).agg(F.min("rank").alias("rank"))
    rows = docs.select(*row_key(), F.struct(*docs.columns).alias("row"))
    return rows.dropDuplicates(list(KEY)).join(ranks, list(KEY)).select("rank", "row")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
featured AS (
  SELECT doc_id, len(w) AS n_words,
         list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
counted AS (
  SELECT feature, count(doc_id) AS s, count(*) - count(doc_id) AS t
  FROM (SELECT doc_id, unnest(f) AS feature FROM featured) GROUP BY feature),
bucketed AS (
  SELECT feature, s, t, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(1, 1 + octet_length(encode(feature))),
                     lambda i: ('0x' || substr(hex(feature), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM counted, crc),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM bucketed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
totals AS (
  SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n
  FROM (SELECT doc_id, unnest(f) AS feature FROM featured WHERE doc_id IS NOT NULL)
  JOIN bucketed USING (feature) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, n_words, coalesce(n, 0) AS n_features, floor(coalesce(total, 0)::DOUBLE / greatest(coalesce(n, 0), 1))::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM featured d LEFT JOIN totals USING (doc_id) WHERE d.doc_id IS NOT NULL),
scored AS (
  SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
pool AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS need
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= need THEN place END AS rank
FROM scored LEFT JOIN pool USING (doc_id)
"""
