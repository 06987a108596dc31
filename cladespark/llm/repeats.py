"""Repeated byte strings removed from documents: a radix sort of suffixes by digits, through the threshold and no deeper.

A suffix counts only through its first ``window`` bytes, and is dropped as soon as a digit leaves it alone in its
group. Three passes refine the groups, the most significant digit first:

1. the suffix's anchor: of the ``GRAM``-byte strings within its window, the one with the least hash. Suffixes in a
   row share an anchor, so one row stands for some 35 of them;
2. for suffixes whose anchor occurs in several contexts, the bytes that the ``STEP`` suffixes of like distance to the anchor have in
   common: one row for up to ``STEP`` suffixes;
3. for those still in several contexts, the whole window.

The context of a row is the bytes of all its suffixes: equal contexts are equal suffixes, one by one, and need no
further digit. What is equal in the end is a repeated window, and all but the earliest of a group are removed. Digits are 64-bit
hashes that can be compared but carry no alphabetical order, which removal does not need. Before each shuffle a task
joins what is equal in its own share, so a string that a third of all documents hold is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import mixed, ranges, table, text_or_empty

GRAM = 32
STEP = 8
CHUNK_BITS = 17
UNIT_ROWS = 1 << 20
BUCKET_BYTES = 8 << 20
LEAST = -(1 << 63)
ENTRY = np.dtype([("g", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("k1", "<i8"), ("at", "<i8"), ("n", "<i2"), ("o", "<i2"), ("multi", "i1")])
FOUND = "kind int, did long, k1 long, at long, n long, o long"
COVERED, OPEN = 0, 1


class Rolling:
    """Hashes of any substring of a chunk from sums over its prefixes, modulo 2**64."""

    def __init__(self, seed: int):
        values = mixed(np.arange(1, 259, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = values[:256]
        base = int(values[256]) | 1
        size = (1 << CHUNK_BITS) + 512
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(base, -1, 1 << 64), np.uint64)])

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefixes[end] - prefixes[start]) * self.inverse[start]


def chunks(starts: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of the joined bytes of many texts: (from, to, starts of its texts, their offsets in their document).

    ``starts`` holds where each text starts, and the end. Whole texts go together as far as a chunk
    reaches; a longer text is cut so that each of its windows lies within one chunk.
    """
    most, row, n = 1 << CHUNK_BITS, 0, len(starts) - 1
    while row < n:
        last = int(np.searchsorted(starts, starts[row] + most, "right")) - 1
        if last > row:
            yield int(starts[row]), int(starts[last]), starts[row : last + 1], np.zeros(last - row, np.int64)
            row = last
        else:
            begin, end = int(starts[row]), int(starts[row + 1])
            step = most - window
            for a in range(begin, max(begin + 1, end - window + 1), step):
                b = min(end, a + step + window - 1)
                yield a, b, np.array([a, b]), np.array([a - begin])
            row += 1


def shaped(count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Tells contexts of other numbers of suffixes, or at other distances, apart."""
    return count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def anchored(data: np.ndarray, texts: np.ndarray, rolling: Rolling, window: int) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk: (hash of the anchor, hash of its context, first window, windows, from the first to the anchor)."""
    m = len(data)
    empty = np.zeros(0, np.int64)
    if m < window:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    sums = rolling.prefixes(data)
    places = np.arange(m - GRAM + 1)
    grams = mixed((sums[GRAM:] - sums[: m - GRAM + 1]) * rolling.inverse[: m - GRAM + 1])
    low = np.uint64((1 << (CHUNK_BITS + 1)) - 1)
    least = (grams & ~low) | places.astype(np.uint64)
    span, width = window - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: m - window + 1], least[span - width : span - width + m - window + 1])
    anchor = (least & low).astype(np.int64)

    # The last window - 1 starts of every text are no windows, so those of two texts never touch.
    edges = np.zeros(m + 1, np.int64)
    np.add.at(edges, np.maximum(texts[:-1], texts[1:] - (window - 1)), 1)
    np.add.at(edges, texts[1:], -1)
    valid = np.cumsum(edges[:-1])[: m - window + 1] == 0
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(anchor)])
    kept = valid[first]
    first, count = first[kept], count[kept]
    at = anchor[first]
    context = rolling.of(sums, first, first + count - 1 + window)
    shape = shaped(count, at - first)
    return grams[at], mixed(context + shape), first, count, at - first


def earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (g, c, place); where a new (g, c) starts; which rows have an earlier equal."""
    rows = rows[np.lexsort((rows["at"], rows["k1"], rows["doc"], rows["c"], rows["g"]))]
    new = np.r_[True, (rows["g"][1:] != rows["g"][:-1]) | (rows["c"][1:] != rows["c"][:-1])]
    first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    later = (rows["doc"] != first["doc"]) | (rows["k1"] != first["k1"]) | (rows["at"] != first["at"])
    return rows, new, later


def batch_of(kind: int, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in FOUND.split(", ")]
    arrays = [np.full(len(rows), kind, np.int32), rows["doc"], rows["k1"], rows["at"], n.astype(np.int64), rows["o"].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names)


def packed(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rows by bucket of their first digit."""
    bucket = (rows["g"] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((rows["at"], rows["k1"], rows["doc"], bucket))
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
        yield int(bucket[a]), squeezed(rows[a:b])


def squeezed(rows: np.ndarray) -> bytes:
    """Rows column after column, compressed; those of a document stand together, so only their digits take room."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in ENTRY.names))


def unpacked(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        rows, at = np.empty(len(data) // ENTRY.itemsize, ENTRY), 0
        for f in ENTRY.names:
            size = len(rows) * ENTRY[f].itemsize
            rows[f] = np.frombuffer(data[at : at + size], ENTRY[f])
            at += size
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros(0, ENTRY)


class Sender:
    """What a task has found so far, joined within the task and then sent on by bucket.

    Blobs go to the bucket of their first digit; what is known already goes to any bucket and is passed through.
    """

    def __init__(self, buckets: int, window: int, single: bool):
        self.buckets, self.window, self.single = buckets, window, single
        self.parts: list[np.ndarray] = []
        self.size = self.sent = 0

    def add(self, g, c, doc, k1, at, n, o=0) -> None:
        rows = np.zeros(len(g), ENTRY)
        for name, values in (("g", g), ("c", c), ("doc", doc), ("k1", k1), ("at", at), ("n", n), ("o", o)):
            rows[name] = values
        self.parts.append(rows)
        self.size += len(rows)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows, new, later = earliest(np.concatenate(self.parts))
        self.parts, self.size = [], 0
        out: list[tuple[int, int, bytes]] = []

        def known(kind: int, found: np.ndarray) -> None:
            for a in range(0, len(found), 1 << 17):
                self.sent += 1
                bucket = int(mixed(np.array([self.sent], np.uint64) + found["k1"][a : a + 1].astype(np.uint64))[0] % np.uint64(self.buckets))
                part = found[a : a + (1 << 17)]
                out.append((bucket, 1 + kind, squeezed(part[np.lexsort((part["at"], part["k1"], part["doc"]))])))

        known(COVERED, rows[later])
        firsts = rows[new]
        if not self.single:
            start = np.flatnonzero(np.r_[True, firsts["g"][1:] != firsts["g"][:-1]])
            count = np.diff(np.r_[start, len(firsts)])
            many = np.repeat(count > 1, count)
            known(OPEN, firsts[many])
            firsts["multi"] = many
            firsts = firsts[start]  # one row tells the others that the anchor occurs here in several contexts
        out += [(bucket, 0, blob) for bucket, blob in packed(firsts, self.buckets)]
        columns = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "kind", "blob"])


def _anchors(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, sender = Rolling(0), Sender(buckets, window, single=False)
        for batch in batches:
            did, k1 = (batch.column(c).to_numpy() for c in ("did", "k1"))
            text = batch.column("text").cast(pa.large_binary())
            starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for a, b, texts, offset in chunks(starts, window):
                g, c, first, n, o = anchored(data[a:b], texts - a, rolling, window)
                if not len(g):
                    continue
                local = np.searchsorted(texts - a, first, "right") - 1
                row = np.searchsorted(starts, texts[local], "right") - 1
                sender.add(g, c, did[row], k1[row], first - (texts[local] - a) + offset[local], n, o)
                if sender.size >= UNIT_ROWS:
                    yield from sender.flush()
        yield from sender.flush()

    return run


def _refine(window: int, single: bool):
    """Groups of a bucket: windows with an earlier equal are covered; those that the next digit must tell apart stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind:
                    rows = unpacked([blob])
                    yield batch_of(kind - 1, rows, rows["n"].astype(np.int64) + (window - 1) * (kind - 1 == COVERED))
                else:
                    blobs.append(blob)
        rows = unpacked(blobs)
        if not len(rows):
            return
        order = np.argsort(rows["g"], kind="stable")
        g = rows["g"][order]
        same = np.r_[False, g[1:] == g[:-1]]
        rows = rows[order][same | np.r_[same[1:], False]]  # a suffix alone in its group is done
        if not len(rows):
            return
        multi = rows[rows["multi"] > 0]
        several = multi["g"]
        rows, new, later = earliest(rows[rows["multi"] == 0])
        if not len(rows):
            return
        yield batch_of(COVERED, rows[later], rows["n"][later].astype(np.int64) + window - 1)
        if not single:
            firsts = rows[new]
            start = np.flatnonzero(np.r_[True, firsts["g"][1:] != firsts["g"][:-1]])
            count = np.diff(np.r_[start, len(firsts)])
            firsts = firsts[np.repeat(count > 1, count) | np.isin(firsts["g"], several)]
            yield batch_of(OPEN, firsts, firsts["n"])

    return run


def _deeper(buckets: int, window: int, single: bool):
    """The next digit of the suffixes that are still open: what ``STEP`` of them have in common, or the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, sender = Rolling(1), Rolling(2), Sender(buckets, window, single)
        step = 1 << CHUNK_BITS
        for batch in batches:
            did, k1 = (batch.column(c).to_numpy() for c in ("did", "k1"))
            for row, (text, todo) in enumerate(zip(batch.column("text").to_pylist(), batch.column("open").to_pylist(), strict=True)):
                data = np.frombuffer(text.encode(), np.uint8)
                at, n, o = np.array([(x["at"], x["n"], x["o"]) for x in todo], np.int64).T
                if single:
                    first = np.unique(ranges(at, n))
                    core, count = first, np.ones(len(first), np.int64)
                else:
                    # Suffixes whose distance to the anchor is in [STEP * j, STEP * j + STEP) share the bytes from core on.
                    low, high = (o - n + 1) // STEP, o // STEP
                    j, of = ranges(low, high - low + 1), np.repeat(np.arange(len(at)), high - low + 1)
                    core = (at + o)[of] - STEP * j
                    first = np.maximum(at[of], core - STEP + 1)
                    count = np.minimum((at + n - 1)[of], core) - first + 1
                    order = np.argsort(first, kind="stable")
                    core, first, count = core[order], first[order], count[order]
                for a in range(0, len(data) - window + 1, step):
                    here = slice(*np.searchsorted(first, (a, a + step)))
                    f, c, m = first[here] - a, core[here] - a, count[here]
                    if not len(f):
                        continue
                    part = data[a : a + step + window + STEP]
                    sums = one.prefixes(part)
                    if single:
                        g, context = mixed(one.of(sums, f, f + window)), mixed(two.of(two.prefixes(part), f, f + window))
                    else:
                        g = mixed(one.of(sums, c, c + window - STEP + 1))
                        context = mixed(one.of(sums, f, f + m - 1 + window) + shaped(m, c - f))
                    sender.add(g, context, did[row], k1[row], f + a, m)
                if sender.size >= UNIT_ROWS:
                    yield from sender.flush()
        yield from sender.flush()

    return run


def grouped(rows: DataFrame, function) -> DataFrame:
    """``function`` over the blobs of each bucket."""

    def whole(group: pa.Table) -> pa.Table:
        found = list(function(iter(group.to_batches())))
        schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("did", "k1", "at", "n", "o"))])
        return pa.Table.from_batches(found, schema=schema)

    return rows.groupBy("bucket").applyInArrow(whole, FOUND)


def repeated_spans(docs: DataFrame, window: int = 100) -> tuple[DataFrame, DataFrame]:
    """The documents as (did, k1, doc_id, text), and (did, k1, at, n): bytes covered by a window that starts earlier too.

    Earlier is a smaller doc_id, then within the document an earlier start; a null id is the smallest, and of different texts with one id
    the order is that of their hashes. Rows that repeat id and text are one document. Texts are bytes in UTF-8, null as empty;
    texts of fewer than ``window`` bytes hold no window. Spans may overlap and are judged on the input.
    """
    if window < 2 * GRAM:
        raise ValueError(f"the threshold must be at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, size // BUCKET_BYTES)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    # One exchange of the texts, which the passes below and the removal all read.
    rows = docs.select(did.alias("did"), F.xxhash64("doc_id", "text").alias("k1"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartition(partitions, "did", "k1")
    blob = "bucket int, kind int, blob binary"
    found = grouped(rows.mapInArrow(_anchors(buckets, window), blob), _refine(window, single=False))
    spans = found.where(F.col("kind") == COVERED)
    for single in (False, True):
        still = found.where(F.col("kind") == OPEN).groupBy("did", "k1").agg(F.collect_list(F.struct("at", "n", "o")).alias("open"))
        deeper = rows.join(still, ["did", "k1"]).mapInArrow(_deeper(buckets, window, single), blob)
        found = grouped(deeper, _refine(window, single))
        spans = spans.unionByName(found.where(F.col("kind") == COVERED))
    return rows, spans.select("did", "k1", "at", "n")


def _remove(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, removed, runs = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                sizes.append(len(data))
                kept, lost, count, at = [], 0, 0, 0
                for start, n in sorted((x["at"], x["n"]) for x in spans or ()):
                    if start > at or not count:
                        kept.append(data[at:start])
                        count, at = count + 1, max(at, start)
                    lost += max(0, start + n - at)
                    at = max(at, start + n)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append(hashlib.sha256(left).hexdigest() if digest else left)
                removed.append(lost)
                runs.append(count)
            arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)),
                      pa.array(out, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 100, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: the bytes without repeats, or their SHA-256.

    See ``repeated_spans`` for what is a repeat, and for nulls, ties and repeated rows. Bytes are cut
    without regard to characters. An empty table gives an empty result; further columns are not read.
    """
    rows, spans = repeated_spans(docs, window)
    spans = spans.groupBy("did", "k1").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = rows.join(spans, ["did", "k1"], "left").select("doc_id", "text", "spans")
    kind = "string" if digest else "binary"
    return joined.mapInArrow(_remove(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
