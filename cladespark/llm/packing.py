"""Token sequences of fixed length by minimum bin slack: each takes the lengths left over that fill it best."""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import blocks, ranges, stored, table, text_or_empty

END_ID = 0
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NEW, ODD = -1, -2
CACHE_UNITS, CACHE_IDS, LEARN_UNITS, JOINED_UNITS = 250_000, 8 << 20, 2048, 64
SPACE_MARKS = "\u0120\u010a"  # how byte-level vocabularies write a space and a new line
BLOCK_BYTES = 6 << 20


class Units:
    """Token ids of texts by way of their units, the stretches between single spaces or before a new line.

    A byte-level pattern tokenizer never joins anything over a single space that stands between
    two visible characters, nor over one new line, so a text's ids are those of its
    units in a row and a unit need be tokenized once. Texts in which white space meets
    white space are tokenized whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with the mark of a space or a new line
        self.opens[[i for token, i in vocabulary.items() if token[0] in SPACE_MARKS]] = True
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}  # number of a unit that follows another; ODD for white space at its ends
        self.first: dict[str, int] = {}  # number of a unit that begins a text
        self.ids, self.ends = array("i"), array("q", [0])  # the ids of all units in a row, and where each unit's end

    def _learn(self, units: list[str]) -> range:
        """The numbers of units that are tokenized now; encodings are large, so only some at a time."""
        base = len(self.ends)
        for a in range(0, len(units), LEARN_UNITS):
            for encoded in self.tokenizer.encode_batch_fast(units[a : a + LEARN_UNITS], add_special_tokens=False):
                self.ids.extend(encoded.ids)
                self.ends.append(len(self.ids))
        return range(base, len(self.ends))

    def _learn_following(self, units: list[str]) -> range:
        """As ``_learn`` for visible units with the space or new line before them, many in one text.

        Only the first id of such a unit begins with a space or a new line, which tells the units apart. Where a
        special token may lie in one, or the count does not fit, units are tokenized one by one.
        """
        base = len(self.ends)
        for a in range(0, len(units), LEARN_UNITS):
            some = units[a : a + LEARN_UNITS]
            texts = ["".join(some[i : i + JOINED_UNITS]) for i in range(0, len(some), JOINED_UNITS)]
            ids = [] if any("<|" in t for t in texts) else self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in ids]) if ids else np.zeros(0, np.int32)
            firsts = np.flatnonzero(self.opens[ids])
            if len(firsts) != len(some) or firsts[0]:
                self._learn(some)
                continue
            ends = np.r_[firsts[1:], len(ids)] + len(self.ids)
            self.ids.frombytes(ids.tobytes())
            self.ends.frombytes(ends.astype(np.int64).tobytes())
        return range(base, len(self.ends))

    def _following(self, units: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.inner.get, units, repeat(NEW)), np.int64, len(units))
        new = [units[i] for i in np.flatnonzero(found == NEW)]
        # A visible unit has no white space at its ends, but for the one new line that may open it.
        odd = [not u or u == "\n" or u[-1].isspace() or u[u[0] == "\n"].isspace() for u in new]
        self.inner.update((u, ODD) for u, is_odd in zip(new, odd, strict=True) if is_odd)
        plain = [u for u, is_odd in zip(new, odd, strict=True) if not is_odd]
        self.inner.update(zip(plain, self._learn_following([u if u[0] == "\n" else " " + u for u in plain]), strict=True))
        found[found == NEW] = [self.inner[u] for u in new]
        return found

    def _beginning(self, units: list[str]) -> list[int]:
        new = [u for u in dict.fromkeys(units) if u not in self.first]
        self.first.update(zip(new, self._learn(new), strict=True))
        return [self.first[u] for u in units]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if len(self.inner) + len(self.first) > CACHE_UNITS or len(self.ids) > CACHE_IDS:
            self.clear()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        codes, known = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
        numbers = self._following(known)[codes]
        per_text = np.add.reduceat(numbers == ODD, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        starts = offsets[:-1]
        plain, whole = np.flatnonzero(per_text == 0), np.flatnonzero(per_text)
        begun = self._beginning([known[i] for i in codes[starts[plain]]])
        if len(whole):
            numbers[np.repeat(per_text > 0, np.diff(offsets))] = 0  # the empty entry
            numbers[starts[whole]] = self._learn([texts[i].as_py() for i in whole])  # not kept by name
        numbers[starts[plain]] = begun
        ids, ends = np.array(self.ids, np.int32), np.array(self.ends, np.int64)
        begins = np.r_[0, ends[:-1]]
        lengths = (ends - begins)[numbers]
        per_text = np.add.reduceat(lengths, starts) if len(texts) else np.zeros(0, np.int64)
        return ids[ranges(begins[numbers], lengths)], per_text


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        units = Units(Tokenizer.from_file(path))
        narrow = "<u2" if len(units.opens) <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in blocks(batches, limit=BLOCK_BYTES):
            if not batch.num_rows:
                continue
            ids, counts = units.encode(batch.column("text"))
            ends = np.cumsum(counts)
            data = np.insert(ids, ends, END_ID).astype("<u4")
            tokens = counts + 1
            firsts = np.cumsum(tokens) - tokens
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = ranges(np.zeros(len(tokens), np.int64), pieces) * capacity
            length = np.minimum(capacity, tokens[doc] - start)
            view = memoryview(data).cast("B")
            at = firsts[doc] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            # A full piece is never cut, so its ids are not needed again.
            again = [data[a:b].astype(narrow).tobytes() if b - a < capacity else None for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            group = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            size = np.diff(np.r_[group, len(by)])
            rank = np.empty(len(by), np.int64)
            rank[order] = ranges(ranks[by[group]], size)
            ranks[by[group]] += size
            arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)),
                      pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), pa.array(again, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECES.split(", ")])

    return run


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths that comes closest to the capacity, as a count for each length.

    A subset-sum over bitsets: bit s of ``reach[i]`` says that the first i lengths, none used beyond its
    count, can sum to s. Counts enter in powers of two, so each length takes a few
    shifts. The best sum is walked back to how often each length is in it.
    """
    mask = (1 << (capacity + 1)) - 1
    lengths = sorted((n for n, count in left.items() if count), reverse=True)
    reach = [1]
    for n in lengths:
        bits, count, chunk = reach[-1], min(left[n], capacity // n), 1
        while count:
            take = min(chunk, count)
            bits |= (bits << (n * take)) & mask
            count, chunk = count - take, chunk * 2
        reach.append(bits)
        if bits >> capacity & 1:  # longer lengths alone fill it
            break
    chosen, rest = {}, reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        n, count = lengths[i - 1], 0
        while not reach[i - 1] >> rest & 1:
            rest, count = rest - n, count + 1
        if count:
            chosen[n] = count
    return chosen


@dataclass(frozen=True)
class Run:
    """Pieces of one length and of neighbouring ranks that go to neighbouring sequences, or the same part of each."""

    length: int  # of the whole pieces
    rank: int
    pieces: int
    per: int  # in each sequence
    sequence: int
    offset: int
    begin: int  # the part: where it begins in the piece, and its size
    size: int


class Stock:
    """What is left to pack, by size: stretches of equal pieces, or of equal parts of pieces that were cut."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.stretches = {n: deque([(n, 0, count, 0)]) for n, count in counts.items()}

    def take(self, size: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """``count`` pieces of a size, as stretches (length, first rank, pieces, begin)."""
        self.left[size] -= count
        while count:
            length, rank, pieces, begin = self.stretches[size].popleft()
            used = min(count, pieces)
            if used < pieces:
                self.stretches[size].appendleft((length, rank + used, pieces - used, begin))
            yield length, rank, used, begin
            count -= used

    def put(self, size: int, stretch: tuple[int, int, int, int]) -> None:
        self.left[size] = self.left.get(size, 0) + stretch[2]
        self.stretches.setdefault(size, deque()).append(stretch)


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Which sequence takes which pieces, from how many there are of each length.

    Every filling is repeated as long as what it needs lasts, so there are about as many fillings as lengths, whatever
    the number of pieces. Where the best filling leaves slack, all other pieces are longer than the slack; one more of
    them in each sequence is cut to close it, and the rest of it is left to pack. Only the last sequence stays short.
    """
    stock, out, sequence = Stock(counts), [], 0
    while any(stock.left.values()):
        chosen = fill(stock.left, capacity)
        slack = capacity - sum(n * count for n, count in chosen.items())
        times = min(stock.left[n] // count for n, count in chosen.items())
        cut = None
        if slack:
            spare = {n: count // (chosen.get(n, 0) + 1) for n, count in stock.left.items() if n > slack}
            cut = max(spare, key=lambda n: (spare[n], n), default=None)
            cut = cut if cut and spare[cut] else None
            times = min(times, spare[cut]) if cut else 1
        offset = 0
        for n, count in sorted(chosen.items(), reverse=True):
            done = 0
            for length, rank, pieces, begin in stock.take(n, times * count):
                out += split(Run(length, rank, pieces, count, sequence, offset, begin, n), done)
                done += pieces
            offset += n * count
        if cut:
            done = 0
            for length, rank, pieces, begin in list(stock.take(cut, times)):
                out += split(Run(length, rank, pieces, 1, sequence, offset, begin, slack), done)
                stock.put(cut - slack, (length, rank, pieces, begin + slack))
                done += pieces
        sequence += times
    return out


def split(run: Run, done: int) -> list[Run]:
    """A stretch that starts as the piece ``done`` of its filling, cut so that each part begins a sequence or lies in one."""
    out, rank, left = [], run.rank, run.pieces
    while left:
        sequence, nth = run.sequence + done // run.per, done % run.per
        whole = left // run.per * run.per
        take = whole if not nth and whole else min(left, run.per - nth)
        out.append(replace(run, rank=rank, pieces=take, sequence=sequence, offset=run.offset + nth * run.size))
        rank, left, done = rank + take, left - take, done + take
    return out


def _place(plan_: list[Run]):
    shift = 1 << 48  # ranks stay below
    layers: dict[tuple[int, int], list[Run]] = {}
    for run in plan_:
        layers.setdefault((run.length, run.begin) if run.begin or run.size < run.length else (0, 0), []).append(run)
    tables = {}
    for layer, members in layers.items():
        members.sort(key=lambda r: (r.length, r.rank))
        tables[layer] = np.array([(r.length * shift + r.rank, r.pieces, r.per, r.sequence, r.offset, r.begin, r.size) for r in members], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            present = set(np.unique(length).tolist()) | {0}
            for (only, _), table_ in tables.items():
                if only not in present:
                    continue
                key = length * shift + rank
                at = np.searchsorted(table_[:, 0], key, "right") - 1
                nth = key - table_[at, 0]
                rows = np.flatnonzero((at >= 0) & (nth < table_[at, 1]))
                if not len(rows):
                    continue
                at, nth = at[rows], nth[rows]
                _, _, per, sequence, offset, begin, size = table_[at].T
                part = batch.take(pa.array(rows))
                crc = part.column("ids_crc32")
                if only:
                    width = len(part.column("ids")[0].as_py()) // only
                    kind = np.dtype(f"<u{width}")
                    crc = pa.array([zlib.crc32(np.frombuffer(ids, kind)[b : b + n].astype("<u4").tobytes())
                                    for ids, b, n in zip(part.column("ids").to_pylist(), begin.tolist(), size.tolist(), strict=True)], pa.int64())
                arrays = [part.column("doc_id"), pa.array(part.column("start").to_numpy() + begin), pa.array(size), crc, part.column("doc_tokens"),
                          pa.array(sequence + nth // per), pa.array(offset + nth % per * size)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PACKED.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Where every piece of every document lies: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its token ids and one end id, cut at every ``capacity`` ids. The lengths of all pieces are
    counted (``capacity`` rows at most), the fillings are planned on these counts, and every piece finds its sequence by its rank
    among the pieces of its length. What is left over of a document is cut again only where that closes a sequence, so
    all sequences are full but for the last; that one is padded, unless it ends at a power of two. Ranks come from each task's own counts and the sums of the tasks
    before it, so no length is gathered anywhere.

    Null or empty texts are one piece that holds the end id. Rows that repeat are packed each
    on their own; a null doc_id stays null. An empty table gives an empty result. ``tokenizer``
    is a file that every executor can read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, capacity), PIECES), "pieces")
    counts = stored(pieces.groupBy("part", "length").count(), "piece-counts")
    left = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(earlier, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids").mapInArrow(_place(plan(left, capacity)), PACKED)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
