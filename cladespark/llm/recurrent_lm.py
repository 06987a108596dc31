"""A gated recurrent language model over words, trained and applied in numpy within Spark tasks.

The output is factored: P(token) = P(class | state) * P(token | class, state). The most frequent tokens have classes of
``PER_CLASS`` members with a softmax each; all other words fall into ``TAILS`` classes by how they end, and share
their class by their counts in the corpus. Those counts meet the words in a join, so the vocabulary has no bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import CRC_STEPS, blocks, most_frequent, stored, table, text_or_empty, words

HEAD = 1024
PER_CLASS = 32
TAILS = 32
HIDDEN = 16
LOOKUP = 1 << 18
END = b""  # no word is empty
CHUNK = 1 << 16


def held_out() -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def tails_of(words: list[bytes]) -> np.ndarray:
    """``tail_of`` of each word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts, data = np.r_[0, ends[:-1]], np.frombuffer(b"".join(words), np.uint8)
    register = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        rows = np.flatnonzero(ends - back >= starts)
        now = register[rows]
        register[rows] = CRC_STEPS[(now ^ data[ends[rows] - back]) & np.uint32(255)] ^ (now >> np.uint32(8))
    return (~register % np.uint32(TAILS)).astype(np.int32)


def hash_of(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Vocabulary:
    """The bounded part of the vocabulary, with counts over all training tokens."""

    head: list[bytes]  # most frequent first
    counts: dict[bytes, int]  # of the ``LOOKUP`` most frequent tokens, the head among them
    tokens: int  # N
    distinct: int  # V
    tail_mass: np.ndarray  # training tokens + distinct words + 1 of each tail class

    def __post_init__(self):
        self.at = {w: i for i, w in enumerate(self.head)}
        self.classes = -(-len(self.head) // PER_CLASS)

    def code(self, word: bytes) -> int:
        """The input of a token: its place in the head, or behind it the tail class."""
        place = self.at.get(word)
        return len(self.head) + tail_of(word) if place is None else place

    def codes(self, words: list[bytes]) -> np.ndarray:
        """``code`` of each word."""
        place = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        return np.where(place < 0, len(self.head) + tails_of(words), place).astype(np.int32)


def initial(vocabulary: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the counts, so the untrained model is the unigram one."""
    rng, head = np.random.default_rng(seed), len(vocabulary.head)
    counts = np.array([vocabulary.counts[w] for w in vocabulary.head], float) + 1
    padded = np.zeros(vocabulary.classes * PER_CLASS)
    padded[:head] = counts
    members = padded.reshape(-1, PER_CLASS)
    mass = np.r_[members.sum(1), vocabulary.tail_mass]
    inner = np.where(members > 0, np.log(np.maximum(members, 1e-9)), -1e9)
    scale = 1 / np.sqrt(HIDDEN)
    return {
        "embed": rng.normal(0, scale, (head + TAILS, HIDDEN)),
        "w": rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)),
        "u": rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)),
        "b": np.zeros(3 * HIDDEN),
        "class_w": np.zeros((HIDDEN, len(mass))),
        "class_b": np.log(mass / mass.sum()),
        "inner_w": np.zeros((vocabulary.classes, HIDDEN, PER_CLASS)),
        "inner_b": inner.reshape(-1, PER_CLASS),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax_of(x: np.ndarray) -> np.ndarray:
    """The softmax of each row."""
    return column_softmax(np.array(x.T)).T


def column_softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each column, in place: sums over rows run along the memory."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step: (new state, update gate, reset gate, candidate, recurrent part of the candidate)."""
    k = h.shape[1]
    r = h @ p["u"]
    gates = sigmoid(x[:, : 2 * k] + r[:, : 2 * k])
    z, reset = gates[:, :k], gates[:, k:]
    c = np.tanh(x[:, 2 * k :] + reset * r[:, 2 * k :])
    return h + z * (c - h), z, reset, c, r[:, 2 * k :]


def class_of(codes: np.ndarray, head: int, classes: int) -> np.ndarray:
    return np.where(codes < head, codes // PER_CLASS, classes + codes - head)


class Scorer:
    """log10 probabilities of whole documents, all of a block's documents one step at a time."""

    def __init__(self, params: dict[str, np.ndarray], vocabulary: Vocabulary, window: int = 32):
        self.p = {k: v.astype(np.float32) for k, v in params.items()}
        self.head, self.classes, self.window = len(vocabulary.head), vocabulary.classes, window
        self.inputs = self.p["embed"] @ self.p["w"] + self.p["b"]
        self.tail_log = np.log(vocabulary.tail_mass)

    def emitted(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """log P of each code after its state; of a tail word without its count."""
        out = np.empty(len(codes))
        for a in range(0, len(codes), CHUNK):
            h, code = states[a : a + CHUNK], codes[a : a + CHUNK]
            kind = class_of(code, self.head, self.classes)
            logits = self.p["class_w"].T @ h.T + self.p["class_b"][:, None]
            logits -= logits.max(0)
            part = logits[kind, np.arange(len(code))].astype(float)
            part -= np.log(np.exp(logits, out=logits).sum(0))
            tail = code >= self.head
            part[tail] -= self.tail_log[code[tail] - self.head]
            order = np.argsort(kind.astype(np.int16), kind="stable")
            cuts = np.searchsorted(kind[order], np.arange(self.classes + 1))
            for c in range(self.classes):
                rows = order[cuts[c] : cuts[c + 1]]
                if len(rows):
                    inner = self.p["inner_w"][c].T @ h[rows].T + self.p["inner_b"][c][:, None]
                    inner -= inner.max(0)
                    own = inner[code[rows] % PER_CLASS, np.arange(len(rows))]
                    part[rows] += own - np.log(np.exp(inner, out=inner).sum(0))
            out[a : a + CHUNK] = part
        return out

    def documents(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The sum for each document; its state goes from window to window, and starts at zero."""
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        total = np.zeros(len(order))
        state = np.zeros((len(order), HIDDEN), np.float32)
        begin = 0
        while len(sizes) and begin < sizes[0]:
            states, targets, rows = [], [], []
            for t in range(begin, min(begin + self.window, int(sizes[0]))):
                live = int(np.searchsorted(-sizes, -t, "left"))  # documents with more than t tokens
                now = codes[starts[:live] + t]
                states.append(state[:live].copy())
                targets.append(now)
                rows.append(np.arange(live))
                state[:live] = step(self.p, self.inputs[now], state[:live])[0]
            begin += self.window
            rows = np.concatenate(rows)
            total += np.bincount(rows, weights=self.emitted(np.concatenate(states), np.concatenate(targets)), minlength=len(total))
        out = np.empty(len(order))
        out[order] = total / np.log(10)
        return out


class Trainer:
    """Truncated backpropagation: windows of ``steps`` tokens in ``lanes`` streams, the state carried from one to the next."""

    def __init__(self, params: dict[str, np.ndarray], head: int, classes: int, rate: float, steps: int = 16):
        self.p = {k: v.copy() for k, v in params.items()}
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.head, self.classes, self.rate, self.steps, self.updates = head, classes, rate, steps, 0

    def gradients(self, codes: np.ndarray, fresh: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The state after a window of codes (steps, lanes), and the gradient of its summed negative log probability.

        ``fresh`` marks first tokens of documents, which start from zero. Where ``live`` is false there is no token but
        padding behind the last one of a lane, and nothing is learned from it.
        """
        p, k, n = self.p, h.shape[1], codes.size
        grads = {}
        code, begins = codes.reshape(-1), fresh.any(1)
        x = p["embed"][code]
        ahead = (x @ p["w"] + p["b"]).reshape(*codes.shape, 3 * k)
        tape, states = [], np.empty((*codes.shape, k), h.dtype)
        for t in range(len(codes)):
            if begins[t]:
                h = np.where(fresh[t][:, None], h.dtype.type(0), h)
            states[t] = h
            h, *rest = step(p, ahead[t], h)
            tape.append(rest)

        flat = states.reshape(-1, k)
        kind = class_of(code, self.head, self.classes)
        error = column_softmax(p["class_w"].T @ flat.T + p["class_b"][:, None])
        error[kind, np.arange(n)] -= 1
        if live is not None:
            error[:, ~live.reshape(-1)] = 0
            kind = np.where(live.reshape(-1), kind, len(p["class_b"]))
        grads["class_w"], grads["class_b"] = (error @ flat).T, error.sum(1)
        to_state = (p["class_w"] @ error).T.copy()

        # The members of a class lie side by side, so that all classes share one softmax.
        rows = np.argsort(kind.astype(np.int16), kind="stable")
        cuts = np.searchsorted(kind[rows], np.arange(self.classes + 1))
        rows = rows[: cuts[-1]]
        inside, used = flat[rows], np.flatnonzero(cuts[1:] > cuts[:-1])
        inner = np.empty((PER_CLASS, len(rows)), h.dtype)
        for c in used:
            part = slice(cuts[c], cuts[c + 1])
            np.add(p["inner_w"][c].T @ inside[part].T, p["inner_b"][c][:, None], out=inner[:, part])
        inner = column_softmax(inner)
        inner[code[rows] % PER_CLASS, np.arange(len(rows))] -= 1
        back = np.empty_like(inside)
        grads["inner_w"], grads["inner_b"] = np.zeros_like(p["inner_w"]), np.zeros_like(p["inner_b"])
        for c in used:
            part = slice(cuts[c], cuts[c + 1])
            grads["inner_w"][c] = (inner[:, part] @ inside[part]).T
            back[part] = (p["inner_w"][c] @ inner[:, part]).T
        if len(used):
            grads["inner_b"][used] = np.add.reduceat(inner, cuts[used], axis=1).T
        to_state[rows] += back
        to_state = to_state.reshape(states.shape)

        into_u, into_x = np.empty((2, *codes.shape, 3 * k), h.dtype)
        back_u, dh = p["u"].T, np.zeros_like(h)  # nothing comes back from beyond the window
        for t in range(len(codes) - 1, -1, -1):
            z, reset, c, r = tape[t]
            dc = dh * z * (1 - c * c)
            into_x[t, :, :k] = dh * (c - states[t]) * z * (1 - z)
            into_x[t, :, k : 2 * k] = dc * r * reset * (1 - reset)
            into_x[t, :, 2 * k :] = dc
            into_u[t, :, : 2 * k] = into_x[t, :, : 2 * k]
            into_u[t, :, 2 * k :] = dc * reset
            dh = dh * (1 - z) + into_u[t] @ back_u + to_state[t]
            if begins[t]:
                dh[fresh[t]] = 0
        into_u, into_x = into_u.reshape(n, -1), into_x.reshape(n, -1)
        grads["u"], grads["w"], grads["b"] = flat.T @ into_u, x.T @ into_x, into_x.sum(0)
        grads["embed"] = np.zeros_like(p["embed"])
        at = code[:, None].astype(np.int64) * k + np.arange(k)
        np.add.at(grads["embed"].reshape(-1), at.reshape(-1), (into_x @ p["w"].T).reshape(-1))
        return h, grads

    def update(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.updates += 1
        for name, g in grads.items():
            g = g / n
            self.m[name] = 0.9 * self.m[name] + 0.1 * g
            self.v[name] = 0.99 * self.v[name] + 0.01 * g * g
            m, v = self.m[name] / (1 - 0.9**self.updates), self.v[name] / (1 - 0.99**self.updates)
            self.p[name] -= self.rate * m / (np.sqrt(v) + 1e-8)

    def stream(self, codes: np.ndarray, fresh: np.ndarray, lanes: int) -> int:
        """Learn from a long row of tokens, cut into lanes; how many were used, which is all of them.

        The lanes are padded to one length, and the last window may have fewer steps.
        """
        length = -(-len(codes) // lanes)
        live = np.arange(length * lanes) < len(codes)
        codes, fresh, live = (np.pad(x, (0, length * lanes - len(x))).reshape(lanes, length).T for x in (codes, fresh, live))
        h = np.zeros((lanes, HIDDEN), self.p["b"].dtype)
        for t in range(0, length, self.steps):
            now = live[t : t + self.steps]
            h, grads = self.gradients(codes[t : t + self.steps], fresh[t : t + self.steps], h, None if now.all() else now)
            self.update(grads, int(now.sum()))
        return int(live.sum())


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


# ---- the corpus ----


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) over each block of a task's texts; the end counts once a document."""
    for batch in blocks(batches):
        _, codes, known = words(batch.column("text"))
        counts = np.bincount(codes, minlength=len(known))
        held = np.flatnonzero(counts)
        names = pa.concat_arrays([pa.array(known, pa.binary()).take(pa.array(held)), pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[counts[held], batch.num_rows].astype(np.int64))], ["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, hash, tail) of every distinct token of ``docs`` (text), stored."""
    counts = docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ending = F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")
    return stored(counts.select("word", "n", F.xxhash64(F.col("word")).alias("hash"), (F.crc32(ending) % TAILS).alias("tail")), "word-counts")


def vocabulary_of(counts: DataFrame, head: int = HEAD, lookup: int = LOOKUP) -> Vocabulary:
    """The bounded vocabulary: ``head`` and ``lookup`` bound what leaves the counts, which cover all tokens.

    The lookup holds the words of at least some count, and some of those just below it; the head is the most frequent of them. The
    end is in both, whatever its count.
    """
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = most_frequent(counts, "n", lookup).select("word", "n").toArrow()
    order = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    first = {word: n for n, word in order} | {END: ends}
    top = [word for _, word in order[:head]]
    if END not in top:
        top = [*top[: head - 1], END]
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mass = np.ones(TAILS)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["tail"]] += r["n"] + r["v"]
    for word in top:
        if word != END or first[END]:
            mass[tail_of(word)] -= first[word] + 1
    return Vocabulary(top, first, totals[0], totals[1], mass)


def _train(params: dict[str, np.ndarray], vocabulary: Vocabulary, rate: float, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = {k: v.astype(np.float32) for k, v in params.items()}
        trainer, used = Trainer(small, len(vocabulary.head), vocabulary.classes, rate), 0
        for batch in blocks(batches, limit=4 << 20):
            codes, starts, _ = encoded(batch.column("text"), vocabulary)[:3]
            fresh = np.zeros(len(codes), bool)
            fresh[starts] = True
            used += trainer.stream(codes, fresh, max(1, min(lanes, len(codes) // (4 * trainer.steps))))
        if used:
            values = flat(trainer.p).astype(float)
            at = np.arange(len(values), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values * used), pa.array(np.full(len(at), used, np.int64))], ["at", "value", "used"])

    return run


def train(docs: DataFrame, vocabulary: Vocabulary, share: int = 2, rounds: int = 2, rate: float = 0.01, lanes: int = 128) -> dict[str, np.ndarray]:
    """Weights from ``docs`` (doc_id, text): each round every task trains on its part, and the parts' weights are averaged.

    A round uses one in ``share`` of the documents by hash of the id, whole and others each time; with as many rounds as shares every token of every
    document is learned from once. Only the averages, whose number is that of the weights, reach the driver.
    """
    params = initial(vocabulary)
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(share))
    for r in range(rounds):
        sums = docs.where(part == r % share).select("text").mapInArrow(_train(params, vocabulary, rate, lanes), "at int, value double, used long")
        found = sums.groupBy("at").agg((F.sum("value") / F.sum("used")).alias("value")).collect()
        if not found:
            continue
        values = flat(params)
        for row in found:
            values[row["at"]] = row["value"]
        params = unflat(values, params)
    return params


def encoded(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Input codes with an end after each text, starts and lengths, and the word of each code's place (the end's is the last)."""
    offsets, numbers, known = words(texts)
    known = [*known, END]
    code = vocabulary.codes(known)
    numbers = np.insert(numbers.astype(np.int32), offsets[1:], len(known) - 1)
    starts = offsets[:-1] + np.arange(len(texts))
    lengths = np.diff(offsets) + 1
    return code[numbers], starts, lengths, numbers, known


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, model double, hashes array<long>, times array<int>"


def _score(params: dict[str, np.ndarray], shared_vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared_vocabulary.value
        scorer, row = Scorer(params, vocabulary), TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in SCORED.split(", ")]
        for batch in blocks(batches):
            if not batch.num_rows:
                continue
            codes, starts, lengths, numbers, known = encoded(batch.column("text"), vocabulary)
            model = scorer.documents(codes, starts, lengths)
            count = np.fromiter(map(vocabulary.counts.get, known, repeat(-1)), np.int64, len(known))
            count[-1] = vocabulary.counts[END]
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            c = count[numbers]
            here = c >= 0
            logs = np.log10(np.maximum(c, 0) + 1.0)
            # A tail word's count is what the model lacks as well; the head's is in its weights already.
            tail = codes >= len(vocabulary.head)
            base = np.bincount(doc, weights=np.where(here, logs, 0), minlength=len(lengths))
            model += np.bincount(doc, weights=np.where(here & tail, logs, 0), minlength=len(lengths))
            n_known = np.bincount(doc, weights=c > 0, minlength=len(lengths)).astype(np.int64)
            away = np.flatnonzero(~here)
            pair, times = np.unique(doc[away].astype(np.int64) * len(known) + numbers[away], return_counts=True)
            of, word = pair // len(known), pair % len(known)
            digest = np.zeros(len(known), np.int64)
            needed = np.unique(word)
            digest[needed] = [hash_of(known[i]) for i in needed]
            cuts = pa.array(np.searchsorted(of, np.arange(len(lengths) + 1)).astype(np.int32))
            arrays = [pa.array(row + np.arange(len(lengths))), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(n_known), pa.array(base),
                      pa.array(model), pa.ListArray.from_arrays(cuts, pa.array(digest[word])), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))]
            row += len(lengths)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def score_documents(docs: DataFrame, head: int = HEAD, lookup: int = LOOKUP, **training) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words between ASCII white space, A-Z in lower case, and one end. Counts, vocabulary and weights come from the
    documents that are not held out, all counts from all of them. ``base_score`` is the add-one unigram log10 probability and ``score`` the model's,
    both of the whole text; every token has a probability, one never seen too: that of the one unseen word of its class.

    Null and empty texts are an end alone. Rows that repeat are scored, and counted, each on their own; rows with null ids are
    held out. With no training documents the counts are empty and the weights random. An empty table gives an empty
    result; further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    learned = rows.where(~F.col("held_out"))
    counts = count_words(learned)
    vocabulary = vocabulary_of(counts, head, lookup)
    params = train(learned, vocabulary, **training)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    scored = stored(rows.mapInArrow(_score(params, shared_vocabulary), SCORED), "lm-scores")

    # Words beyond the lookup meet their counts here; those the corpus lacks add nothing.
    pairs = scored.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("x")).select("row", F.col("x.hashes").alias("hash"), F.col("x.times").alias("times"))
    met = pairs.join(counts.select("hash", "n"), "hash")
    met = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum("times").alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("hashes", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
