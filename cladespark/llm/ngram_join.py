"""Documents linked by the Jaccard similarity of their word shingles: prefix filters under several token orders.

Equal shingle sets are one node, so copies are never compared. Under any order of all tokens two similar sets
share tokens among the first (1 - threshold) of their own; a prefix longer by a tenth must share a tenth as well, which
passages that unlike documents share do not reach. Each of the ``ORDERS`` puts frequent tokens last and
the others by another hash; a pair is verified only if it passes under every order. Links between many alike nodes
are found without listing pairs within a group: nodes are first compared with the leaders of the tokens they share, which also
gathers them in clusters; then, in blocks of sets, with the rest of their cluster, unless they lie in its largest component
already; and last with other clusters that they share enough tokens with, of which those in the fewest clusters are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import KEY, attach, blocks, keyed, mixed, most_frequent, runs, stored, table, words
from cladespark.llm.components import components

ORDERS = 2
EXTRA = 10
SOME = 4
BLOCK_SETS = 64
BLOCK_BYTES = 4 << 20
TEXT_BYTES = 2 << 20
FREQUENT_TOKENS = 1 << 16
FREQUENT_IN_UNIT = 4
UNIT_TOKENS = 1 << 20
BUCKET_BYTES = 16 << 20
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SALTS = mixed(np.arange(101, 101 + ORDERS, dtype=np.uint64))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct hashed shingles of every text, sorted; shorter texts are one shingle, and none without words."""
    offsets, codes, known = words(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        rolled += hashes[i : i + len(rolled)] * FACTORS[i]
    rolled = mixed(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            short = (hashes[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mixed(short + FACTORS[size + b - a])
        else:
            yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """A hash of a set of tokens as a signed long."""
    total = mixed(tokens + np.uint64(17)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + np.uint64(len(tokens))).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n to look at: with o shared ones, the first n - o + l tokens of either set share l."""
    return n - -(-percent * n // 100) + 1 + n // EXTRA


def least_shared(percent: int) -> Column:
    """How many of its prefix's tokens a set of ``n`` shares with any similar set, which has ``percent`` of n tokens at least."""
    return 1 + F.expr(f"({percent} * n + 99) div 100 div {EXTRA}")


def least_between(percent: int) -> Column:
    """The same for similar sets of ``low`` to ``high`` tokens, which is far more where their sizes are near ``n``.

    Two similar sets share at least ``percent`` / (100 + ``percent``) of their sizes together, and of these all but what the rest of
    either set, beyond its prefix, can hold. That is concave in the other's size, so the least is at an end of the range. One in
    a thousand is given away for tokens of a set that are equal once they are cut.
    """
    n = F.col("n").cast("double")

    def with_size(size: Column) -> Column:
        rest = F.greatest(n, size) * (percent / 100 - 1 / EXTRA) + 1
        return (n + size) * percent / (100 + percent) - F.greatest(rest, F.lit(0.0)) - n / 1000

    low, high = F.greatest(F.col("low").cast("double"), n * percent / 100), F.least(F.col("high").cast("double"), n * 100 / percent)
    return F.greatest(least_shared(percent), F.floor(F.least(with_size(low), with_size(high))))


class Frequent:
    """The frequent tokens with their ranks, the most frequent last. Which they are changes the work, not the results."""

    def __init__(self, tokens: np.ndarray):
        self.order = np.argsort(tokens)
        self.tokens = tokens[self.order]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(tokens & np.uint64(len(self.marks) - 1)).astype(np.int64)] = True

    def prefix(self, tokens: np.ndarray, order: int, size: int) -> np.ndarray:
        """The first ``size`` tokens under an order."""
        keys = mixed(tokens ^ SALTS[order]) >> np.uint64(1)
        maybe = np.flatnonzero(self.marks[(tokens & np.uint64(len(self.marks) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.tokens, tokens[maybe])
            at[at == len(self.tokens)] = 0
            hit = self.tokens[at] == tokens[maybe]
            keys[maybe[hit]] = np.uint64(1 << 63) + self.order[at[hit]].astype(np.uint64)
        if size >= len(tokens):
            return tokens
        return tokens[np.argpartition(keys, size - 1)[:size]]


SETS = "kind int, doc_id long, k1 long, k2 long, node long, n long"


def _nodes(size: int):
    """Rows of documents with their node (kind 0), and of tokens frequent within a task's unit (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SETS.split(", ")]
        unit: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(unit), return_counts=True) if unit else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = counts >= FREQUENT_IN_UNIT
            tokens, counts = tokens[some].view(np.int64), counts[some].astype(np.int64)
            none = pa.nulls(len(tokens), pa.int64())
            arrays = [pa.array(np.ones(len(tokens), np.int32)), none, none, none, pa.array(tokens), pa.array(counts)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in blocks(batches, limit=TEXT_BYTES):
            nodes, sizes = [], []
            for tokens in shingle_sets(batch.column("text"), size):
                nodes.append(node_of(tokens))
                sizes.append(len(tokens))
                unit.append(tokens)
                held += len(tokens)
            arrays = [pa.array(np.zeros(len(nodes), np.int32)), *(batch.column(c) for c in ("doc_id", *KEY)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)
            if held >= UNIT_TOKENS:
                yield frequent()
                unit, held = [], 0
        yield frequent()

    return run


def _prefixes(size: int, percent: int, buckets: int, frequent: np.ndarray):
    """The prefixes of a task's distinct sets under every order, as blobs by bucket of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Frequent(frequent)
        seen: set[int] = set()
        parts: list[tuple[list, list, list]] = [([], [], []) for _ in range(ORDERS)]
        held = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple[int, bytes]] = []
            for order, (tokens, nodes, counts) in enumerate(parts):
                if not tokens:
                    continue
                lengths = [len(t) for t in tokens]
                token = np.concatenate(tokens)
                node, n = np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(counts, np.int64), lengths)
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")  # a node's tokens stay together
                token, node, n, bucket = token[by], node[by], n[by], bucket[by]
                starts, size_ = runs(bucket)
                for a, count in zip(starts.tolist(), size_.tolist(), strict=True):
                    out.append((order * buckets + int(bucket[a]), squeezed(token[a : a + count], node[a : a + count], n[a : a + count])))
            for part in parts:
                for column in part:
                    column.clear()
            columns = list(zip(*out, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["bucket", "blob"])

        for batch in blocks(batches, limit=TEXT_BYTES):
            for tokens in shingle_sets(batch.column("text"), size):
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                seen.add(node)
                for order in range(ORDERS):
                    first = last.prefix(tokens, order, prefix_size(len(tokens), percent))
                    for column, value in zip(parts[order], (first, node, len(tokens)), strict=True):
                        column.append(value)
                    held += len(first)
            if held >= UNIT_TOKENS:
                yield flush()
                seen.clear()
                held = 0
        yield flush()

    return run


def squeezed(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> bytes:
    """Tokens cut to 32 bits beside their bucket, and each node once for its tokens. A token that two share by
    chance costs a comparison and changes no result."""
    starts, lengths = runs(node)
    columns = (np.array([len(token), len(starts)], "<i8"), (token >> np.uint64(32)).astype("<u4"), node[starts].astype("<i8"),
               n[starts].astype("<i4"), lengths.astype("<i4"))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def spread_out(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size, nodes = np.frombuffer(data[:16], "<i8").tolist()
    at = 16 + 4 * size
    token = np.frombuffer(data[16:at], "<u4")
    node = np.frombuffer(data[at : at + 8 * nodes], "<i8")
    n = np.frombuffer(data[at + 8 * nodes : at + 12 * nodes], "<i4")
    lengths = np.frombuffer(data[at + 12 * nodes :], "<i4")
    return token, np.repeat(node, lengths), np.repeat(n, lengths)


SHARED = "bucket int, token long, node long, n long"


def _shared(percent: int):
    """Of each bucket the tokens that two nodes of fitting sizes share, with these nodes."""

    def run(group: pa.Table) -> pa.Table:
        parts = [spread_out(b) for b in group.column("blob").to_pylist()]
        token, node, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order].astype(np.int64)
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # a node comes from several tasks
        token, node, n = token[new], node[new], n[new]
        # Sorted by size within a token: a node is in if its neighbour's size fits its own.
        near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
        kept = np.r_[False, near] | np.r_[near, False]
        bucket = group.column("bucket")[0].as_py()
        arrays = [pa.array(np.full(int(kept.sum()), bucket, np.int32)), *(pa.array(x[kept].astype(np.int64)) for x in (token, node, n))]
        return pa.Table.from_arrays(arrays, [c.split()[0] for c in SHARED.split(", ")])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=TEXT_BYTES):
            sets = [tokens.tobytes() for tokens in shingle_sets(batch.column("text"), size)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, pa.array(sets, pa.binary())], ["node", "bytes", "tokens"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    of_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    of_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(b, kind="stable")
    b, of_b = b[order], of_b[order]
    first, last = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    count = last - first
    hit = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    pair = np.repeat(of_a, count) * len(right) + of_b[hit]
    return np.bincount(pair, minlength=len(left) * len(right)).reshape(len(left), len(right))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys in zip(batch.column("xs"), batch.column("ys"), strict=True):
                xs, ys = xs.as_py(), ys.as_py()
                left, right = ([np.frombuffer(s["tokens"], np.uint64) for s in side] for side in (xs, ys))
                shared = intersections(left, right)
                union = np.array([len(x) for x in left])[:, None] + np.array([len(y) for y in right])[None, :] - shared
                i, j = np.nonzero(100 * shared >= percent * union)
                a, b = np.array([x["node"] for x in xs], np.int64)[i], np.array([y["node"] for y in ys], np.int64)[j]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def block_counts(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(c, ``name``): over how many blocks the sets of ``members`` (c, node) are dealt, about ``BLOCK_SETS`` and at most some ``BLOCK_BYTES`` to a block."""
    parts = F.greatest(F.expr(f"count(*) div {BLOCK_SETS}"), F.expr(f"sum(bytes) div {BLOCK_BYTES}")) + 1
    return members.join(sets.select("node", "bytes"), "node").groupBy("c").agg(parts.alias(name))


def in_blocks(members: DataFrame, sets: DataFrame, counts: DataFrame, own: str, other: str) -> DataFrame:
    """(c, ``own``, ``other``, sets): the blocks of ``members``, each once for every block of the other side."""
    numbered = members.join(counts, "c").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col(f"n_{own}")))
    folded = numbered.join(sets, "node").groupBy("c", F.col("block").alias(own), f"n_{other}").agg(
        F.collect_list(F.struct("node", "tokens")).alias(f"{own}s")
    )
    return folded.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))).drop(f"n_{other}")


def verified(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between a node of ``pairs`` (c, node) and a member (c, node) of the same c; every two blocks of a cluster are a key of their own."""
    counts = stored(block_counts(pairs, sets, "n_x").join(block_counts(members, sets, "n_y"), "c"), "block-counts")
    xs, ys = in_blocks(pairs, sets, counts, "x", "y"), in_blocks(members, sets, counts, "y", "x")
    joined = xs.join(ys, ["c", "x", "y"]).select("xs", "ys")
    return stored(joined.mapInArrow(_verify(percent), "a long, b long").where("a != b"), "verified")


def _looked_up(least: Column) -> Column:
    """Whether a token is among the first of its node's that hold ``SOME``-th part of the ``least`` shared ones."""
    return F.col("rank") <= F.col("held") - least + F.ceil(least / SOME)


def fewest(tokens: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Of every node's ``tokens`` in a pass those in the fewest ``clusters``, as many as must hold some of the tokens it shares with any similar
    set: with their ``rank`` among all that it has ``held``.

    A node that shares l of its h tokens shares some of any h - l + some of them, so the tokens that most clusters have are
    left out; a node with fewer than l in a pass has no similar set there.
    """
    in_pass = Window.partitionBy("node", "pass")
    held = tokens.join(clusters, ["bucket", "token"]).withColumn("held", F.count("*").over(in_pass)).where(F.col("held") >= least_shared(percent))
    ranked = held.withColumn("rank", F.row_number().over(in_pass.orderBy("clusters", "bucket", "token")))
    return ranked.where(_looked_up(least_shared(percent))).drop("clusters")


def met_clusters(tokens: DataFrame, percent: int) -> DataFrame:
    """(c, node, pass, some): the larger clusters that nodes meet at their ``tokens`` (bucket, token, pass, node, n, cluster, size).

    A token is looked up only as far as the sizes found there leave room for a similar set, so alike texts that are not similar
    enough, however many share a passage, meet at few tokens or none. A similar set is met at ``some`` tokens in each pass.
    """
    key = ["bucket", "token"]
    others = tokens.groupBy(*key, F.col("cluster").alias("c")).agg(F.first("size").alias("c_size"), F.min("n").alias("low"), F.max("n").alias("high"))
    larger = (F.col("c_size") > F.col("size")) | ((F.col("c_size") == F.col("size")) & (F.col("c") > F.col("cluster")))
    fits = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    least = least_between(percent)
    met = fewest(tokens, others.groupBy(*key).agg(F.count("*").alias("clusters")), percent).join(others, key)
    met = met.where(larger & fits & (F.col("held") >= least) & _looked_up(least))
    return met.select("c", "node", "pass", F.ceil(least / SOME).alias("some"))


def similar_nodes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, k1, k2, node, n), and (node, component) of the nodes that have links."""
    rows = keyed(docs)
    found = stored(rows.mapInArrow(_nodes(size), SETS), "shingle-nodes")
    nodes = found.where("kind = 0").drop("kind")
    often = found.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n"))
    often = sorted((r["n"], r["node"]) for r in most_frequent(often, "n", FREQUENT_TOKENS).collect())
    often = np.array([token for _, token in often], np.int64).view(np.uint64)

    tokens = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, tokens * (100 - percent) // 100 * 8 // BUCKET_BYTES)
    blobs = rows.mapInArrow(_prefixes(size, percent, buckets, often), "bucket int, blob binary")
    shared = blobs.groupBy("bucket").applyInArrow(_shared(percent), SHARED)
    shared = stored(shared.withColumn("pass", F.expr(f"bucket div {buckets}")), "shared-tokens")
    key = ["bucket", "token"]
    enough = F.col("found") >= least_shared(percent)

    def under_every_order(rows: DataFrame, *by: str) -> DataFrame:
        """The groups whose prefix shares enough tokens in each pass."""
        counted = rows.groupBy(*by, "n", "pass").agg(F.count("*").alias("found")).where(enough)
        return counted.groupBy(*by).agg(F.count("*").alias("passes"), F.min("found").alias("found")).where(F.col("passes") == ORDERS)

    candidates = stored(under_every_order(shared, "node"), "candidate-nodes")
    shared = stored(shared.join(candidates.select("node", "found"), "node"), "candidate-tokens")

    # First the leader of every token: of the nodes that share it the one with the largest share of shared tokens.
    leaders = shared.groupBy(*key).agg(F.max(F.struct((F.col("found") / F.col("n")).alias("central"), "node", "n")).alias("leader"))
    led = shared.join(leaders, key).where("node != leader.node")
    led = led.where((100 * F.col("n") >= percent * F.col("leader.n")) & (100 * F.col("leader.n") >= percent * F.col("n")))
    pairs = under_every_order(led.select(F.col("leader.node").alias("c"), "node", "n", "pass"), "c", "node")
    pairs = stored(pairs.select("c", "node"), "leader-pairs")

    reps = nodes.where("n > 0").groupBy("node").agg(F.min(F.struct(*KEY)).alias("rep"))
    reps = reps.join(candidates, "node").select("node", "rep.*")
    texts = rows.select(*KEY, "text").join(reps, list(KEY)).select("node", "text")
    sets = stored(texts.mapInArrow(_sets(size), "node long, bytes long, tokens binary").dropDuplicates(["node"]), "shingle-sets")

    links = verified(pairs, pairs.select("c").distinct().withColumn("node", F.col("c")), sets, percent)

    # Then, within each cluster of such pairs, what is not in its largest component yet against the whole cluster in blocks.
    clusters = components(pairs.select(F.col("c").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "c")
    parts = clusters.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = stored(parts, "cluster-parts")
    main = parts.groupBy("c", "component").agg(F.count("*").alias("size"))
    main = main.groupBy("c").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"))
    main = stored(main, "cluster-mains")
    outside = parts.join(main, "c").where("component != main").select("c", "node")
    links = links.unionByName(verified(outside, parts.select("c", "node"), sets, percent))

    # Last, nodes that share tokens under every order but lie in different clusters, each against the larger cluster.
    placed = shared.join(clusters.join(main, "c"), "node", "left")
    placed = placed.select(*key, "pass", "node", "n", F.coalesce("c", "node").alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed_keys = placed.groupBy(*key).agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low != high").select(*key)
    open_ = stored(placed.join(mixed_keys, key), "open-tokens")
    crossing = met_clusters(open_, percent).groupBy("c", "node", "pass").agg(F.count("*").alias("found"), F.min("some").alias("some")).where("found >= some")
    crossing = crossing.groupBy("c", "node").agg(F.count("*").alias("passes")).where(F.col("passes") == ORDERS)
    crossing = stored(crossing.select("c", "node"), "crossing-pairs")
    wanted = crossing.select("c").distinct()
    members = clusters.select("c", "node").join(wanted, "c", "left_semi")
    alone = wanted.join(clusters.select("c").distinct(), "c", "left_anti").withColumn("node", F.col("c"))
    links = links.unionByName(verified(crossing, members.unionByName(alone), sets, percent))
    return nodes, components(links)


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 75, with_component: bool = False) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id) of every row: the least doc_id that links lead to.

    Words are what lies between ASCII white space, A-Z in lower case; a set holds the distinct ``size``-word shingles, or
    the whole sequence of fewer words. Two documents link when 100 * shared >= percent * union; no similar pair is
    missed. Null, empty and blank texts have no shingles and link with nothing. Equal
    sets always link, so rows that repeat do. Null ids are no least id: where a group has no other, its id is null.
    An empty table gives an empty result; further columns are not read.

    Where ids repeat or are null, groups may share a component_id: ``with_component`` adds the column ``component``, which
    only the rows of one group share; it is null where there are no shingles.
    """
    values = ["component_id", "component"] if with_component else ["component_id"]
    nodes, linked = similar_nodes(docs, size, percent)
    groups = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs"))
    groups = groups.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = stored(groups, "groups")
    least = stored(groups.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes")), "least-ids")
    groups = attach(groups, least, ["component"], "n_nodes", ["component_id"])
    groups = stored(groups.select("node", "n_docs", *values), "node-groups")
    full = attach(nodes.where("n > 0"), groups, ["node"], "n_docs", values)
    empty = nodes.where("n = 0").withColumn("component_id", F.col("doc_id"))
    out = full.unionByName(empty, allowMissingColumns=True)
    return out.select(*KEY, "doc_id", F.col("n").alias("n_shingles"), *values)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).drop(*KEY)
