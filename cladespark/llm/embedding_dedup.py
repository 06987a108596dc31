"""Near-duplicate vectors: signs under random hyperplanes in several tables, exact cosines, components of the links.

Only signatures meet in the tables. Vectors that a table brings together, directly or through others, form a candidate
group; vectors are moved once, to their group, and every pair of a group is measured in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import attach, runs, stored, table
from cladespark.llm.components import components

THRESHOLD = 0.93
RECALL = 0.995
SEED = 11
MIN_BITS, MAX_BITS = 6, 24
SIGNATURE_BITS = 256
PER_BUCKET = 4
DEVIATIONS = 5.0
CROWDED = 4096
BLOCK = 4096
SLICE = 256
GROUP = ("label", "dims")


def table_plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables) for a label of so many vectors.

    The bits follow the size, so a bucket of unrelated vectors holds a few of them at any size; the tables follow the bits, so a
    pair at the threshold shares a bucket in one of them with probability ``recall``, and closer pairs with more.
    """
    bits = min(max(MIN_BITS, math.ceil(math.log2(max(rows, 1) / PER_BUCKET))), MAX_BITS)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def most_differing(bits: int, threshold: float = THRESHOLD) -> int:
    """The most bits in which the signatures of a pair at the threshold differ, but for ``DEVIATIONS`` standard deviations."""
    differ = math.acos(threshold) / math.pi
    return math.ceil(bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ)))


def unit_vectors(lists: pa.Array) -> list[np.ndarray]:
    """Finite vectors other than zero at length one, in double precision."""
    vectors = []
    for values in lists:
        v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
        v /= np.abs(v).max()  # so that no square overflows or vanishes
        vectors.append(v / np.sqrt(v @ v))
    return vectors


def _signatures(bits: int, tables: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    total = 8 * math.ceil(max(SIGNATURE_BITS, bits * tables) / 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            signatures: list[bytes] = []
            codes: list[np.ndarray] = []
            for vector in unit_vectors(batch.column("vector")):
                dims = len(vector)
                if dims not in planes:
                    planes[dims] = np.random.default_rng((seed, dims)).standard_normal((total, dims))
                signs = planes[dims] @ vector >= 0
                signatures.append(np.packbits(signs).tobytes())
                codes.append(signs[: bits * tables].reshape(tables, bits) @ powers)
            arrays = [*(batch.column(c) for c in ("cid", *GROUP)), pa.array(signatures, pa.binary()), pa.array(codes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["cid", *GROUP, "signature", "codes"])

    return run


def _grown(linked: np.ndarray) -> np.ndarray:
    """The first member of the connected part that each member of a small group is in, from a matrix of its links."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] >= 0:
            continue
        root[first] = first
        edge = np.array([first])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
            root[edge] = first
    return root


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted rows as tables of whole runs of equal keys, with where each run starts and its length."""
    held: pa.Table | None = None

    def cut(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return runs(np.rec.fromarrays([rows.column(c).fill_null(0).to_numpy() for c in keys]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        starts, sizes = cut(held)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1], sizes[:-1]
            held = held.slice(starts[-1])
    if held is not None:
        yield held, *cut(held)


def _bucket_links(differ: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every bucket, links of its members to the first one that near signatures lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sizes in _whole_runs(batches, ["label", "dims", "t", "code"]):
            ids = rows.column("cid").to_numpy()
            flat = b"".join(rows.column("signature").to_pylist())
            signs = np.frombuffer(flat, np.uint8).reshape(len(ids), -1)
            signs = np.pad(signs, ((0, 0), (0, -signs.shape[1] % 8))).view(np.uint64)
            a, b = [], []
            for start, size in zip(starts, sizes, strict=True):
                own = signs[start : start + size]
                near = np.zeros((size, size), bool)
                for i in range(0, size, SLICE):
                    near[i : i + SLICE] = np.bitwise_count(own[i : i + SLICE, None, :] ^ own[None, :, :]).sum(axis=2) <= differ
                root = _grown(near)
                moved = np.flatnonzero(root != np.arange(size))
                a.append(ids[start + moved])
                b.append(ids[start + root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return run


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(a, b) of classes (cid, label, dims, vector): links that lead from every class to all that may be near it.

    In a bucket of a table, classes with near signatures are linked by a tree over them, not by all their pairs. A bucket
    of more than ``CROWDED`` classes is one tree without a look at signatures: more candidates, none lost.
    """
    largest = classes.groupBy(*GROUP).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = table_plan(largest, threshold, recall)
    schema = f"cid long, {', '.join(f'{c} long' for c in GROUP)}, signature binary, codes array<long>"
    signed = stored(classes.select("cid", *GROUP, "vector").mapInArrow(_signatures(bits, tables, seed), schema), "signatures")
    bucket = [*GROUP, "t", "code"]
    rows = signed.select("cid", *GROUP, F.posexplode("codes").alias("t", "code"))
    buckets = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1")
    buckets = stored(buckets, "buckets")
    sized = stored(attach(rows, buckets, bucket, "n", ["n", "least"]).where("n IS NOT NULL"), "bucketed")
    crowded = sized.where((F.col("n") > CROWDED) & (F.col("cid") != F.col("least"))).select(F.col("cid").alias("a"), F.col("least").alias("b"))
    others = sized.where(F.col("n") <= CROWDED).select("cid", *bucket).join(signed.select("cid", "signature"), "cid")
    dealt = others.repartition(*bucket).sortWithinPartitions(*bucket)
    total = 8 * math.ceil(max(SIGNATURE_BITS, bits * tables) / 8)
    near = dealt.mapInArrow(_bucket_links(most_differing(total, threshold)), "a long, b long")
    return near.unionByName(crowded)


def _pair_links(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every pair of blocks: how many vectors each class is linked with there, and a tree over the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sizes in _whole_runs(batches, ["component", "one", "other"]):
            ids, copies, block = (rows.column(c).to_numpy() for c in ("cid", "copies", "block"))
            out: list[list[np.ndarray]] = [[], [], []]
            for start, size in zip(starts, sizes, strict=True):
                own = slice(start, start + size)
                matrix = np.stack(unit_vectors(rows.column("vector").slice(start, size).combine_chunks()))
                second = int(np.count_nonzero(block[own] == block[start]))
                linked = np.zeros((size, size), bool)
                # The first block against the second, or against itself where it meets no other.
                columns = slice(0 if second == size else second, size)
                for i in range(0, second, SLICE):
                    linked[i : min(i + SLICE, second), columns] = matrix[i : min(i + SLICE, second)] @ matrix[columns].T >= threshold
                linked |= linked.T
                np.fill_diagonal(linked, False)
                root = _grown(linked)
                links = np.concatenate([linked[i : i + SLICE] @ copies[own] for i in range(0, size, SLICE)])
                used = np.flatnonzero(links)
                for column, values in zip(out, (ids[own][used], links[used], ids[own][root[used]]), strict=True):
                    column.append(values)
            arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, ["cid", "links", "root"])

    return run


def measured_links(classes: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, links, root) of classes in candidate groups: vectors linked with a class, and a class it is connected to.

    ``candidates`` is (node, component). A group of up to ``BLOCK`` classes is one block, measured by one matrix product. A
    larger one is cut into blocks, and every two of them meet in a task of their own. A class has a row for every other block it has links in.
    """
    sizes = stored(candidates.groupBy("component").agg(F.count("*").alias("size")), "group-sizes")
    sized = attach(candidates, sizes, ["component"], "size", ["size"])
    n_blocks = F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(2 * F.col("size") / BLOCK)).cast("int")
    members = sized.select(F.col("node").alias("cid"), "component", n_blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = members.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "component", "block", F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("other"))
    rows = met.join(classes.select("cid", "copies", "vector"), "cid")
    keys = ["component", "one", "other"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(_pair_links(threshold), "cid long, links long, root long")


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label, any more columns).

    Two rows link when their labels are equal and not null, their vectors have one length, and the cosine in double precision is at
    least ``threshold``. ``n_links`` counts the other rows linked with a row, ``component_id`` is the least vec_id that
    links lead to, its own included, and ``kept`` says whether that is its own. A vector that is null, empty, zero, or holds null or values that
    are not finite links with nothing, and so does one without a label. Ids may repeat or be null: rows are counted one by one, a null
    id is the component's only where no row of it has another. No rows give no rows.

    Equal vectors of a label are one class, and all that follows is done per class. Pairs are found where a table or a chain of
    near signatures brings them together: every pair found is measured, and a pair at the threshold is found with
    probability ``recall`` or more.
    """
    number = F.col("vec_id").cast("long").alias("vec_id")
    hashes = [F.xxhash64(F.lit(i), "embedding").alias(f"e{i}") for i in (0, 1)]
    dims = F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("dims")
    read = vectors.select(number, F.col("label").cast("long").alias("label"), dims, *hashes, F.col("embedding").alias("vector"))
    rows = stored(read.drop("vector"), "vector-rows")
    kind = [*GROUP, "e0", "e1"]
    found = read.where(F.col("label").isNotNull() & (F.col("dims") > 0)).groupBy(*kind).agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id")
    )
    holds_number = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    classes = stored(found.where(holds_number).withColumn("cid", F.monotonically_increasing_id()), "classes")

    groups = components(candidate_links(classes, threshold, recall, seed))
    measured = stored(measured_links(classes, groups, threshold), "measured")
    links = measured.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(measured.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "cid"})
    own = classes.select("cid", *kind, "copies", "least_id")
    linked = own.join(links, "cid", "left").join(parts, "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    linked = stored(linked, "linked-classes")
    ids = stored(linked.groupBy("part").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "parts")
    # The part of a hot group is one key of many classes, and a class may be one key of many rows.
    placed = attach(linked, ids, ["part"], "n", ["component_id"])
    of_class = placed.select(*kind, "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = attach(rows, stored(of_class, "class-links"), kind, "copies", ["n_links", "component_id", "copies"])
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN counted c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
