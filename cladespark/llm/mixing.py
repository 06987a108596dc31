"""Sources mixed to target weights: fixed blocks of words, multinomial shards, permuted block indices.

Everything is DataFrame expressions and joins; the driver sees a few totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.llm.common import KEY, SPACE, attach, row_key, stored, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
CHUNKS = 1024
CELLS = 4096
#: Primes above 2**30: a prime that does not divide the number of blocks makes x -> x * prime + shift a permutation.
PRIMES = (1073741827, 1073741831, 1073741833, 1073741839, 1073741843, 1073741857, 1073741891, 1073741909)


def words_of() -> Column:
    return F.array_remove(F.split(text_or_empty(), f"{SPACE}+"), "")


def draw(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def with_targets(sources: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """``sources`` (source, source_size) with weight, target and sno, its number by code point with null last.

    All words are shared out by weight; a target stops at ``max_repeats`` times its source, and what is over is
    shared again by weight among the others until none is above. Each round is one aggregate over the sources.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sno"), F.lit(len(weights))) + 1)
    rows = stored(sources.withColumn("sno", number).withColumn("weight", weight), "sources")
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = cap < F.col("weight") * level
        found = rows.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if found["n"] == capped or not found["free"]:
            break
        capped, level = found["n"], (total - found["fixed"]) / found["free"]
    return rows.withColumn("target", F.least(cap, F.col("weight") * level))


def permuted(x: Column, blocks: Column, seed: int, *stream: Column) -> Column:
    """The place of x in a permutation of 0 .. blocks - 1 that ``stream`` selects."""
    usable = F.filter(F.array(*[F.lit(p) for p in PRIMES]), lambda p: blocks % p != 0)
    prime = F.element_at(usable, (F.pmod(draw(seed, *stream), F.size(usable).cast("long")) + 1).cast("int")).cast("long")
    shift = F.pmod(draw(seed + 1, *stream), blocks)
    wide = (x.cast("decimal(19,0)") * prime.cast("decimal(11,0)") + shift) % blocks
    return F.when(blocks < (1 << 31), (x * prime + shift) % blocks).otherwise(wide.cast("long"))


def taken_blocks(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """How often the mix takes each block: (sno, block, times).

    ``sources`` has (sno, blocks, slots). A shard's slots each draw a source, which makes the shard's counts
    multinomial; counts beyond a source's slots are cut where they are reached, and one last shard takes what the draws left
    short. A source's slots are numbered over the shards, and each pass of ``blocks`` numbers goes through a permutation of its own.
    """
    spark = sources.sparkSession
    upto = Window.orderBy("sno").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = sources.where("slots > 0").withColumn("upto", F.sum("slots").over(upto))
    cumulated = stored(cumulated.withColumn("first", F.col("upto") - F.col("slots")), "mix-shares")
    total = cumulated.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = -(-total // CELLS) or 1
    cells = cumulated.select("sno", "first", "upto", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(upto - 1) div {width}"))).alias("cell"))
    slots = spark.range(total).select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(draw(seed, F.col("id")), F.lit(max(1, total))).alias("at")
    ).withColumn("cell", F.expr(f"at div {width}"))
    drawn = slots.join(cells, "cell").where("at >= first AND at < upto").groupBy("shard", "sno").agg(F.count("*").alias("n"))
    drawn = stored(drawn, "shard-counts")

    before = Window.partitionBy("sno").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", F.col("first") + F.col("n"))
    short = cumulated.join(drawn.groupBy("sno").agg(F.sum("n").alias("n")), "sno", "left")
    short = short.select(F.lit(-1).cast("long").alias("shard"), "sno", F.coalesce("n", F.lit(0)).alias("first"), F.col("slots").alias("last"))
    spans = spans.select("shard", "sno", "first", "last").unionByName(short)
    spans = spans.join(sources.select("sno", "slots", "blocks"), "sno").withColumn("last", F.least("last", "slots")).where("first < last")
    # A span is one small row here and up to a shard's slots below, so the number of tasks is said.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    numbered = spans.repartition(tasks, "shard", "sno").select("sno", "blocks", F.explode(F.sequence("first", F.col("last") - 1)).alias("slot"))
    blocks = F.col("blocks")
    place = permuted(F.col("slot") % blocks, blocks, seed + 2, F.col("sno"), F.expr("slot div blocks"))
    return numbered.select("sno", place.alias("block")).groupBy("sno", "block").agg(F.count("*").alias("times"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = 32, max_repeats: int = 3, shard_slots: int = 65536, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's target, and the blocks of each that the mix takes.

    First (k1, k2, doc_id, sno, first, size, source_size, target), one row per document: its words are
    those from ``first`` on in the stream of its source. Second (sno, first, k1, k2, doc_id, at, words, times): a run of words of a document
    within one block, and how often the block is taken. A source's stream is cut into blocks of ``block_words`` words, and it
    gets target / size passes over its blocks, to the nearest block; no block is taken more than ``max_repeats`` times.

    Size is the number of words; null and empty texts have none and are never taken. A null source is a source of
    its own, the last. Rows that repeat are documents of their own. Results depend on the rows alone, not on their order or partitions. An empty
    table gives empty results; further columns are not read.
    """
    name = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sizes = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        name.alias("name"), F.size(words_of()).cast("long").alias("size"))
    chunk = F.pmod(draw(seed, F.col("k1"), F.col("k2")), F.lit(CHUNKS))
    sizes = stored(sizes.withColumn("chunk", chunk), "sizes")

    chunks = stored(sizes.groupBy("name", "source", "chunk").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs")), "chunks")
    sources = chunks.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    sources = with_targets(sources, weights, max_repeats)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    slots = F.round(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * F.col("blocks")).cast("long")
    sources = stored(sources.withColumn("slots", F.least(slots, F.col("blocks") * max_repeats)), "targets")

    earlier = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("name", "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("name", "chunk").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["name", "chunk"])
    placed = placed.select(*KEY, "doc_id", "name", "size", (F.col("start") + F.col("inside")).alias("first"))
    placed = attach(placed, sources, ["name"], "n_docs", ["sno", "source_size", "target"]).drop("name")
    placed = stored(placed, "placed")

    last = F.col("first") + F.col("size")
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(first + size - 1) div {block_words}"))).alias("block"))
    begin = F.greatest(F.col("block") * block_words, F.col("first"))
    end = F.least((F.col("block") + 1) * block_words, last)
    pieces = pieces.select("sno", "first", *KEY, "doc_id", "block", (begin - F.col("first")).alias("at"), (end - begin).alias("words"))
    pieces = pieces.join(taken_blocks(sources, shard_slots, seed), ["sno", "block"]).drop("block")
    return placed, pieces


def taken_words(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ``taken`` counts words with repeats."""
    placed, pieces = mix(docs, **parameters)
    sums = pieces.groupBy("sno", "first").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    some = placed.where("size > 0").join(sums, ["sno", "first"], "left")
    some = some.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each time a document is taken, wholly or in part.

    A document taken as a whole keeps its text as it is; else its text is the taken words in order, with single spaces.
    """
    _, pieces = mix(docs, **parameters)
    copies = pieces.select("sno", "first", *KEY, "at", "words", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    taken = copies.groupBy("sno", "first", *KEY, "copy").agg(
        F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("words").cast("int").alias("words")))).alias("runs"),
        F.sum("words").alias("n"),
    )
    rows = docs.select(*row_key(), F.struct(*docs.columns).alias("row"), "text").dropDuplicates(list(KEY))
    # The words are named twice below, which keeps them a column of their own and out of the lambda.
    rows = taken.join(rows, list(KEY)).withColumn("all", words_of())
    kept = F.flatten(F.transform("runs", lambda r: F.slice("all", r["at"] + 1, r["words"])))
    text = F.when(F.col("n") == F.size("all"), F.col("text")).otherwise(F.array_join(kept, " "))
    rows = rows.select("row", text.alias("mixed"))
    changed = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
