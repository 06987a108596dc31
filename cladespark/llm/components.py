"""Connected components of a table of links, by rounds of joins that each task can lose and repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import stored


def _round(links: DataFrame) -> DataFrame:
    """Every node linked to the least of its neighbours, first those above it, then those below."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a != b").distinct()
    # Each link now runs from a node to a smaller one.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
    return stored(small, "components")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node that links lead to.

    Links to oneself, repeated and reversed links change nothing; no links give no rows. The rounds end
    when one changes nothing, which takes about the logarithm of the longest path.
    """
    now = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        now = _round(now)
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "component-of")
