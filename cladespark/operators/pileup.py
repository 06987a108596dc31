"""Base counts per position and haploid calls by depth thresholds.

These are counts and cut-offs, not a likelihood model: no quality score is produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.functions.tables import broadcast_if_small

SITE = ["sample_id", "chrom", "pos"]


def pileup(bases: DataFrame, min_mapq: int = 10, min_base_quality: int = 15, contig: str | None = None) -> DataFrame:
    """Count of every base at every (sample, position) after the quality filters."""
    kept = bases.where((F.col("mapq") >= min_mapq) & (F.col("bq") >= min_base_quality))
    if contig is not None:
        kept = kept.where(F.col("chrom") == contig)
    return kept.groupBy(*SITE, "base").agg(F.count("*").alias("n"))


def call_haploid(
    counts: DataFrame, reference: DataFrame, min_depth: int = 10, min_alt_count: int = 5
) -> DataFrame:
    """Sites where the most frequent base is not the reference base.

    Ties go to the alphabetically first base. ``reference`` is (chrom, pos, ref).
    """
    top = F.min_by("base", F.struct(-F.col("n"), F.col("base")))
    return (
        counts.groupBy(*SITE)
        .agg(F.sum("n").alias("depth"), F.max("n").alias("alt_count"), top.alias("alt"))
        .where((F.col("depth") >= min_depth) & (F.col("alt_count") >= min_alt_count))
        .join(broadcast_if_small(reference.select("chrom", "pos", "ref")), ["chrom", "pos"])
        .where(F.col("alt") != F.col("ref"))
        .select(*SITE, "ref", "alt", "depth", "alt_count")
    )


def legacy_call_haploid(bases: DataFrame, reference: DataFrame) -> DataFrame:
    """The older settings: no quality filters, a single alternate read is enough."""
    counts = pileup(bases, min_mapq=0, min_base_quality=0)
    return call_haploid(counts, reference, min_depth=1, min_alt_count=1)


def to_mutations(calls: DataFrame) -> DataFrame:
    return calls.select(*SITE, "ref", "alt", F.lit("yes").alias("is_mutated"))
