"""Called variants: quality filter and decomposition to single bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.functions.expressions import base_substitutions


def normalise_variants(variants: DataFrame, min_qual: float = 10.0) -> DataFrame:
    """Variants strictly above a quality; rows without one are dropped."""
    return variants.where(F.col("qual") > min_qual).select("sample_id", "chrom", "pos", "ref", "alt", "qual")


def decompose_substitutions(variants: DataFrame, split_multiallelic: bool = False) -> DataFrame:
    """One row per base, next to the variant it came from (pos_c, ref_c, alt_c).

    By default a comma-separated list of alternatives is read as characters like any other
    string; with ``split_multiallelic`` every alternative becomes a variant of its own first.
    """
    if split_multiallelic:
        variants = variants.withColumn("alt", F.explode(F.split("alt", ",")))
    bases = base_substitutions(F.col("pos"), F.col("ref"), F.col("alt"))
    return variants.withColumn("_base", F.explode(bases)).select(
        *variants.columns,
        F.col("_base.pos").alias("pos_c"),
        F.col("_base.ref").alias("ref_c"),
        F.col("_base.alt").alias("alt_c"),
    )


def to_mutations(decomposed: DataFrame) -> DataFrame:
    """Single-base rows under the genotype key, flagged as mutated."""
    return decomposed.select(
        "sample_id",
        "chrom",
        F.col("pos_c").alias("pos"),
        F.col("ref_c").alias("ref"),
        F.col("alt_c").alias("alt"),
        F.lit("yes").alias("is_mutated"),
    )
