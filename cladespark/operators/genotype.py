"""Marker states: what every sample carries at every panel position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.functions.expressions import genotype
from cladespark.functions.tables import broadcast_if_small

MIN_FRAGS = 8


def marker_states(
    coverage: DataFrame, mutations: DataFrame, markers: DataFrame, min_frags: int = MIN_FRAGS
) -> DataFrame:
    """Coverage by position, joined with the mutations found there and the marker list.

    ``ref`` is always the marker list's. Two mutations at one site give two rows.
    Mutations off the panel are dropped before the join, so only panel rows are moved.
    """
    panel = broadcast_if_small(markers.select("chrom", "pos", F.col("ref").alias("original_ref")))
    targeted = mutations.select("sample_id", "chrom", "pos", "alt", "is_mutated").join(
        panel, ["chrom", "pos"], "left_semi"
    )
    alt = genotype(
        F.col("n_covering_frags"), F.col("is_mutated"), F.col("original_ref"), F.col("alt"), min_frags
    )
    return (
        coverage.join(targeted, ["sample_id", "chrom", "pos"], "left")
        .join(panel, ["chrom", "pos"], "left")
        .select(
            "sample_id", "chrom", "pos", "n_covering_frags",
            F.col("original_ref").alias("ref"), alt.alias("alt"), "is_mutated", "original_ref",
        )
    )


def complete_samples(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Samples for which every step has an output.

    Each table lists the finished samples of a step, one row or more per sample. The contents of the outputs do not matter:
    a sample without a single mutation is complete once its mutation step has finished.
    """
    complete = first.select("sample_id").distinct()
    for other in others:
        complete = complete.join(other.select("sample_id"), "sample_id", "left_semi")
    return complete
