"""Cohort matrices and the tables behind the report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladespark import refdata
from cladespark.functions.expressions import allele_colour, coverage_colour, low_coverage, score_text
from cladespark.functions.tables import broadcast_if_small, spread, spread_sites


def combine(*tables: DataFrame) -> DataFrame:
    """Union of per-batch tables by column name."""
    return reduce(DataFrame.unionByName, tables)


def _marker_matrix(states: DataFrame, markers: Sequence[tuple[str, int]], value: str) -> DataFrame:
    return spread_sites(states, ["sample_id"], value, markers)


def marker_profiles(states: DataFrame, markers: Sequence[tuple[str, int]]) -> DataFrame:
    """Sample x marker matrix of alleles; a second row for one cell or a marker not listed is an error."""
    return _marker_matrix(states, markers, "alt")


def marker_coverages(states: DataFrame, markers: Sequence[tuple[str, int]]) -> DataFrame:
    """Sample x marker matrix of fragment counts; a second row for one cell or a marker not listed is an error."""
    return _marker_matrix(states, markers, "n_covering_frags")


def with_colours(scores: DataFrame, colours: DataFrame) -> DataFrame:
    """Clade colour by (id, clade); NULL where the scheme has none."""
    return scores.join(broadcast_if_small(colours), ["id", "clade"], "left")


def with_labels(scores: DataFrame, systems: DataFrame) -> DataFrame:
    """Label of the naming system by id."""
    return scores.join(broadcast_if_small(systems.select("id", "naming_system")), "id", "left")


def clade_calls_wide(calls: DataFrame, systems: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Sample x naming system matrix of calls; a system without a listed label is an error."""
    labelled = with_labels(calls, systems)
    return spread(labelled, ["sample_id"], "naming_system", "call", {label: label for label in labels})


def score_matrix(scores: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Sample x clade matrix of distances, columns named system:clade; a clade not listed is an error."""
    keyed = scores.withColumn("_column", F.concat_ws(":", "id", "clade"))
    names = [f"{s}:{clade}" for s, clade in columns]
    return spread(keyed, ["sample_id"], "_column", "manhattan", {n: n for n in names})


def score_cells(scores: DataFrame, colours: DataFrame) -> DataFrame:
    """Report cells: the score as text, the clade colour, and whether it is a best score.

    Where any score of a (sample, system) is NULL there is no best one, and all its cells
    stay empty.
    """
    group = Window.partitionBy("sample_id", "id")
    nulls = F.count_if(F.col("manhattan").isNull()).over(group)
    is_best = F.when(nulls == 0, F.col("manhattan") == F.min("manhattan").over(group))
    return with_colours(scores.withColumn("is_best", is_best), colours).select(
        "sample_id", "id", "clade",
        F.when(F.col("is_best").isNotNull(), score_text(F.col("manhattan"))).alias("score"),
        "is_best",
        F.col("color").alias("clade_color"),
        F.when(F.col("is_best"), F.lit(refdata.BEST_SCORE_COLOUR)).alias("cell_color"),
    )


def profile_cells(states: DataFrame) -> DataFrame:
    return states.select("sample_id", "chrom", "pos", "alt", allele_colour(F.col("alt")).alias("color"))


def coverage_cells(states: DataFrame, threshold: int = 10) -> DataFrame:
    n = F.col("n_covering_frags")
    return states.select(
        "sample_id", "chrom", "pos", "n_covering_frags",
        low_coverage(n, threshold).alias("is_low"),
        coverage_colour(n, threshold).alias("color"),
    )


def report(df: DataFrame, *keys: str) -> DataFrame:
    """Row order of a report table."""
    return df.orderBy(*keys)


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Run-length encoding of an ordered column inside each key: run number, value, length, end.

    Meant for keys with few rows, such as the columns of one sample.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    starts = ~F.col(value).eqNullSafe(F.lag(value).over(ordered)) | (F.row_number().over(ordered) == 1)
    running = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_starts", starts.cast("long"))
        .withColumn("run", F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run", value)
        .agg(F.count("*").alias("length"))
        .withColumn("end", F.sum("length").over(running))
    )


def column_groups(scores: DataFrame, systems: DataFrame) -> DataFrame:
    """Header groups of the score table: consecutive columns of one naming system, per sample."""
    labelled = with_labels(scores, systems)
    return run_lengths(labelled, ["sample_id"], ["id", "manhattan", "clade"], "naming_system")
