"""A whole cohort from reads and mutations to the written tables of a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cladespark import refdata
from cladespark.functions.tables import broadcast_if_small
from cladespark.operators import cohort, genotype, intervals, scoring
from cladespark.sources.writers import write_table


@dataclass(frozen=True)
class Panel:
    """Reference tables of a run: contigs (chrom, length), markers (chrom, pos, ref), profiles (chrom, pos, id, clade, alt),
    systems (id, naming_system, ...) and colours (id, clade, color). Every column and contig of the reports follows from them."""

    contigs: DataFrame
    markers: DataFrame
    profiles: DataFrame
    systems: DataFrame
    colours: DataFrame

    @classmethod
    def default(cls, spark: SparkSession) -> Panel:
        return cls(
            refdata.contigs(spark), refdata.markers(spark), refdata.profiles(spark), refdata.naming_systems(spark),
            refdata.colours(spark),
        )

    def _distinct(self, table: DataFrame, *columns: str, limit: int = 10_000) -> list[tuple]:
        """Sorted distinct entries that become report columns; a table of more than ``limit`` columns is refused."""
        found = table.select(*columns).distinct().orderBy(*columns).limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"a report cannot have more than {limit} columns of {', '.join(columns)}")
        return [tuple(r) for r in found]

    def sites(self) -> list[tuple[str, int]]:
        return self._distinct(self.markers, "chrom", "pos")

    def labels(self) -> list[str]:
        return [label for _, label in self._distinct(self.systems, "id", "naming_system")]

    def score_columns(self) -> list[tuple[str, str]]:
        return self._distinct(self.profiles, "id", "clade")


def run_cohort(reads: DataFrame, mutations: DataFrame, samples: DataFrame, output: str, panel: Panel) -> None:
    """Write the states, matrices, scores, calls, report cells and uncovered intervals of all samples.

    ``samples`` is the cohort list, so samples without a single read are reported too. The
    marker states are the one narrow table everything else is made from: they are written
    first and read back, so the reads are scanned once for them whatever is lost or retried
    later. Uncovered intervals are those of the panel's contigs; reads elsewhere do not count.
    """
    spark = reads.sparkSession
    samples = samples.select("sample_id").distinct()
    coverage = intervals.marker_fragments(reads, panel.markers, samples)
    write_table(
        genotype.marker_states(coverage, mutations, panel.markers),
        f"{output}/all_samples", cluster_by=["sample_id", "pos"],
    )
    states = spark.read.parquet(f"{output}/all_samples")
    write_table(scoring.score_profiles(states, panel.profiles), f"{output}/all_samples_scores",
                cluster_by=["sample_id", "id"])
    scores = spark.read.parquet(f"{output}/all_samples_scores")
    calls = scoring.clade_calls(scores)
    sites = panel.sites()
    reports = {
        "all_samples_marker_profiles": (cohort.marker_profiles(states, sites), ["sample_id"]),
        "all_samples_marker_coverages": (cohort.marker_coverages(states, sites), ["sample_id"]),
        "all_samples_calls": (cohort.clade_calls_wide(calls, panel.systems, panel.labels()), ["sample_id"]),
        "all_samples_score_matrix": (cohort.score_matrix(scores, panel.score_columns()), ["sample_id"]),
        "all_samples_score_groups": (cohort.column_groups(scores, panel.systems), ["sample_id", "run"]),
        "all_samples_markers": (states, ["sample_id", "chrom", "pos"]),
        "all_samples_scores_vs_strains": (scores, ["sample_id", "id", "manhattan", "clade"]),
    }
    for name, (table, keys) in reports.items():
        write_table(cohort.report(table, *keys), f"{output}/{name}", "csv")
    cells = {
        "score_cells": cohort.score_cells(scores, panel.colours),
        "profile_cells": cohort.profile_cells(states),
        "coverage_cells": cohort.coverage_cells(states),
    }
    for name, table in cells.items():
        write_table(table, f"{output}/{name}", cluster_by=["sample_id"])
    on_panel = reads.join(broadcast_if_small(panel.contigs.select("chrom")), "chrom", "left_semi")
    gaps = intervals.uncovered(intervals.depth_runs(on_panel, panel.contigs, samples))
    write_table(gaps, f"{output}/uncovered_intervals", cluster_by=["sample_id", "chrom", "start"])
