"""Haploid genotypes by likelihood: what each base costs at a site, its posterior, and the quality of a variant.

A read base of phred quality q agrees with its genotype with probability 1 - 10^(-q/10) and is each other base with a third of the
rest. Costs are minus ten times the logarithm to base ten, in whole thousandths: sums of integers, so one partial aggregate gives
the same costs in any order of the reads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions.tables import broadcast_if_small

SITE = ["sample_id", "chrom", "pos"]
GENOTYPES = ("A", "C", "G", "T")
THOUSANDTHS = 10_000  # of a phred, in one power of ten
THETA = 0.001
HIGHEST = 999.0


def _thousandths(probability: Column) -> Column:
    return F.round(-THOUSANDTHS * F.log10(probability)).cast("long")


def prior_cost(probability: float) -> int:
    return round(-THOUSANDTHS * math.log10(probability))


def genotype_costs(bases: DataFrame, min_mapq: int = 10, min_base_quality: int = 15, contig: str | None = None) -> DataFrame:
    """(site, depth, cost_A, cost_C, cost_G, cost_T, n_A, ...): what the bases that pass the filters cost under each genotype.

    Bases other than the four and those without a quality are left out; a quality below 1 counts as 1.
    """
    kept = bases.where((F.col("mapq") >= min_mapq) & (F.col("bq") >= min_base_quality) & F.col("base").isin(*GENOTYPES))
    if contig is not None:
        kept = kept.where(F.col("chrom") == contig)
    error = F.pow(F.lit(10.0), -F.greatest(F.col("bq"), F.lit(1)) / 10.0)
    costs = kept.select(*SITE, "base", _thousandths(1 - error).alias("same"), _thousandths(error / 3).alias("other"))

    def cost(genotype: str) -> Column:
        return F.sum(F.when(F.col("base") == genotype, F.col("same")).otherwise(F.col("other"))).alias(f"cost_{genotype}")

    counts = [F.count_if(F.col("base") == g).alias(f"n_{g}") for g in GENOTYPES]
    return costs.groupBy(*SITE).agg(F.count("*").alias("depth"), *[cost(g) for g in GENOTYPES], *counts)


def call_by_likelihood(
    costs: DataFrame, reference: DataFrame, min_depth: int = 10, min_alt_count: int = 5, theta: float = THETA
) -> DataFrame:
    """Sites whose likeliest genotype is not the reference base: (site, ref, alt, qual, depth, alt_count, genotype_quality).

    ``reference`` is (chrom, pos, ref). A genotype other than the reference has the prior probability ``theta`` / 3. ``qual`` is
    the phred of the posterior of the reference, ``genotype_quality`` that of all but the called genotype, at most ``HIGHEST``; both to
    three places. Genotypes equally likely: the alphabetically first is called. Where the reference is none of the four bases, ``qual`` is NULL.
    """
    expected = F.col("ref")
    of_reference, of_other = prior_cost(1 - theta), prior_cost(theta / 3)
    with_prior = [
        F.struct(
            (F.col(f"cost_{g}") + F.when(expected == g, F.lit(of_reference)).otherwise(F.lit(of_other))).alias("cost"),
            F.lit(g).alias("base"), F.col(f"n_{g}").alias("n"),
        )
        for g in GENOTYPES
    ]
    sites = costs.join(broadcast_if_small(reference.select("chrom", "pos", "ref")), ["chrom", "pos"])
    judged = sites.withColumn("_all", F.array(*with_prior)).withColumn("_best", F.array_min("_all"))

    def behind(i: int) -> Column:
        return (F.col("_all")[i]["cost"] - F.col("_best.cost")) / THOUSANDTHS

    total = F.lit(0.0)
    for i in range(len(GENOTYPES)):
        total = total + F.pow(F.lit(10.0), -behind(i))
    reference_behind = F.lit(None).cast("double")
    for i, g in enumerate(GENOTYPES):
        reference_behind = F.when(expected == g, behind(i)).otherwise(reference_behind)
    odds_against = (F.col("_total") - 1) / F.col("_total")
    return (
        judged.withColumn("_total", total)
        .withColumn("qual", F.round(10 * (reference_behind + F.log10("_total")), 3))
        .withColumn("genotype_quality", F.round(F.when(odds_against > 0, F.least(-10 * F.log10(odds_against), F.lit(HIGHEST))).otherwise(HIGHEST), 3))
        .where((F.col("_best.base") != expected) & (F.col("depth") >= min_depth) & (F.col("_best.n") >= min_alt_count))
        .select(*SITE, "ref", F.col("_best.base").alias("alt"), "qual", "depth", F.col("_best.n").alias("alt_count"), "genotype_quality")
    )
