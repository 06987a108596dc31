"""Marker panel design: alleles of isolates at the markers, counted by clade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.functions.expressions import allele_at
from cladespark.functions.tables import spread, spread_sites, with_panel

CLADE_COLUMNS = ("clade", "gisaid_clade", "old_nextstrain_clade")


def isolate_alleles(sequences: DataFrame, markers: DataFrame) -> DataFrame:
    """Allele of every aligned sequence at every marker.

    The sequence is read once and cut to its panel characters in the same stage; it is
    never shuffled.
    """
    return with_panel(sequences.select("seqname", "seq"), markers.select("chrom", "pos", "ref")).select(
        "seqname", "chrom", "pos", "ref", allele_at(F.col("seq"), F.col("pos")).alias("allele")
    )


def _site(alleles: DataFrame) -> list[str]:
    """What names a site in a table: its contig too, where the table has it."""
    return [c for c in ("chrom", "pos") if c in alleles.columns]


def isolates_wide(alleles: DataFrame, sites: Sequence[int] | Sequence[tuple[str, int]]) -> DataFrame:
    """One row per isolate and a column per site: ``pos_<p>``, or ``pos_<contig>:<p>`` on a panel of several contigs.

    ``sites`` are positions on the only contig, or pairs of contig and position; alleles elsewhere are an error.
    """
    if all(isinstance(s, int) for s in sites):
        return spread(alleles, ["seqname"], "pos", "allele", {p: f"pos_{p}" for p in sites})
    return spread_sites(alleles, ["seqname"], "allele", sites, "pos_")


def panel_alleles(isolates: DataFrame, clades: DataFrame) -> DataFrame:
    """Wide isolates joined with their clades, as one row per (isolate, site); with the contig where columns name it."""
    joined = isolates.join(clades, "seqname")
    keys = ["seqname", *[c for c in joined.columns if c.endswith("clade")]]
    positions = [c for c in joined.columns if c.startswith("pos_")]
    long = joined.unpivot(keys, positions, "site", "allele").withColumn("site", F.regexp_replace("site", "^pos_", ""))
    chrom = [F.regexp_extract("site", "^(.*):", 1).alias("chrom")] if any(":" in p for p in positions) else []
    return long.select(*keys, *chrom, F.regexp_extract("site", "([0-9]+)$", 1).cast("long").alias("pos"), "allele")


def allele_counts(alleles: DataFrame, by: str = "clade") -> DataFrame:
    return alleles.groupBy(by, *_site(alleles), "allele").agg(F.count("*").alias("n"))


def allele_counts_by_system(alleles: DataFrame, columns: Sequence[str] = CLADE_COLUMNS) -> DataFrame:
    """Counts under every clade column at once, in one pass over the alleles."""
    named = F.array(*[F.struct(F.lit(c).alias("system"), F.col(c).alias("clade")) for c in columns])
    site = _site(alleles)
    return alleles.select(*site, "allele", F.inline(named)).groupBy("system", "clade", *site, "allele").agg(F.count("*").alias("n"))


def allele_summary(counts: DataFrame, by: str = "clade") -> DataFrame:
    """``A=3 C=1`` per (clade, site): most frequent first, ties by allele.

    Works on counts, so a group has one row per distinct allele. A NULL allele makes the
    whole text NULL.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "allele", "n")))
    text = F.array_join(
        F.transform(ranked, lambda r: F.concat(r["allele"], F.lit("="), r["n"].cast("string"))), " "
    )
    return counts.groupBy(by, *_site(counts)).agg(
        F.when(F.count_if(F.col("allele").isNull()) == 0, text).alias("alleles")
    )


def panel_matrix(summaries: DataFrame, sites: Sequence[int] | Sequence[tuple[str, int]], by: str = "clade") -> DataFrame:
    """Clade x site matrix of the summaries, sites in numeric order; others are an error. ``sites`` as in ``isolates_wide``."""
    if all(isinstance(s, int) for s in sites):
        return spread(summaries, [by], "pos", "alleles", {p: str(p) for p in sorted(sites)})
    return spread_sites(summaries, [by], "alleles", sites)


def base_composition(alleles: DataFrame) -> DataFrame:
    """Counts of A, T, C, G and N per site."""
    bases = [F.count_if(F.col("allele") == b).alias(b) for b in ("A", "T", "C", "G", "N")]
    return alleles.groupBy(*_site(alleles)).agg(*bases)
