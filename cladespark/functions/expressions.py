"""Scalar rules, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladespark import refdata

UNKNOWN = "?"


def genotype(n_frags: Column, is_mutated: Column, original_ref: Column, alt: Column, min_frags: int) -> Column:
    """Unknown below the fragment cut-off, else the reference or the mutated allele."""
    return (
        F.when(n_frags.isNull(), F.lit(None))
        .when(n_frags < min_frags, F.lit(UNKNOWN))
        .when(is_mutated.isNull(), original_ref)
        .otherwise(alt)
    )


def mismatch_cost(sample: Column, profile: Column) -> Column:
    """0.5 for an unknown sample allele, 1 for a difference, 0 for a match; NULL stays NULL."""
    return (
        F.when(sample == UNKNOWN, F.lit(0.5))
        .when(sample != profile, F.lit(1.0))
        .when(sample == profile, F.lit(0.0))
    )


def base_substitutions(pos: Column, ref: Column, alt: Column) -> Column:
    """Array of (pos, ref, alt), one per base, of a variant.

    A one-base reference passes unchanged, so an insertion stays a long string. Otherwise
    bases are paired up to the shorter string and the excess of an indel is dropped.
    """
    steps = F.sequence(F.lit(1), F.least(F.length(ref), F.length(alt)))
    paired = F.transform(
        steps,
        lambda i: F.struct(
            (pos + i - 1).cast("long").alias("pos"),
            F.substring(ref, i, F.lit(1)).alias("ref"),
            F.substring(alt, i, F.lit(1)).alias("alt"),
        ),
    )
    unchanged = F.array(F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")))
    return F.when(F.length(ref) == 1, unchanged).when(F.least(F.length(ref), F.length(alt)) >= 1, paired)


def score_text(score: Column) -> Column:
    """A score as text, whole numbers without a decimal point."""
    return F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))


def allele_colour(allele: Column) -> Column:
    colour = F.lit(refdata.PLAIN_COLOUR)
    for base, shade in refdata.NUCLEOTIDE_COLOURS.items():
        colour = F.when(allele == base, F.lit(shade)).otherwise(colour)
    return colour


def low_coverage(n_frags: Column, threshold: int = 10) -> Column:
    return F.coalesce(n_frags < threshold, F.lit(False))


def coverage_colour(n_frags: Column, threshold: int = 10) -> Column:
    return F.when(low_coverage(n_frags, threshold), F.lit(refdata.LOW_COVERAGE_COLOUR)).otherwise(
        F.lit(refdata.PLAIN_COLOUR)
    )


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_.\-]", "_")


def fan_out_path(entity_id: Column) -> Column:
    """Two-level path of an entity: the first two characters, then the rest."""
    rest = F.substring(entity_id, F.lit(3), F.length(entity_id))
    return F.concat_ws("/", F.substring(entity_id, 1, 2), rest)


def allele_at(sequence: Column, pos: Column) -> Column:
    """1-based character of an aligned sequence; NULL outside of it."""
    return F.when(pos >= 1, F.nullif(F.substring(sequence, pos.cast("int"), F.lit(1)), F.lit("")))
