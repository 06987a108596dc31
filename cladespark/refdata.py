"""Reference tables: the marker panel, the clade profiles, naming systems and colours.

Everything here is small by construction and is turned into a local relation,
so that the optimizer knows its exact size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladespark.functions.tables import values

CONTIG = "MN908947.3"
GENOME_LENGTH = 29903

# Panel position and reference allele.
MARKERS = (
    (241, "C"),
    (1059, "C"),
    (3037, "C"),
    (8782, "C"),
    (11083, "G"),
    (14408, "C"),
    (14805, "C"),
    (17747, "C"),
    (17858, "A"),
    (18060, "C"),
    (23403, "A"),
    (25563, "G"),
    (26144, "G"),
    (28144, "T"),
    (28881, "G"),
    (28882, "G"),
    (28883, "G"),
)

# The substitutions that define each clade. A profile carries the
# reference allele at every other panel position.
CLADE_SUBSTITUTIONS = {
    "gisaid": {
        "G": "C241T C3037T C14408T A23403G",
        "GH_1": "C241T C1059T C3037T C14408T A23403G G25563T",
        "GH_2": "C241T C3037T C14408T A23403G G25563T",
        "GR": "C241T C3037T C14408T A23403G G28881A G28882A G28883C",
        "L": "",
        "O_1": "",
        "O_2": "G11083T G26144T",
        "S_1": "C8782T T28144C",
        "S_2": "C8782T C17747T A17858G C18060T T28144C",
        "V_1": "G11083T C14805T G26144T",
        "V_2": "G11083T G26144T",
    },
    "new_nextstrain": {
        "19A_1": "",
        "19A_2": "G26144T",
        "19B_1": "C8782T T28144C",
        "19B_2": "C8782T C17747T A17858G C18060T T28144C",
        "20A_1": "C241T C3037T C14408T A23403G",
        "20A_2": "C241T C3037T C14408T A23403G G25563T",
        "20B": "C241T C3037T C14408T A23403G G28881A G28882A G28883C",
        "20C": "C241T C1059T C3037T C14408T A23403G G25563T",
    },
    "old_nextstrain": {
        "A1a": "C14805T G26144T",
        "A2": "C241T C3037T A23403G",
        "A2a": "C241T C3037T C14408T A23403G G28881A G28882A G28883C",
        "A3": "G11083T",
        "A6": "",
        "B": "C8782T",
        "B1": "C8782T C17747T A17858G C18060T T28144C",
        "B4": "C8782T",
    },
}

# Label, id and public view of each naming system.
NAMING_SYSTEMS = (
    ("GISAID", "gisaid", "https://nextstrain.org/ncov/global?c=GISAID_clade"),
    ("Old Nextstrain", "old_nextstrain", "https://nextstrain.org/ncov/global?c=legacy_clade_membership"),
    ("New Nextstrain", "new_nextstrain", "https://nextstrain.org/ncov/global?c=clade_membership"),
)

# Display colour of each clade.
CLADE_COLOURS = {
    "gisaid": {
        "GR": "#4770EB",
        "G": "#5DAECE",
        "GH_1": "#85CE92",
        "GH_2": "#85CE92",
        "O_1": "#BCD760",
        "O_2": "#BCD760",
        "S_1": "#F0C947",
        "S_2": "#F0C947",
        "L": "#FF923A",
        "V_1": "#F93529",
        "V_2": "#F93529",
    },
    "old_nextstrain": {
        "A2": "#494BE1",
        "B": "#4B83E9",
        "A1a": "#5CADCF",
        "A3": "#77C7A4",
        "B4": "#9AD47A",
        "B1": "#C4D65C",
        "A2a": "#E9CD4A",
        "A6": "#FFB041",
        "B2": "#FF7A35",
        "A7": "#F93529",
    },
    "new_nextstrain": {
        "19A_1": "#4C87E8",
        "19A_2": "#4C87E8",
        "19B_1": "#6EC2B2",
        "19B_2": "#6EC2B2",
        "20A_1": "#A8D66E",
        "20A_2": "#A8D66E",
        "20B": "#E8CE4B",
        "20C": "#FF923A",
    },
}

# Background colour of a nucleotide in the profile table.
NUCLEOTIDE_COLOURS = {"A": "#c17fd5", "C": "#cbb655", "G": "#96bcb8", "T": "#e1796b"}

# Plain cell, low coverage, and best score.
PLAIN_COLOUR = "#ffffff"
LOW_COVERAGE_COLOUR = "#ffaaaa"
BEST_SCORE_COLOUR = "#ffcccc"

POSITIONS = tuple(pos for pos, _ in MARKERS)
SITES = tuple((CONTIG, pos) for pos in POSITIONS)
SCORE_COLUMNS = tuple((s, clade) for s in sorted(CLADE_SUBSTITUTIONS) for clade in sorted(CLADE_SUBSTITUTIONS[s]))
SYSTEM_LABELS_BY_ID = {system_id: label for label, system_id, _ in sorted(NAMING_SYSTEMS, key=lambda s: s[1])}


def profile_alleles(system_id: str, clade: str) -> dict[int, str]:
    """Allele of a clade at every panel position."""
    alleles = dict(MARKERS)
    for substitution in CLADE_SUBSTITUTIONS[system_id][clade].split():
        pos = int(substitution[1:-1])
        assert alleles[pos] == substitution[0], f"{substitution} does not start from the reference allele"
        alleles[pos] = substitution[-1]
    return alleles


def profile_rows() -> list[tuple[int, str, str, int, str]]:
    """(profile number, naming system, clade, position, allele), numbered system by system."""
    clades = [(s, c) for s, by_clade in CLADE_SUBSTITUTIONS.items() for c in by_clade]
    return [
        (number, system_id, clade, pos, alt)
        for number, (system_id, clade) in enumerate(clades)
        for pos, alt in profile_alleles(system_id, clade).items()
    ]


def markers(spark: SparkSession) -> DataFrame:
    return values(spark, "chrom string, pos long, ref string", [(CONTIG, pos, ref) for pos, ref in MARKERS])


def profiles(spark: SparkSession) -> DataFrame:
    """Long profiles of every naming system: chrom, id, clade, pos, alt."""
    return values(
        spark, "chrom string, id string, clade string, pos long, alt string",
        [(CONTIG, *row[1:]) for row in profile_rows()],
    )


def numbered_profiles(spark: SparkSession) -> DataFrame:
    return values(
        spark, "pidx long, id string, clade string, pos long, alt string", profile_rows()
    )


def profiles_wide(spark: SparkSession, system_id: str) -> DataFrame:
    """One row per clade, one allele column per panel position."""
    columns = ", ".join(f"`{pos}` string" for pos in POSITIONS)
    rows = [(clade, *profile_alleles(system_id, clade).values()) for clade in CLADE_SUBSTITUTIONS[system_id]]
    return values(spark, f"clade string, {columns}", rows)


def naming_systems(spark: SparkSession) -> DataFrame:
    return values(spark, "naming_system string, id string, link string", NAMING_SYSTEMS)


def colours(spark: SparkSession) -> DataFrame:
    rows = [(s, clade, colour) for s, by_clade in CLADE_COLOURS.items() for clade, colour in by_clade.items()]
    return values(spark, "id string, clade string, color string", rows)


def contigs(spark: SparkSession) -> DataFrame:
    return values(spark, "chrom string, length long", [(CONTIG, GENOME_LENGTH)])
