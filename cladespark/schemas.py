"""Fixed schemas of the files read and written at the edges."""

VARIANTS = (
    "chrom string, pos long, id string, ref string, alt string, qual double, "
    "filter string, info string, format string, genotype string"
)
TARGET_COVERAGE = (
    "chrom string, start long, end long, n_covering_frags long, n_covered_bases long, "
    "size long, frac_covered double"
)
MARKERS = "chrom string, pos long, ref string"
MUTATIONS = "pos long, ref string, alt string, qual double, pos_c long, ref_c string, alt_c string"
MARKER_STATES = (
    "pos long, n_covering_frags long, ref string, alt string, is_mutated string, original_ref string"
)
SCORES = "id string, clade string, manhattan double"
TARGETS = "chrom string, start long, end long"
NAMING_SYSTEMS = "naming_system string, id string, link string"
COLOURS = "id string, clade string, color string"
