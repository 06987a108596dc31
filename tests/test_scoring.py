"""Goldens of variants, genotypes, scores and calls."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cladespark import refdata
from cladespark.functions.expressions import mismatch_cost
from cladespark.operators import bit_scoring, cohort, genotype, packed_scoring, pileup, scoring, variants
from tests.conftest import rows_of

STATES = "sample_id string, chrom string, pos long, n_covering_frags long, ref string, alt string, is_mutated string"

M1 = {11083: "T"}
M2 = {241: "T", 1059: "T", 3037: "T", 14408: "T", 23403: "G", 25563: "T"}
M3 = {**M1, 28881: "?", 28882: "?", 28883: "?"}

GOLDEN = {
    "M1": "G 5 GH_1 7 GH_2 6 GR 8 L 1 O_1 1 O_2 1 S_1 3 S_2 6 V_1 2 V_2 1 "
    "19A_1 1 19A_2 2 19B_1 3 19B_2 6 20A_1 5 20A_2 6 20B 8 20C 7 "
    "A1a 3 A2 4 A2a 8 A3 0 A6 1 B 2 B1 6 B4 2",
    "M2": "G 2 GH_1 0 GH_2 1 GR 5 L 6 O_1 6 O_2 8 S_1 8 S_2 11 V_1 9 V_2 8 "
    "19A_1 6 19A_2 7 19B_1 8 19B_2 11 20A_1 2 20A_2 1 20B 5 20C 0 "
    "A1a 8 A2 3 A2a 5 A3 7 A6 6 B 7 B1 11 B4 7",
    "M3": "G 6.5 GH_1 8.5 GH_2 7.5 GR 6.5 L 2.5 O_1 2.5 O_2 2.5 S_1 4.5 S_2 7.5 V_1 3.5 V_2 2.5 "
    "19A_1 2.5 19A_2 3.5 19B_1 4.5 19B_2 7.5 20A_1 6.5 20A_2 7.5 20B 6.5 20C 8.5 "
    "A1a 4.5 A2 5.5 A2a 6.5 A3 1.5 A6 2.5 B 3.5 B1 7.5 B4 3.5",
}
CALLS = {
    "M1": ("L/O_1/O_2/V_2", "19A_1", "A3"),
    "M2": ("GH_1", "20C", "A2"),
    "M3": ("L/O_1/O_2/V_2", "19A_1", "A3"),
}


def state_rows(sample, changes, skip=()):
    return [
        (sample, refdata.CONTIG, pos, 100, ref, changes.get(pos, ref), "yes" if pos in changes else None)
        for pos, ref in refdata.MARKERS
        if pos not in skip
    ]


@pytest.fixture
def states(table):
    return table(STATES, state_rows("M1", M1) + state_rows("M2", M2) + state_rows("M3", M3))


def test_panel_tables(spark):
    assert refdata.profiles(spark).count() == 27 * 17
    assert refdata.markers(spark).count() == 17
    assert refdata.colours(spark).count() == 29
    assert [row[0] for row in refdata.profile_rows()][::17] == list(range(27))


def test_decomposition(table):
    single = [(p, r, a) for p, r, a in zip(
        (241, 1059, 3037, 14408, 21073, 23403, 27964), "CCCCGAC", "TTTTAGT", strict=True)]
    cases = [*single, (25563, "GGG", "TAC")]
    df = table("sample_id string, chrom string, pos long, ref string, alt string, qual double",
               [("s", "c", p, r, a, 99.0) for p, r, a in cases])
    out = rows_of(variants.decompose_substitutions(df), "pos_c", "ref_c", "alt_c")
    assert out == sorted([*single, (25563, "G", "T"), (25564, "G", "A"), (25565, "G", "C")], key=repr)


@pytest.mark.parametrize(
    ("ref", "alt", "expected"),
    [
        ("C", "CTT", [(100, "C", "CTT")]),
        ("GGG", "TA", [(100, "G", "T"), (101, "G", "A")]),
        ("GGG", "GAG", [(100, "G", "G"), (101, "G", "A"), (102, "G", "G")]),
        ("GG", "A,T", [(100, "G", "A"), (101, "G", ",")]),
    ],
)
def test_decomposition_edges(table, ref, alt, expected):
    df = table("sample_id string, chrom string, pos long, ref string, alt string, qual double",
               [("s", "c", 100, ref, alt, 99.0)])
    assert rows_of(variants.decompose_substitutions(df), "pos_c", "ref_c", "alt_c") == expected


def test_multiallelic_split(table):
    df = table("sample_id string, chrom string, pos long, ref string, alt string, qual double",
               [("s", "c", 100, "GG", "AC,T", 99.0)])
    out = rows_of(variants.decompose_substitutions(df, split_multiallelic=True), "pos_c", "ref_c", "alt_c")
    assert out == [(100, "G", "A"), (100, "G", "T"), (101, "G", "C")]


def test_quality_filter(table):
    df = table("sample_id string, chrom string, pos long, ref string, alt string, qual double",
               [("s", "c", 1, "A", "C", 10.0), ("s", "c", 2, "A", "C", 10.01), ("s", "c", 3, "A", "C", None)])
    assert rows_of(variants.normalise_variants(df), "pos") == [(2,)]


def test_genotype(table, spark):
    coverage = table("sample_id string, chrom string, pos long, n_covering_frags long",
                     [(f"s{i}", "c", 5, n) for i, n in enumerate((7, 7, 8, 8))])
    mutations = table("sample_id string, chrom string, pos long, ref string, alt string, is_mutated string",
                      [("s1", "c", 5, "X", "T", "yes"), ("s3", "c", 5, "X", "T", "yes"), ("s3", "c", 9, "X", "T", "yes")])
    markers = table("chrom string, pos long, ref string", [("c", 5, "G")])
    out = genotype.marker_states(coverage, mutations, markers)
    assert rows_of(out, "sample_id", "ref", "alt", "is_mutated", "original_ref") == [
        ("s0", "G", "?", None, "G"), ("s1", "G", "?", "yes", "G"),
        ("s2", "G", "G", None, "G"), ("s3", "G", "T", "yes", "G"),
    ]


def test_marker_on_other_contig_does_not_match(table):
    coverage = table("sample_id string, chrom string, pos long, n_covering_frags long", [("s", "c", 5, 9)])
    mutations = table("sample_id string, chrom string, pos long, ref string, alt string, is_mutated string",
                      [("s", "host", 5, "G", "T", "yes")])
    markers = table("chrom string, pos long, ref string", [("c", 5, "G")])
    assert rows_of(genotype.marker_states(coverage, mutations, markers), "alt") == [("G",)]


def test_distances_and_calls(spark, states):
    scores = scoring.score_profiles(states, refdata.profiles(spark)).cache()
    for sample, text in GOLDEN.items():
        words = text.split()
        expected = dict(zip(words[::2], map(float, words[1::2]), strict=True))
        found = {r.clade: r.manhattan for r in scores.where(F.col("sample_id") == sample).collect()}
        assert found == expected
    calls = scoring.clade_calls(scores)
    wide = cohort.clade_calls_wide(calls, refdata.naming_systems(spark), list(refdata.SYSTEM_LABELS_BY_ID.values()))
    assert wide.columns == ["sample_id", "GISAID", "New Nextstrain", "Old Nextstrain"]
    assert {r[0]: tuple(r[1:]) for r in wide.collect()} == CALLS
    ordered = [tuple(r) for r in scoring.sort_scores(scores).select("sample_id", "id", "manhattan").collect()]
    assert ordered == sorted(ordered)


def test_calls_with_cutoff(spark, table):
    far = {p: "?" for p in refdata.POSITIONS}
    df = table(STATES, state_rows("M3", M3) + state_rows("far", far))
    calls = scoring.clade_calls_cutoff(scoring.score_profiles(df, refdata.profiles(spark)))
    found = {(r.sample_id, r.id): r.call for r in calls.collect()}
    assert found["M3", "old_nextstrain"] == "A3(1.5)"
    assert found["M3", "gisaid"] == "L(2.5) or O_1(2.5) or O_2(2.5) or V_2(2.5)"
    assert {v for k, v in found.items() if k[0] == "far"} == {"-"}


def test_missing_state_gives_null_scores_and_no_call(spark, table):
    df = table(STATES, state_rows("M1", M1, skip=(28144,)) + state_rows("M2", M2))
    scores = scoring.score_profiles(df, refdata.profiles(spark)).cache()
    assert scores.where("sample_id = 'M1' AND manhattan IS NULL").count() == 27
    assert {r.sample_id for r in scoring.clade_calls(scores).collect()} == {"M2"}
    cells = cohort.score_cells(scores, refdata.colours(spark))
    assert cells.where("sample_id = 'M1' AND (is_best IS NOT NULL OR score IS NOT NULL)").count() == 0


def test_one_null_score_empties_the_cells_of_its_system(spark, table):
    scores = table("sample_id string, id string, clade string, manhattan double",
                   [("s", "gisaid", "G", 1.0), ("s", "gisaid", "L", None), ("s", "old_nextstrain", "A2", 2.0)])
    cells = cohort.score_cells(scores, refdata.colours(spark))
    assert rows_of(cells, "id", "clade", "score", "is_best") == [
        ("gisaid", "G", None, None), ("gisaid", "L", None, None), ("old_nextstrain", "A2", "2", True)]


def brute_scores(states, profiles):
    by_sample = {}
    for sample, chrom, pos, alt in states:
        by_sample.setdefault(sample, {}).setdefault((chrom, pos), []).append(alt)
    by_clade = {}
    for chrom, system, clade, pos, alt in profiles:
        by_clade.setdefault((system, clade), []).append(((chrom, pos), alt))
    out = []
    for sample, found in by_sample.items():
        for key, profile in by_clade.items():
            costs = []
            for site, want in profile:
                for alt in found.get(site, [None]):
                    costs.append(None if alt is None else 0.5 if alt == "?" else float(alt != want))
            out.append((sample, *key, None if None in costs else sum(costs)))
    return sorted(out, key=repr)


PROFILES = "chrom string, id string, clade string, pos long, alt string"


@pytest.mark.parametrize("max_rows", [500_000, 0])
def test_scores_against_brute_force(table, max_rows):
    """Duplicated states, NULL alleles, two contigs, positions off the profiles, clades off the sample; both ways to join."""
    rng = random.Random(7)
    sites = [(f"k{p % 2}", p // 2) for p in range(1, 90)]
    profiles = [(k, "sys", f"c{c}", p, rng.choice("ACGT")) for c in range(6) for k, p in sites if c != 5 or p > 35]
    profiles += [("k0", "other", "x", 1000, "A")]
    states = []
    for sample in ("full", "dup", "null", "short", "alien"):
        pool = [("k0", 2000), ("k9", 1)] if sample == "alien" else sites if sample != "short" else sites[70:]
        for chrom, pos in pool:
            states.append((sample, chrom, pos, rng.choice("ACGT?")))
            if sample == "dup" and pos % 10 == 0:
                states.append((sample, chrom, pos, rng.choice("ACGT")))
    states = [(s, k, p, None if s == "null" and p == 30 else a) for s, k, p, a in states]
    rng.shuffle(states)
    out = scoring.score_profiles(
        table("sample_id string, chrom string, pos long, alt string", states), table(PROFILES, profiles), max_rows=max_rows
    )
    assert rows_of(out) == brute_scores(states, profiles)


SMALL = {"SITES_PER_PART": 7, "CLADES_PER_BLOCK": 4, "BLOCKS_PER_GROUP": 2, "BLOCKS_PER_DEAL": 1, "NAMED_BLOCKS": 0}


@pytest.mark.parametrize("names", [(), ("SITES_PER_PART",), ("CLADES_PER_BLOCK", "BLOCKS_PER_GROUP", "BLOCKS_PER_DEAL"), tuple(SMALL)])
def test_packed_scores_in_blocks_parts_and_deals(table, monkeypatch, names):
    """Sparse profiles, samples that lack sites, states off the profiles, repeated and unknown alleles."""
    for name in names:
        monkeypatch.setattr(packed_scoring, name, SMALL[name])
    rng = random.Random(11)
    sites = [(f"k{p % 3}", p) for p in range(40)]
    profiles = [(k, f"s{c % 3}", f"c{c}", p, rng.choice(["A", "C", "G", "TT", "?"])) for c in range(30) for k, p in sites if c < 20 or p % c == 1]
    states = [("none", "k9", 5, "A")]
    for sample in range(12):
        for k, p in sites + [("k0", 77)]:
            for _ in range(rng.choice([1, 1, 1, 2, 3]) if sample % 3 else 1):
                if sample != 5 or p > 20:
                    states.append((f"m{sample}", k, p, rng.choice(["A", "C", "G", "TT", "?", "-"]) if sample != 7 or p != 9 else None))
    out = scoring.score_profiles(
        table("sample_id string, chrom string, pos long, alt string", states), table(PROFILES, profiles), max_rows=0
    )
    assert rows_of(out) == brute_scores(states, profiles)


def test_packed_scores_without_a_profile_allele(table):
    profiles = [("k", "s", "known", 1, "A"), ("k", "s", "null", 1, None), ("k", "s", "other", 2, "C")]
    states = [("x", "k", 1, "A"), ("x", "k", 2, "C"), ("y", "k", 1, "?"), ("y", "k", 2, "C")]
    for max_rows in (500_000, 0):
        out = scoring.score_profiles(
            table("sample_id string, chrom string, pos long, alt string", states), table(PROFILES, profiles), max_rows=max_rows
        )
        assert rows_of(out) == [
            ("x", "s", "known", 0.0), ("x", "s", "null", None), ("x", "s", "other", 0.0), ("y", "s", "known", 0.5), ("y", "s", "null", 0.5),
            ("y", "s", "other", 0.0),
        ]


def test_packed_scores_move_no_row_per_site_and_clade(spark, table):
    """What is exchanged for 40 samples and 200 profiles of 17 sites: rows of samples and blocks, and the reference tables."""
    rng = random.Random(12)
    profiles = table(PROFILES, [(refdata.CONTIG, "s", f"c{c}", p, rng.choice("ACGT")) for c in range(200) for p in refdata.POSITIONS])
    states = table("sample_id string, chrom string, pos long, alt string",
                   [(f"m{i}", refdata.CONTIG, p, rng.choice("ACGT")) for i in range(40) for p in refdata.POSITIONS])
    out = scoring.score_profiles(states, profiles, max_rows=0)
    assert len(out.collect()) == 8000
    moved = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind == "ShuffleQueryStageExec":
            moved.append(node.getRuntimeStatistics().rowCount().get())
        if kind.endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert moved and max(moved) <= 200 * 17


def test_contigs_are_told_apart(table):
    states = table("sample_id string, chrom string, pos long, alt string", [("s", "c1", 10, "C"), ("s", "c2", 10, "T")])
    profiles = table(PROFILES, [("c1", "x", "A", 10, "C"), ("c1", "x", "B", 10, "T")])
    assert rows_of(scoring.score_profiles(states, profiles)) == [("s", "x", "A", 0.0), ("s", "x", "B", 1.0)]


def test_no_single_task_holds_the_profiles(spark, states):
    scores = scoring.score_profiles(states, refdata.profiles(spark))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert "dense_rank" not in plan and len(alone) <= 1  # the bounded list of clade names


def test_distance_is_zero_only_for_the_same_profile(spark):
    profiles = refdata.profiles(spark)
    as_states = profiles.select(F.concat_ws("/", "id", "clade").alias("sample_id"), "chrom", "pos", "alt")
    scores = scoring.score_profiles(as_states, profiles).where("manhattan = 0")
    alleles = {(s, c): refdata.profile_alleles(s, c) for s, cs in refdata.CLADE_SUBSTITUTIONS.items() for c in cs}
    expected = sorted(
        (f"{a[0]}/{a[1]}", *b) for a in alleles for b in alleles if alleles[a] == alleles[b]
    )
    assert sorted(tuple(r) for r in scores.select("sample_id", "id", "clade").collect()) == expected


def test_mismatch_cost_of_null(table):
    df = table("a string, b string", [("?", None), (None, "A"), ("A", "A"), ("A", "C"), ("A", None)])
    assert [r[0] for r in df.select(mismatch_cost(F.col("a"), F.col("b"))).collect()] == [0.5, None, 0.0, 1.0, None]


def test_long_profiles_round_trip(spark):
    wide = refdata.profiles_wide(spark, "gisaid")
    assert "chrom" not in scoring.long_profiles(wide, "gisaid").columns
    long = scoring.long_profiles(wide, "gisaid", refdata.CONTIG)
    assert rows_of(long) == rows_of(refdata.profiles(spark).where("id = 'gisaid'"))


def test_matrices(spark, states):
    profiles = cohort.marker_profiles(states, refdata.SITES)
    assert profiles.columns == ["sample_id", *[str(p) for p in sorted(refdata.POSITIONS)]]
    m1 = profiles.where("sample_id = 'M1'").collect()[0].asDict()
    assert m1["11083"] == "T" and m1["241"] == "C"
    assert cohort.marker_coverages(states, refdata.SITES).where("`241` = 100").count() == 3
    matrix = cohort.score_matrix(scoring.score_profiles(states, refdata.profiles(spark)), refdata.SCORE_COLUMNS)
    assert len(matrix.columns) == 28
    assert matrix.where("sample_id = 'M3'").select("`old_nextstrain:A3`").collect()[0][0] == 1.5


def test_duplicate_cells_are_an_error(spark, states):
    doubled = states.unionByName(states.where("sample_id = 'M1' AND pos = 241"))
    with pytest.raises(Exception, match=f"more than one row for _marker={refdata.CONTIG}:241"):
        cohort.marker_profiles(doubled, refdata.SITES).collect()


def test_cells_that_are_not_listed_are_an_error(spark, states):
    with pytest.raises(Exception, match=f"no column is listed for _marker={refdata.CONTIG}:241"):
        cohort.marker_profiles(states, refdata.SITES[1:]).collect()
    scores = scoring.score_profiles(states, refdata.profiles(spark))
    with pytest.raises(Exception, match="no column is listed for _column=gisaid:G"):
        cohort.score_matrix(scores, refdata.SCORE_COLUMNS[1:]).collect()
    with pytest.raises(Exception, match="no column is listed for naming_system="):
        cohort.clade_calls_wide(scoring.clade_calls(scores), refdata.naming_systems(spark), ["GISAID"]).collect()


def test_matrices_of_several_contigs_name_them(table):
    rows = [("s", "k1", 5, 9, "A", "A", None), ("s", "k2", 5, 9, "C", "T", "yes")]
    matrix = cohort.marker_profiles(table(STATES, rows), [("k2", 5), ("k1", 5)])
    assert matrix.columns == ["sample_id", "k1:5", "k2:5"] and rows_of(matrix) == [("s", "A", "T")]


def test_complete_samples_come_from_the_outputs_of_the_steps(table):
    coverage, mutations = (table("sample_id string", [(s,) for s in names]) for names in ("abc", "bcc"))
    assert rows_of(genotype.complete_samples(coverage, mutations)) == [("b",), ("c",)]

def test_cells_and_groups(spark, states):
    cells = {(r.sample_id, r.pos): r.color for r in cohort.profile_cells(states).collect()}
    assert cells["M1", 11083] == refdata.NUCLEOTIDE_COLOURS["T"] and cells["M3", 28881] == refdata.PLAIN_COLOUR
    low = states.withColumn("n_covering_frags", F.when(F.col("pos") == 241, 9).otherwise(10).cast("long"))
    assert cohort.coverage_cells(low).where("is_low").select("pos").distinct().collect()[0][0] == 241
    scores = scoring.score_profiles(states, refdata.profiles(spark))
    groups = cohort.column_groups(scores, refdata.naming_systems(spark)).where("sample_id = 'M1'")
    assert rows_of(groups, "run", "naming_system", "length", "end") == [
        (1, "GISAID", 11, 11), (2, "New Nextstrain", 8, 19), (3, "Old Nextstrain", 8, 27)]
    best = cohort.score_cells(scores, refdata.colours(spark)).where("sample_id = 'M3' AND is_best")
    assert ("old_nextstrain", "A3", "1.5", "#77C7A4", refdata.BEST_SCORE_COLOUR) in rows_of(
        best, "id", "clade", "score", "clade_color", "cell_color")


def test_pileup_and_calls(table):
    def calls(base, n, mapq=30, bq=30, sample="s"):
        return [(sample, "c", 5, base, bq, mapq)] * n

    bases = table(
        "sample_id string, chrom string, pos long, base string, bq int, mapq int",
        calls("T", 6) + calls("G", 5) + calls("T", 9, mapq=9) + calls("T", 9, bq=14)
        + calls("A", 5, sample="tie") + calls("T", 5, sample="tie")
        + calls("T", 9, sample="shallow") + calls("G", 10, sample="same"),
    )
    counts = pileup.pileup(bases)
    assert ("s", "c", 5, "T", 6) in rows_of(counts)
    reference = table("chrom string, pos long, ref string", [("c", 5, "G")])
    assert rows_of(pileup.call_haploid(counts, reference)) == [
        ("s", "c", 5, "G", "T", 11, 6), ("tie", "c", 5, "G", "A", 10, 5)]
    assert {r.sample_id for r in pileup.legacy_call_haploid(bases, reference).collect()} == {"s", "tie", "shallow"}
    assert pileup.pileup(bases, contig="other").count() == 0


def test_pairs_of_samples_and_very_many_profiles_are_not_kept(spark, table):
    """Scores are made within a row of the join: no sort, sum or move over samples times profiles comes after it."""
    profiles = table(PROFILES, [("k", "s", f"c{c}", p, "ACGT"[(c + p) % 4]) for c in range(50) for p in range(70)])
    states = table("sample_id string, chrom string, pos long, alt string", [("x", "k", p, "A") for p in range(70)])
    plan = scoring.score_profiles(states, profiles, max_rows=0)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Join")]
    assert not [kind for kind in ("Aggregate", "Sort", "Exchange", "Window", "Generate") if kind in after]


@pytest.mark.parametrize("most_words", [0, 32])
def test_scores_by_bits_and_in_blocks(table, monkeypatch, most_words):
    """Sites of several words, alleles that are NULL on either side, a state found a hundred times; a panel too wide for words."""
    monkeypatch.setattr(bit_scoring, "MOST_WORDS", most_words)
    rng = random.Random(5)
    sites = [("k", p) for p in range(70)]
    profiles = [(k, "s", f"c{c}", p, rng.choice(["A", "C", "?"])) for c in range(9) for k, p in sites if (c + p) % 3 or c > 5]
    profiles = [row if row[2:4] != ("c8", 3) else (*row[:4], None) for row in profiles]
    states = [(f"m{i}", k, p, rng.choice("AC?G")) for i in range(5) for k, p in sites] + [("m1", "k", 69, "A")] * 100
    states += [("m2", "k", 7, None), ("off", "z", 1, "A")]
    out = scoring.score_profiles(table("sample_id string, chrom string, pos long, alt string", states), table(PROFILES, profiles), max_rows=0)
    expected = {row[:3]: row[3] for row in brute_scores(states, profiles)}
    # A profile without an allele costs a known state nothing that is known, and an unknown one a half.
    alleles = {}
    for sample, k, p, alt in states:
        if (k, p) == ("k", 3):
            alleles[sample] = alt
    for sample, alt in alleles.items():
        if alt != "?":
            expected[sample, "s", "c8"] = None
    assert rows_of(out) == sorted(((*key, total) for key, total in expected.items()), key=repr)


def test_scores_are_written_in_blocks(spark, table, tmp_path):
    """20,000 samples against 320 profiles: a run of one clade over few samples, whose ids a file keeps once and not in every row."""
    states = spark.range(20_000).selectExpr("concat('m', id) AS sample_id", "'k' AS chrom", "5L AS pos", "substr('ACG?', cast(1 + id % 4 AS int), 1) AS alt")
    profiles = table(PROFILES, [("k", "s", f"c{c}", 5, "ACGT"[c % 4]) for c in range(320)])
    scoring.score_profiles(states, profiles, max_rows=0).write.parquet(f"{tmp_path}/out")
    written = spark.read.parquet(f"{tmp_path}/out")
    cost = "CASE WHEN n = 3 THEN 0.5D WHEN n = c % 4 THEN 0.0D ELSE 1.0D END"
    found = written.selectExpr("cast(substr(sample_id, 2) AS int) % 4 AS n", "cast(substr(clade, 2) AS int) AS c", "*").where(f"manhattan = {cost}")
    assert written.count() == found.select("sample_id", "clade").distinct().count() == 20_000 * 320
    parts = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/*.parquet")]
    bytes_written = sum(m.row_group(g).column(c).total_compressed_size for m in parts for g in range(m.num_row_groups) for c in range(m.num_columns))
    assert bytes_written < 2 * 20_000 * 320  # an id alone takes 10 as it stands
