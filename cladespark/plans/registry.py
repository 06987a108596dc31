"""Queries by name: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import refdata
from cladespark.functions.tables import stored
from cladespark.operators import catalog, cohort, genotype, intervals, likelihood, panel, pileup, run_store, scoring, variants
from cladespark.plans import bridge
from cladespark.session import shared_folder
from cladespark.sources import read_store, readers
from cladespark.sources.writers import write_table
from cladespark.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# Reads and intervals


@query
def marker_targets(spark, sf_dir):
    return intervals.markers_to_targets(bridge.from_tables(spark, sf_dir, bridge.PART_MARKERS))


@query
def reads_sorted(spark, sf_dir):
    reads = bridge.reads(spark, sf_dir).select("sample_id", "chrom", "start", "end", "mapq")
    return intervals.sort_reads(reads)


@query
def reads_in_region(spark, sf_dir):
    """The reads written in order with their index, and a stretch of the virus read from the files that can hold it."""
    folder = shared_folder(spark, "read-store")
    reads = bridge.reads(spark, sf_dir).select("sample_id", "chrom", "start", "end", "mapq")
    read_store.write_reads(reads, folder, window=1024, rows_per_file=20_000)
    return read_store.reads_in_region(spark, folder, refdata.CONTIG, *bridge.REGION)


@query
def target_coverage(spark, sf_dir):
    regions = bridge.from_tables(spark, sf_dir, bridge.REGIONS)
    return intervals.target_coverage(bridge.reads(spark, sf_dir), regions, bridge.samples(spark, sf_dir))


@query
def wide_panel_fragments(spark, sf_dir):
    """A target per part on the crowded contig: beyond the broadcast limit given here, so equal reads are folded and shuffled."""
    targets = bridge.from_tables(spark, sf_dir, bridge.PART_TARGETS)
    return intervals.target_fragments(bridge.reads(spark, sf_dir), targets, bridge.samples(spark, sf_dir), max_rows=0)


@query
def named_target_coverage(spark, sf_dir):
    """Targets with names, some of them without a base and some repeated."""
    targets = bridge.from_tables(spark, sf_dir, bridge.NAMED_TARGETS)
    return intervals.target_coverage(bridge.reads(spark, sf_dir), targets, bridge.samples(spark, sf_dir))


@query
def coverage_by_position(spark, sf_dir):
    targets = intervals.markers_to_targets(refdata.markers(spark))
    coverage = intervals.target_coverage(bridge.reads(spark, sf_dir), targets, bridge.samples(spark, sf_dir))
    return intervals.coverage_by_position(coverage)


@query
def marker_coverage(spark, sf_dir):
    return intervals.marker_fragments(bridge.reads(spark, sf_dir), refdata.markers(spark), bridge.samples(spark, sf_dir))


@query
def depth_runs(spark, sf_dir):
    return intervals.depth_runs(bridge.reads(spark, sf_dir), bridge.contigs(spark), bridge.samples(spark, sf_dir))


@query
def uncovered_intervals(spark, sf_dir):
    reads = bridge.reads(spark, sf_dir)
    virus_reads, virus = (intervals.on_contig(t, "MN908947") for t in (reads, bridge.contigs(spark)))
    return intervals.uncovered(intervals.depth_runs(virus_reads, virus, bridge.samples(spark, sf_dir)))


# Variants and genotypes


@query
def variants_filtered(spark, sf_dir):
    return variants.normalise_variants(bridge.from_tables(spark, sf_dir, bridge.VARIANTS))


@query
def variants_decomposed(spark, sf_dir):
    return variants.decompose_substitutions(variants_filtered(spark, sf_dir))


@query
def variants_decomposed_multiallelic(spark, sf_dir):
    return variants.decompose_substitutions(variants_filtered(spark, sf_dir), split_multiallelic=True)


@query
def variant_marker_states(spark, sf_dir):
    mutations = variants.to_mutations(variants_decomposed(spark, sf_dir))
    return genotype.marker_states(marker_coverage(spark, sf_dir), mutations, refdata.markers(spark))


@query
def pileup_counts(spark, sf_dir):
    return pileup.pileup(bridge.bases(spark, sf_dir), contig=refdata.CONTIG)


@query
def haploid_calls(spark, sf_dir):
    return pileup.call_haploid(pileup_counts(spark, sf_dir), refdata.markers(spark))


@query
def haploid_calls_legacy(spark, sf_dir):
    return pileup.legacy_call_haploid(bridge.bases(spark, sf_dir), refdata.markers(spark))


@query
def genotype_costs(spark, sf_dir):
    return likelihood.genotype_costs(bridge.bases(spark, sf_dir), contig=refdata.CONTIG)


@query
def haploid_likelihoods(spark, sf_dir):
    return likelihood.call_by_likelihood(genotype_costs(spark, sf_dir), refdata.markers(spark))


@query
def likely_marker_states(spark, sf_dir):
    """Marker states from calls by likelihood that pass the quality filter."""
    called = variants.normalise_variants(haploid_likelihoods(spark, sf_dir))
    mutations = variants.to_mutations(variants.decompose_substitutions(called))
    return genotype.marker_states(marker_coverage(spark, sf_dir), mutations, refdata.markers(spark))


@query
def marker_states(spark, sf_dir):
    mutations = pileup.to_mutations(haploid_calls(spark, sf_dir))
    return genotype.marker_states(marker_coverage(spark, sf_dir), mutations, refdata.markers(spark))


@query
def complete_samples(spark, sf_dir):
    """Samples whose coverage and mutation steps have both finished, by the listings of their outputs."""
    outputs = bridge.from_tables(spark, sf_dir, bridge.STEP_OUTPUTS)
    return genotype.complete_samples(*[outputs.where(F.col("step") == step) for step in ("coverage", "mutations")])


# Scores and calls


@query
def profiles_long(spark, sf_dir):
    wide = bridge.isolates(spark, sf_dir)
    renamed = {c: c.removeprefix("pos_") for c in wide.columns}
    return scoring.long_profiles(wide.withColumnsRenamed({**renamed, "seqname": "clade"}), "isolates")


@query
def profiles_by_system(spark, sf_dir):
    """The isolates written as a wide file of profiles for each of three systems, and all of them read by their prefix."""
    folder = shared_folder(spark, "profiles")
    wide = bridge.isolates(spark, sf_dir).withColumnRenamed("seqname", "clade")
    wide = wide.withColumnsRenamed({c: c.removeprefix("pos_") for c in wide.columns})
    for number, system in enumerate(bridge.PROFILE_SYSTEMS):
        write_table(wide.where(F.right("clade", F.lit(3)).cast("int") % 3 == number), f"{folder}/strains_{system}.csv", "csv")
    return readers.read_profiles(spark, f"{folder}/strains", bridge.PROFILE_SYSTEMS, refdata.POSITIONS, refdata.CONTIG)


@query
def clade_scores(spark, sf_dir):
    return scoring.score_profiles(marker_states(spark, sf_dir), refdata.profiles(spark))


@query
def customer_scores(spark, sf_dir):
    """The sequenced samples against a profile per customer, more than the limit given here allows to broadcast."""
    profiles = bridge.customer_profiles(spark, sf_dir)
    return scoring.score_profiles(marker_states(spark, sf_dir), profiles, max_rows=0)


@query
def isolate_scores(spark, sf_dir):
    return scoring.score_profiles(bridge.isolate_states(spark, sf_dir), refdata.profiles(spark))


@query
def best_clades(spark, sf_dir):
    return scoring.best_clades(isolate_scores(spark, sf_dir))


@query
def clade_calls(spark, sf_dir):
    return scoring.clade_calls(clade_scores(spark, sf_dir))


@query
def clade_calls_cutoff(spark, sf_dir):
    return scoring.clade_calls_cutoff(isolate_scores(spark, sf_dir))


# Cohort tables


@query
def cohort_states(spark, sf_dir):
    return cohort.combine(marker_states(spark, sf_dir), bridge.isolate_states(spark, sf_dir))


@query
def cohort_scores(spark, sf_dir):
    return scoring.sort_scores(scoring.score_profiles(cohort_states(spark, sf_dir), refdata.profiles(spark)))


@query
def marker_profiles(spark, sf_dir):
    return cohort.report(cohort.marker_profiles(marker_states(spark, sf_dir), refdata.SITES), "sample_id")


@query
def marker_coverages(spark, sf_dir):
    return cohort.report(cohort.marker_coverages(marker_states(spark, sf_dir), refdata.SITES), "sample_id")


@query
def clade_calls_wide(spark, sf_dir):
    return cohort.report(
        cohort.clade_calls_wide(
            clade_calls(spark, sf_dir), refdata.naming_systems(spark), list(refdata.SYSTEM_LABELS_BY_ID.values())
        ),
        "sample_id",
    )


@query
def score_matrix(spark, sf_dir):
    return cohort.score_matrix(clade_scores(spark, sf_dir), refdata.SCORE_COLUMNS)


@query
def part_marker_profiles(spark, sf_dir):
    """The matrix of another panel, a marker per nation on two contigs."""
    markers = bridge.from_tables(spark, sf_dir, bridge.NATION_MARKERS)
    reads = bridge.reads(spark, sf_dir)
    coverage = intervals.marker_fragments(reads, markers, bridge.samples(spark, sf_dir))
    mutations = variants.to_mutations(variants_decomposed(spark, sf_dir)).where("alt = 'A'")
    mutations = mutations.select("sample_id", "chrom", "pos", "alt", "is_mutated").distinct()
    states = genotype.marker_states(coverage, mutations, markers)
    return cohort.report(cohort.marker_profiles(states, bridge.NATION_SITES), "sample_id")


@query
def wide_marker_coverages(spark, sf_dir):
    """The coverage matrix of a dense panel, some hundred columns on two contigs."""
    markers = bridge.from_tables(spark, sf_dir, bridge.DENSE_MARKERS)
    coverage = intervals.marker_fragments(bridge.reads(spark, sf_dir), markers, bridge.samples(spark, sf_dir))
    return cohort.marker_coverages(coverage, bridge.DENSE_SITES)


@query
def score_cells(spark, sf_dir):
    return cohort.score_cells(clade_scores(spark, sf_dir), refdata.colours(spark))


@query
def column_groups(spark, sf_dir):
    return cohort.column_groups(clade_scores(spark, sf_dir), refdata.naming_systems(spark))


@query
def profile_cells(spark, sf_dir):
    return cohort.profile_cells(marker_states(spark, sf_dir))


@query
def coverage_cells(spark, sf_dir):
    return cohort.coverage_cells(marker_states(spark, sf_dir))


# Panel design


@query
def isolate_alleles(spark, sf_dir):
    return panel.isolate_alleles(bridge.sequences(spark, sf_dir), refdata.markers(spark))


@query
def isolates_wide(spark, sf_dir):
    return cohort.report(panel.isolates_wide(bridge.isolate_alleles(spark, sf_dir), refdata.POSITIONS), "seqname")


@query
def panel_alleles(spark, sf_dir):
    clades = bridge.from_tables(spark, sf_dir, bridge.ISOLATE_CLADES)
    return panel.panel_alleles(bridge.isolates(spark, sf_dir), clades)


@query
def panel_allele_counts(spark, sf_dir):
    return panel.allele_counts(panel_alleles(spark, sf_dir))


@query
def panel_allele_summary(spark, sf_dir):
    return panel.allele_summary(panel_allele_counts(spark, sf_dir))


@query
def panel_by_system(spark, sf_dir):
    return panel.allele_counts_by_system(panel_alleles(spark, sf_dir))


@query
def panel_matrix(spark, sf_dir):
    return cohort.report(panel.panel_matrix(panel_allele_summary(spark, sf_dir), refdata.POSITIONS), "clade")


@query
def base_composition(spark, sf_dir):
    return panel.base_composition(panel_alleles(spark, sf_dir))


# Catalog


@query
def read_pairs(spark, sf_dir):
    return catalog.pair_files(bridge.from_tables(spark, sf_dir, bridge.READ_FILES))


@query
def read_pairs_allowed(spark, sf_dir):
    return catalog.drop_blacklisted(read_pairs(spark, sf_dir), bridge.BLACKLIST)


@query
def read_pairs_not_listed(spark, sf_dir):
    """The blacklist as a table of patterns."""
    patterns = bridge.from_tables(spark, sf_dir, bridge.PATTERNS)
    return catalog.drop_blacklisted(read_pairs(spark, sf_dir), patterns)


@query
def read_pairs_off_long_list(spark, sf_dir):
    """A blacklist with a pattern for every part."""
    patterns = bridge.from_tables(spark, sf_dir, bridge.MANY_PATTERNS)
    return catalog.drop_blacklisted(read_pairs(spark, sf_dir), patterns)


@query
def file_manifest(spark, sf_dir):
    return catalog.file_manifest(bridge.from_tables(spark, sf_dir, bridge.FILES))


@query
def file_sizes(spark, sf_dir):
    files = bridge.from_tables(spark, sf_dir, bridge.FILES)
    return catalog.refresh_sizes(files, bridge.from_tables(spark, sf_dir, bridge.LISTING))


@query
def project_files(spark, sf_dir):
    return catalog.project_files(
        bridge.from_tables(spark, sf_dir, bridge.PROJECTS),
        bridge.from_tables(spark, sf_dir, bridge.PROJECT_FILES),
        bridge.from_tables(spark, sf_dir, bridge.FILES),
    )


@query
def run_files(spark, sf_dir):
    return catalog.run_files(
        catalog.known_runs(bridge.run_log(spark, sf_dir)),
        bridge.from_tables(spark, sf_dir, bridge.RUN_FILES),
        bridge.from_tables(spark, sf_dir, bridge.FILES),
    )


@query
def account_by_id(spark, sf_dir):
    return catalog.lookup(bridge.from_tables(spark, sf_dir, bridge.ACCOUNTS), "account_id", bridge.SOME_ACCOUNT)


def _runs(spark, sf_dir):
    named = F.concat(F.lit("run-project ("), F.col("run_id"), F.lit(")"))
    return catalog.run_status(_committed(spark, sf_dir)).withColumn("name", named)


def _committed(spark, sf_dir):
    return catalog.committed(bridge.run_log(spark, sf_dir))


@query
def account_tree(spark, sf_dir):
    return catalog.account_tree(
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNTS),
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNT_PROJECTS),
        bridge.from_tables(spark, sf_dir, bridge.PROJECTS),
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNT_RUNS),
        _runs(spark, sf_dir),
    )


@query
def account_counts(spark, sf_dir):
    return catalog.account_counts(
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNTS),
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNT_PROJECTS),
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNT_RUNS),
    )


@query
def active_links(spark, sf_dir):
    return catalog.unlink(
        bridge.from_tables(spark, sf_dir, bridge.ACCOUNT_PROJECTS),
        bridge.from_tables(spark, sf_dir, bridge.REMOVED_PROJECTS),
    )


@query
def earliest_projects(spark, sf_dir):
    return catalog.earliest_projects(bridge.from_tables(spark, sf_dir, bridge.PROJECTS))


# Run history


@query
def run_status(spark, sf_dir):
    return catalog.run_status(_committed(spark, sf_dir))


@query
def run_status_asof(spark, sf_dir):
    return catalog.run_status_asof(_committed(spark, sf_dir), bridge.AS_OF)


@query
def run_actions(spark, sf_dir):
    return catalog.run_actions(run_status(spark, sf_dir).select("run_id", "status"))


@query
def pending_runs(spark, sf_dir):
    return catalog.pending_runs(_committed(spark, sf_dir))


@query
def next_run(spark, sf_dir):
    return catalog.pending_runs(_committed(spark, sf_dir), n=1)


@query
def pending_from_store(spark, sf_dir):
    """The log judged in three parts as it grows, and a look at the stored states."""
    folder = shared_folder(spark, "run-store")
    run_store.create(spark, folder)
    log = bridge.run_log(spark, sf_dir)
    borders = ["2024-01-01", "2024-01-12", "2024-01-21", "2024-03-01"]
    for batch, (first, end) in enumerate(zip(borders, borders[1:], strict=False)):
        run_store.extend(log.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(end))), folder, batch)
    return run_store.pending_runs(spark, folder)


@query
def run_transitions(spark, sf_dir):
    return catalog.run_transitions(bridge.run_log(spark, sf_dir)).drop("message")


@query
def run_transitions_any(spark, sf_dir):
    """Another table of transitions, under which the event before does not decide."""
    return catalog.run_transitions(bridge.run_log(spark, sf_dir), transitions=bridge.OTHER_TRANSITIONS).drop("message")


@query
def facts_with_commit_time(spark, sf_dir):
    """Facts joined with their transactions, more than the limit given here allows to broadcast."""
    facts, transactions = (bridge.from_tables(spark, sf_dir, t) for t in (bridge.FACTS, bridge.TRANSACTIONS))
    return catalog.with_commit_time(facts, transactions, max_rows=0)


@query
def current_facts(spark, sf_dir):
    return catalog.current_values(facts_with_commit_time(spark, sf_dir), ["status", "message"])


@query
def pending_by_commit_time(spark, sf_dir):
    return catalog.pending_entities(facts_with_commit_time(spark, sf_dir))


@query
def overwritten_stops(spark, sf_dir):
    return catalog.overwritten_stops(bridge.run_log(spark, sf_dir))


# Streams


@query
def stream_scores(spark, sf_dir):
    folder = shared_folder(spark, "stream-scores")
    arrived = f"{folder}/states"
    # One file holds all states of its samples.
    marker_states(spark, sf_dir).repartition("sample_id").write.parquet(arrived)
    schema = spark.read.parquet(arrived).schema
    states = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(arrived)
    jobs.stream_scores(states, refdata.profiles(spark), f"{folder}/out", f"{folder}/log").awaitTermination()
    return jobs.newest(spark, f"{folder}/out", "sample_id")


@query
def stream_run_status(spark, sf_dir):
    folder = shared_folder(spark, "stream-run-status")
    arrived = f"{folder}/log"
    _committed(spark, sf_dir).write.parquet(arrived)
    log = spark.readStream.schema(spark.read.parquet(arrived).schema).option("maxFilesPerTrigger", 3).parquet(arrived)
    jobs.stream_run_status(log, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.newest(spark, f"{folder}/out", "run_id")


def _in_parts(rows, name, n):
    """A folder that files are added to one after the other, and the stream of it: a part of the rows (``part``) in each."""
    folder = shared_folder(rows.sparkSession, name)
    dealt = stored(rows, f"{name}-parts")
    for part in range(n):
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = rows.sparkSession.readStream.schema(dealt.drop("part").schema).option("maxFilesPerTrigger", 1)
    return folder, stream.parquet(f"{folder}/in")


@query
def stream_gathered_scores(spark, sf_dir):
    """The states of a sample dealt over three files that arrive an hour apart."""
    part = F.pmod(F.xxhash64("sample_id", "pos"), F.lit(3)).cast("int")
    arrived = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("part"))
    folder, states = _in_parts(marker_states(spark, sf_dir).withColumn("part", part).withColumn("arrived", arrived), "gathered-scores", 3)
    jobs.stream_gathered_scores(states, refdata.profiles(spark), f"{folder}/out", f"{folder}/log").awaitTermination()
    return jobs.newest(spark, f"{folder}/out", "sample_id")


@query
def stream_judged_status(spark, sf_dir):
    """The raw log in parts of ten days: every ninth event comes a part late, and every tenth a second time."""
    log = bridge.run_log(spark, sf_dir).withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"))
    late = log.withColumn("part", F.when(F.col("event_id") % 9 == 0, F.col("part") + 1).otherwise(F.col("part")))
    again = log.where("event_id % 10 = 0").withColumn("part", F.col("part") + 1)
    folder, events = _in_parts(late.unionByName(again), "judged-status", 5)
    jobs.stream_judged_status(events, f"{folder}/out", f"{folder}/log", lateness="30 days").awaitTermination()
    return jobs.newest(spark, f"{folder}/out", "run_id").where("status IS NOT NULL OR message IS NOT NULL")


# Files at the edges, as lines derived from the tables


@query
def parsed_variants(spark, sf_dir):
    return readers.parse_variants(bridge.from_tables(spark, sf_dir, bridge.VARIANT_LINES))


@query
def parsed_target_coverage(spark, sf_dir):
    return readers.parse_target_coverage(bridge.from_tables(spark, sf_dir, bridge.COVERAGE_LINES))


@query
def parsed_mutations(spark, sf_dir):
    lines = bridge.from_tables(spark, sf_dir, bridge.MUTATION_LINES)
    return readers.parse_mutations(lines, refdata.CONTIG)


@query
def parsed_markers(spark, sf_dir):
    return readers.parse_markers(bridge.from_tables(spark, sf_dir, bridge.MARKER_LINES))


@query
def parsed_marker_states(spark, sf_dir):
    return readers.parse_cohort(bridge.from_tables(spark, sf_dir, bridge.STATE_LINES))


@query
def parsed_profile_sheet(spark, sf_dir):
    return readers.parse_profile_sheet(bridge.from_tables(spark, sf_dir, bridge.SHEET_LINES), ["X", "Y"], "legacy")


@query
def exported_marker_states(spark, sf_dir):
    """The marker states written as CSV and read back."""
    folder = shared_folder(spark, "export")
    states = marker_states(spark, sf_dir)
    write_table(states, folder, "csv")
    return spark.read.schema(states.schema).options(header=True, nullValue="", emptyValue="").csv(folder)
