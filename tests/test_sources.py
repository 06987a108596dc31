"""Files at the edges."""

import pytest
from pyspark.sql import functions as F

from cladespark import refdata, schemas
from cladespark.operators import genotype, intervals, scoring, variants
from cladespark.sources import readers, writers
from tests.conftest import rows_of
from test_scoring import CALLS, M1, M2


def test_variants(spark, tmp_path):
    (tmp_path / "s 1.vcf").write_text(
        "##header\n#CHROM\tPOS\n"
        "c\t241\t.\tC\tT\t31925.6\t.\tDP=3\tGT\t1\n"
        "c\t300\trs1\tGG\tTA\t.\tPASS\tDP=3\tGT\t1\n"
    )
    df = readers.read_variants(spark, str(tmp_path))
    assert rows_of(df, "sample_id", "chrom", "pos", "id", "ref", "alt", "qual") == [
        ("s 1", "c", 241, ".", "C", "T", 31925.6), ("s 1", "c", 300, "rs1", "GG", "TA", None)]


def test_target_coverage_to_csv(spark, tmp_path):
    (tmp_path / "s1_coverage.bed").write_text("MN908947.3\t240\t241\t1113\t1\t1\t1.0000000\n")
    df = readers.read_target_coverage(spark, str(tmp_path / "s1_coverage.bed"))
    assert rows_of(df) == [("MN908947.3", 240, 241, 1113, 1, 1, 1.0, "s1")]
    out = str(tmp_path / "out")
    writers.write_table(df.drop("sample_id"), out, "csv")
    text = spark.read.text(out).collect()
    assert text[0][0] == "chrom,start,end,n_covering_frags,n_covered_bases,size,frac_covered"
    (tmp_path / "s1_coverage.csv").write_text("\n".join(r[0] for r in text) + "\n")
    assert rows_of(readers.read_target_coverage_csv(spark, str(tmp_path / "s1_coverage.csv"))) == rows_of(df)


def test_markers_mutations_targets(spark, tmp_path):
    (tmp_path / "markers.csv").write_text("chr,pos,ref\nc,241,C\n")
    (tmp_path / "markers.bed").write_text("c\t240\t241\n")
    (tmp_path / "s1_mutations.csv").write_text("pos,ref,alt,qual,pos_c,ref_c,alt_c\n25563,GGG,TAC,221834,25564,G,A\n")
    assert rows_of(readers.read_markers(spark, str(tmp_path / "markers.csv"))) == [("c", 241, "C")]
    assert rows_of(readers.read_targets(spark, str(tmp_path / "markers.bed"))) == [("c", 240, 241)]
    mutations = readers.read_mutations(spark, str(tmp_path / "*_mutations.csv"), "c")
    assert rows_of(mutations) == [(25563, "GGG", "TAC", 221834.0, 25564, "G", "A", "s1", "c")]


def test_cohort_of_sample_files(spark, tmp_path):
    head = "pos,n_covering_frags,ref,alt,is_mutated,original_ref\n"
    (tmp_path / "s1_markers.csv").write_text(head + "241,3531,C,C,,C\n")
    (tmp_path / "s_2_markers.csv").write_text(head + "241,7,C,?,yes,C\n")
    (tmp_path / "s1_scores_vs_strains.csv").write_text("id,clade,manhattan\ngisaid,G,4\ngisaid,L,\n")
    states = readers.read_cohort(spark, f"{tmp_path}/*_markers.csv")
    assert rows_of(states, "sample_id", "pos", "n_covering_frags", "alt", "is_mutated") == [
        ("s1", 241, 3531, "C", None), ("s_2", 241, 7, "?", "yes")]
    scores = readers.read_cohort_scores(spark, f"{tmp_path}/*_scores_vs_strains.csv")
    assert rows_of(scores) == [("gisaid", "G", 4.0, "s1"), ("gisaid", "L", None, "s1")]


def test_profiles_by_system(spark, tmp_path):
    for system in refdata.CLADE_SUBSTITUTIONS:
        lines = ["clade," + ",".join(map(str, refdata.POSITIONS))]
        for clade in refdata.CLADE_SUBSTITUTIONS[system]:
            lines.append(",".join([clade, *refdata.profile_alleles(system, clade).values()]))
        (tmp_path / f"strains_{system}.csv").write_text("\n".join(lines) + "\n")
    systems = list(refdata.CLADE_SUBSTITUTIONS)
    df = readers.read_profiles(spark, f"{tmp_path}/strains", systems, refdata.POSITIONS, refdata.CONTIG)
    assert rows_of(df) == rows_of(refdata.profiles(spark))


def test_systems_and_colours(spark, tmp_path):
    (tmp_path / "systems.csv").write_text('naming_system,id,link_to_nextstrain\n"Old One",old,https://example.org\n')
    (tmp_path / "colours.csv").write_text("naming_system,clade,color\nold,A,#123456\n")
    assert rows_of(readers.read_naming_systems(spark, str(tmp_path / "systems.csv"))) == [
        ("Old One", "old", "https://example.org")]
    assert rows_of(readers.read_colours(spark, str(tmp_path / "colours.csv"))) == [("old", "A", "#123456")]


def test_profile_sheet(spark, tmp_path):
    (tmp_path / "sheet.txt").write_text(
        "Position\tA\tT\tC\tG\tN\tX\tY\tAA changes\tmarkers for\n"
        "10\t0\t5\t3\t0\t1\tC\tT\tleader, one\tX\n"
        "20\t4\t0\t0\t2\t0\tA\tG\tS:D1G\tY\n"
    )
    df = readers.read_profile_sheet(spark, str(tmp_path / "sheet.txt"), ["X", "Y"], "legacy")
    assert rows_of(df) == [
        ("legacy", "X", 10, "C"), ("legacy", "X", 20, "A"), ("legacy", "Y", 10, "T"), ("legacy", "Y", 20, "G")]


def test_round_trip(spark, tmp_path):
    rows = [(241, 9, "C", None, None, "C"), (1059, 3, "C", "?", "yes", "C")]
    df = spark.createDataFrame(rows, schemas.MARKER_STATES).withColumn("sample_id", F.lit("s1"))
    parquet = str(tmp_path / "states")
    writers.write_table(df, parquet, partition_by=["sample_id"])
    assert rows_of(spark.read.parquet(parquet).select(df.columns)) == rows_of(df)
    csv = str(tmp_path / "csv")
    writers.write_table(df.drop("sample_id"), csv, "csv")
    back = spark.read.schema(schemas.MARKER_STATES).csv(csv, header=True, nullValue="", emptyValue="")
    assert rows_of(back) == rows_of(df.drop("sample_id"))


def test_clustered_files_hold_disjoint_samples(spark, tmp_path):
    path = str(tmp_path / "clustered")
    df = spark.range(4000).selectExpr("concat('S', id % 40) AS sample_id", "id AS pos")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_table(df, path, cluster_by=["sample_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).select("sample_id", F.col("_metadata.file_path").alias("file")).distinct()
    assert files.count() == 40 and files.select("file").distinct().count() > 1


def test_sample_ids_are_taken_as_they_are(spark, tmp_path):
    head = "pos,n_covering_frags,ref,alt,is_mutated,original_ref\n"
    for name in ("a+b", "a b", "a%20b", "ü"):
        (tmp_path / f"{name}_markers.csv").write_text(head + "241,9,C,C,,C\n")
    states = readers.read_cohort(spark, f"{tmp_path}/*_markers.csv")
    assert sorted(r[0] for r in states.select("sample_id").collect()) == sorted(["a+b", "a b", "a%20b", "ü"])
    (tmp_path / "stray.csv").write_text(head + "241,9,C,C,,C\n")
    (tmp_path / "_markers.csv.x").write_text(head)
    with pytest.raises(Exception, match="no sample id in file name stray.csv"):
        readers.read_cohort(spark, f"{tmp_path}/stray.csv").collect()


def test_files_of_a_sample_become_scores(spark, tmp_path):
    """Headed coverage and mutations of each sample, joined to states and scored."""
    columns = "chrom,start,end,n_covering_frags,n_covered_bases,size,frac_covered"
    for sample, changes in (("M1", M1), ("M2", M2)):
        rows = [f"{refdata.CONTIG},{p - 1},{p},100,1,1,1.0" for p in refdata.POSITIONS]
        (tmp_path / f"{sample}_coverage.csv").write_text("\n".join([columns, *rows]) + "\n")
        rows = [f"{p},{dict(refdata.MARKERS)[p]},{a},99,{p},{dict(refdata.MARKERS)[p]},{a}" for p, a in changes.items()]
        (tmp_path / f"{sample}_mutations.csv").write_text("\n".join(["pos,ref,alt,qual,pos_c,ref_c,alt_c", *rows]) + "\n")
    coverage = intervals.coverage_by_position(readers.read_target_coverage_csv(spark, f"{tmp_path}/*_coverage.csv"))
    mutations = variants.to_mutations(readers.read_mutations(spark, f"{tmp_path}/*_mutations.csv", refdata.CONTIG))
    states = genotype.marker_states(coverage, mutations, refdata.markers(spark))
    calls = scoring.clade_calls(scoring.score_profiles(states, refdata.profiles(spark)))
    found = {(r.sample_id, r.id): r.call for r in calls.collect()}
    for sample in ("M1", "M2"):
        assert tuple(found[sample, s] for s in ("gisaid", "new_nextstrain", "old_nextstrain")) == CALLS[sample]
