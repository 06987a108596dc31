"""Interval operators against goldens and per-base brute force."""

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cladespark.functions import tables
from cladespark.operators import interval_levels, intervals
from cladespark.plans import bridge
from tests.conftest import rows_of

READS = "sample_id string, chrom string, start long, end long"
TARGETS = "chrom string, start long, end long"


def random_reads(rng, n, span, longest, samples=("a", "b", "hot")):
    out = []
    for _ in range(n):
        start = rng.randrange(span)
        sample = "hot" if rng.random() < 0.5 else rng.choice(samples)
        out.append((sample, rng.choice(("c1", "c1", "c2")), start, start + rng.randrange(1, longest)))
    return out


def depth_by_base(reads, sample, chrom, length):
    depth = [0] * length
    for s, c, start, end in reads:
        if (s, c) == (sample, chrom):
            for p in range(start, min(end, length)):
                depth[p] += 1
    return depth


def test_depth_golden(table):
    reads = table(READS, [("s", "c", 2, 6), ("s", "c", 4, 10), ("s", "c", 10, 12)])
    contigs = table("chrom string, length long", [("c", 20)])
    runs = intervals.depth_runs(reads, contigs, intervals.sample_ids(reads))
    assert rows_of(runs.orderBy("start"), "start", "end", "depth") == sorted(
        [(0, 2, 0), (2, 4, 1), (4, 6, 2), (6, 12, 1), (12, 20, 0)], key=repr)
    assert rows_of(intervals.uncovered(runs), "start", "end") == [(0, 2), (12, 20)]


@pytest.mark.parametrize("tile", [1, 7, 16, 100_000])
def test_depth_runs_against_per_base_count(table, tile):
    rng = random.Random(tile)
    reads = random_reads(rng, 150, 190, 60) + [("a", "c1", 0, 200), ("a", "c1", 48, 112), ("a", "c1", 16, 16)]
    contigs = {"c1": 200, "c2": 230, "empty": 33}
    samples = table("sample_id string", [("a",), ("b",), ("hot",)])
    runs = intervals.depth_runs(table(READS, reads), table("chrom string, length long", contigs.items()), samples, tile=tile)
    found = {}
    for r in runs.collect():
        found.setdefault((r.sample_id, r.chrom), []).append((r.start, r.end, r.depth))
    assert set(found) == {(s, c) for s in ("a", "b", "hot") for c in contigs}
    for (sample, chrom), pieces in found.items():
        pieces.sort()
        depth = depth_by_base(reads, sample, chrom, contigs[chrom])
        assert [d for start, end, d in pieces for _ in range(start, end)] == depth
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(pieces, pieces[1:]))
        assert sum(end - start for start, end, _ in pieces) == contigs[chrom]


@pytest.mark.parametrize("bin_width", [1, 8, 4096])
@pytest.mark.parametrize("broadcast", [True, False])
def test_target_coverage_against_brute_force(table, bin_width, broadcast):
    rng = random.Random(bin_width)
    reads = random_reads(rng, 120, 150, 50)
    targets = [(rng.choice(("c1", "c2", "c3")), s, s + rng.randrange(1, 40)) for s in range(0, 150, 9)]
    samples = table("sample_id string", [("a",), ("b",), ("hot",)])
    limit = 10_000 if broadcast else 0
    out = intervals.target_coverage(table(READS, reads), table(TARGETS, targets), samples, bin_width, limit)
    found = {(r.sample_id, r.chrom, r.start, r.end): r for r in out.collect()}
    assert len(found) == 3 * len(set(targets))
    for (sample, chrom, start, end), row in found.items():
        hits = [r for r in reads if r[:2] == (sample, chrom) and r[2] < end and start < r[3]]
        covered = {p for r in hits for p in range(max(start, r[2]), min(end, r[3]))}
        assert (row.n_covering_frags, row.n_covered_bases, row["size"]) == (len(hits), len(covered), end - start)
        assert row.frac_covered == len(covered) / (end - start)
        assert row.n_covered_bases <= row["size"]


def test_target_fragments_keep_uncovered_targets(table):
    reads = table(READS, [("s", "c", 0, 5), ("s", "c", 0, 5), ("t", "c", 90, 99)])
    targets = table(TARGETS, [("c", 4, 5), ("c", 5, 6)])
    samples = intervals.sample_ids(reads)
    out = intervals.coverage_by_position(intervals.target_fragments(reads, targets, samples))
    assert rows_of(out, "sample_id", "pos", "n_covering_frags") == [
        ("s", 5, 2), ("s", 6, 0), ("t", 5, 0), ("t", 6, 0)]
    markers = intervals.targets_to_markers(targets)
    for limit in (10, 0):
        assert rows_of(intervals.marker_fragments(reads, markers, samples, max_rows=limit)) == rows_of(
            out.select("sample_id", "chrom", "pos", "n_covering_frags"))


def test_targets_without_a_base_and_named_targets(table):
    reads = table(READS, [("s", "c", 0, 10), ("s", "c", 3, 3)])
    targets = table(f"{TARGETS}, name string", [("c", 5, 5, "none"), ("c", 7, 6, "back"), ("c", 2, 8, "x"), ("c", 2, 8, "y")])
    out = intervals.target_coverage(reads, targets, table("sample_id string", [("s",), ("t",)]))
    assert rows_of(out.where("sample_id = 's'"), "name", "n_covering_frags", "n_covered_bases", "size", "frac_covered") == [
        ("back", 0, 0, 0, None), ("none", 0, 0, 0, None), ("x", 1, 6, 6, 1.0), ("y", 1, 6, 6, 1.0)]
    assert rows_of(out.where("sample_id = 't'"), "name", "size") == [("back", 0), ("none", 0), ("x", 6), ("y", 6)]


@pytest.mark.parametrize("limit, unrolled, at_least", [(10_000, 1000, 40), (0, 1000, 20), (10_000, 10**9, 8)])
def test_named_lines_are_dealt_by_the_rows_that_go_out(table, monkeypatch, limit, unrolled, at_least):
    """Few bytes of measured targets become 45,600 rows: neither their size nor a target with nearly all lines decides how many tasks make them."""
    monkeypatch.setattr(tables, "TASK_UNROLLED", unrolled)
    monkeypatch.setattr(intervals, "LIST_LINES", 7, raising=False)
    rng = random.Random(4)
    lines = [("c1", 10, 60, f"name {i}") for i in range(110)] + [("c1", 10, 60, "name 3"), ("c1", 10, 60, None), ("c1", 5, 5, "none"), ("c2", 0, 9, "z")]
    reads = [(f"s{rng.randrange(400)}", *r[1:]) for r in random_reads(rng, 600, 90, 50)]
    samples = table("sample_id string", [(f"s{i}",) for i in range(400)])
    args = (table(READS, reads), table(f"{TARGETS}, name string", lines), samples)
    out = intervals.target_coverage(*args, max_rows=limit).withColumn("task", F.spark_partition_id()).collect()
    bare = intervals.target_coverage(args[0], args[1].drop("name"), samples, max_rows=limit).collect()
    by_target = {(r.sample_id, r.chrom, r.start, r.end): tuple(r[4:]) for r in bare}
    expected = Counter((f"s{i}", *line, *by_target[f"s{i}", *line[:3]]) for i in range(400) for line in lines)
    columns = ("sample_id", *TARGETS.replace(" string", "").replace(" long", "").split(", "), "name")
    values = ("n_covering_frags", "n_covered_bases", "size", "frac_covered")
    assert Counter(tuple(r[c] for c in (*columns, *values)) for r in out) == expected
    tasks = Counter(r.task for r in out)
    assert len(tasks) >= at_least and max(tasks.values()) < len(out) * 2 / at_least


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_giant_targets_are_one_row_each(spark, table):
    """A thousand targets of a chromosome each are very many bins of one width, and a thousand rows at their own level."""
    targets = spark.range(1000).selectExpr("'c' AS chrom", "id AS start", "200000000 + id AS end")
    assert intervals.binned_rows(targets, intervals.BIN_WIDTH) > 48_000_000
    counts = interval_levels.placed_counts(targets, intervals.BIN_WIDTH)
    assert sum(r["n"] for r in counts.collect()) == 1000
    reads = table(READS, [("s", "c", 0, 5), ("s", "c", 500, 502), ("t", "c", 199_999_990, 300_000_000)])
    samples = table("sample_id string", [("s",), ("t",)])
    out = intervals.target_fragments(reads, targets, samples)
    assert [r[0] for r in out.groupBy("n_covering_frags").count().orderBy("n_covering_frags").select("count").collect()] == [498, 1497, 5]
    assert "BroadcastExchange" in executed(intervals.overlaps(reads, targets.limit(2)))


LENGTHS = (0, 1, 2, 5, 9, 60, 300, 4000, 200_000)


@pytest.mark.parametrize("width", [1, 4, 4096])
@pytest.mark.parametrize("share_rows", [3, 100_000])
def test_levels_give_every_pair_once(table, width, share_rows):
    """Intervals of all lengths on both sides, a crowded place, and shares so small that most bins are split."""
    rng = random.Random(width)

    def some(n, tag):
        starts = [rng.choice([rng.randrange(300), rng.randrange(300_000), 77]) for _ in range(n)]
        return [(f"{tag}{i}", rng.choice(("c1", "c1", "c2")), s, s + rng.choice(LENGTHS)) for i, s in enumerate(starts)]

    one, other = some(150, "r"), some(120, "t")
    out = interval_levels.overlapping(
        table("name string, chrom string, start long, end long", one), table("target string, chrom string, start long, end long", other), width, share_rows
    )
    found = rows_of(out, "name", "target", "start", "t_end")
    assert found == sorted(
        ((a[0], b[0], a[2], b[3]) for a in one for b in other if a[1] == b[1] and max(a[2], b[2]) < min(a[3], b[3])), key=repr
    )


def test_a_crowded_bin_is_many_shares_on_both_sides(spark):
    one = spark.range(5000).selectExpr("'c' AS chrom", "id % 100 AS start", "id % 100 + 1000 AS end", "id")
    other = spark.range(900).selectExpr("'c' AS chrom", "id % 90 AS start", "id % 90 + 800 AS end", "id AS target")
    counts = [interval_levels.placed_counts(x, 4096) for x in (one, other)]
    keys = [c.select("*", F.lit(0).alias("kind")).withColumnRenamed("n", n) for c, n in zip(counts, ("n_one", "n_other"), strict=True)]
    crowded = interval_levels.crowded_keys(*keys, 500).collect()
    assert [(r["one_shares"], r["other_shares"]) for r in crowded] == [(10, 2)]
    assert interval_levels.overlapping(one, other, 4096, 500).count() == 5000 * 900


def test_levels_of_empty_tables(table):
    none, some = table(READS, []), table(TARGETS, [("c", 1, 5)])
    assert rows_of(interval_levels.overlapping(none, some, 8)) == []
    assert rows_of(interval_levels.overlapping(some, none.withColumnRenamed("sample_id", "name"), 8)) == []


@pytest.mark.parametrize("per_part", [1, 3, 512])
def test_zeros_are_filled_in_as_arrays_are_unrolled(table, per_part):
    rng = random.Random(per_part)
    panel = [("c", i) for i in range(40)]
    counts = [(f"s{rng.randrange(6)}", *rng.choice(panel), rng.randrange(1, 9)) for _ in range(90)]
    rows = [("s0",), ("s1",), ("s2",), ("none",)]
    out = tables.with_zeros(
        table("k string, chrom string, pos long, n long", counts), table("k string", rows), table("chrom string, pos long", panel), ["n"], per_part
    )
    sums = Counter()
    for k, chrom, pos, n in counts:
        sums[k, chrom, pos] += n
    every = {(k, *p): 0 for k, in rows for p in panel} | dict(sums)
    assert rows_of(out, "k", "chrom", "pos", "n") == sorted(((*k, n) for k, n in every.items()), key=repr)


def test_contigs_do_not_decide_where_reads_go(spark):
    """Contigs whose size the planner does not know are counted and broadcast: nothing is shuffled by contig alone."""
    reads = spark.range(100).selectExpr("'s' AS sample_id", "concat('c', id % 2) AS chrom", "id AS start", "id + 5 AS end")
    contigs = spark.range(1000).where("id * id < 4").selectExpr("concat('c', id) AS chrom", "id + 100000 AS length")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(intervals.depth_runs(reads, contigs, reads.select("sample_id").distinct()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(chrom" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_scan_of_the_reads_just_for_the_samples(spark):
    from cladespark.plans import registry

    for name in ("target_coverage", "depth_runs"):
        plan = executed(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        scans = [line for line in plan.splitlines() if "FileScan" in line and "l_suppkey" in line]
        assert scans and all("l_orderkey" in line for line in scans)
        assert name != "target_coverage" or len(scans) == 1


def test_row_order_does_not_matter(table):
    rng = random.Random(3)
    reads = random_reads(rng, 80, 100, 30)
    targets = table(TARGETS, [("c1", 10, 60), ("c2", 0, 100)])
    samples = table("sample_id string", [("a",), ("b",), ("hot",)])
    first = rows_of(intervals.target_coverage(table(READS, reads), targets, samples))
    rng.shuffle(reads)
    assert rows_of(intervals.target_coverage(table(READS, reads), targets, samples)) == first


def test_large_panel_gives_the_same_rows(table):
    rows = table("sample_id string", [(f"s{i}",) for i in range(20)])
    panel = table("chrom string, pos long", [("c", i) for i in range(50)])
    small = rows_of(tables.with_panel(rows, panel))
    assert len(small) == 1000
    assert rows_of(tables.with_panel(rows, panel, max_rows=7)) == small


def test_markers_and_targets(table):
    markers = table("chrom string, pos long, ref string", [("c", 241, "C")])
    targets = intervals.markers_to_targets(markers)
    assert rows_of(targets) == [("c", 240, 241)]
    assert rows_of(intervals.targets_to_markers(targets)) == [("c", 241)]


def test_sorted_layout(table):
    rng = random.Random(5)
    reads = random_reads(rng, 200, 1000, 50)
    out = [tuple(r) for r in intervals.sort_reads(table(READS, reads)).collect()]
    keys = [(r[1], r[2], r[3], r[0]) for r in out]
    assert keys == sorted(keys) and all(r[0] == r[4] for r in out)
    assert Counter(r[:4] for r in out) == Counter(reads)


def test_samples_and_isolates_are_dealt_before_they_are_unrolled(spark, monkeypatch):
    """A table of one small file is read by one task, which held all the rows its samples are unrolled to."""
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    samples = spark.range(0, 200, 1, 1).selectExpr("concat('S', id) AS sample_id")
    panel = spark.range(100).selectExpr("'c' AS chrom", "id + 1 AS pos")
    every = intervals._for_every_sample(samples, panel)
    held = [r[0] for r in every.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(held) == 200 * 100 and len(held) > 10 and max(held) < 5 * 1000
    assert rows_of(every) == rows_of(samples.crossJoin(panel))
    few = tables.dealt(samples, 4, "sample_id")
    assert few.rdd.getNumPartitions() == 1 and rows_of(few) == rows_of(samples)
    alleles = bridge.isolate_alleles(spark, "/root/testdata/sf0.001")
    dealt_to = alleles.groupBy(F.spark_partition_id()).count().collect()
    monkeypatch.undo()
    whole = bridge.isolate_alleles(spark, "/root/testdata/sf0.001")
    assert len(dealt_to) > 1 and rows_of(alleles) == rows_of(whole)


def test_no_overlap_of_a_large_panel_is_moved(table):
    """100 samples whose read lies on all of 200 targets are 20,000 overlaps; reads and targets are moved, and neither overlaps nor zeros."""
    reads = table(READS, [(f"s{i}", "c", 50, 500) for i in range(100)])
    targets = table(TARGETS, [("c", i, i + 300) for i in range(200)] + [("c", 900, 910), ("d", 0, 600)])
    out = intervals.target_fragments(reads, targets, table("sample_id string", [(f"s{i}",) for i in range(99)] + [("none",)]), max_rows=0)
    assert Counter(r["n_covering_frags"] for r in out.collect()) == {1: 20_000, 0: 99 * 2 + 202}
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
    assert moved and max(moved) < 20_000


def test_large_panel_of_short_and_long_targets_against_brute_force(table):
    """Both contigs, lengths of several levels in parts of a few, samples that are not listed, reads and targets without a base."""
    rng = random.Random(8)
    spans = lambda n: [(rng.choice(("c", "d")), s, s + rng.choice(LENGTHS)) for s in (rng.randrange(20_000) for _ in range(n))]
    reads = [(rng.choice(("a", "b", "stray")), *span) for span in spans(120)] * 2
    targets = spans(60)
    out = intervals.target_fragments(table(READS, reads), table(TARGETS, targets * 2), table("sample_id string", [("a",), ("b",), ("none",)]), 16, 0)
    expected = {(s, *t): 0 for s in ("a", "b", "none") for t in targets}
    for sample, chrom, start, end in reads:
        for t in set(targets):
            if t[0] == chrom and max(start, t[1]) < min(end, t[2]):
                expected[sample, *t] = expected.get((sample, *t), 0) + 1
    assert rows_of(out, "sample_id", *("chrom", "start", "end"), "n_covering_frags") == sorted(((*k, n) for k, n in expected.items()), key=repr)


def test_named_lines_are_written_side_by_side(spark, tmp_path):
    """200 samples and 40 targets of 1,000 names each, in two lists: a file keeps a name once and not in every row of it."""
    samples = spark.range(200).selectExpr("concat('s', id) AS sample_id")
    lines = spark.range(40_000).selectExpr("'c' AS chrom", "id % 40 * 50 AS start", "id % 40 * 50 + id % 5 * 20 AS `end`", "concat('target ', id) AS name")
    reads = spark.range(4_000).selectExpr("concat('s', id % 200) AS sample_id", "'c' AS chrom", "id * 37 % 2000 AS start", "id * 37 % 2000 + 60 AS `end`")
    intervals.target_coverage(reads, lines, samples).write.parquet(f"{tmp_path}/out")
    written = spark.read.parquet(f"{tmp_path}/out")
    bare = intervals.target_coverage(reads, lines.drop("name").distinct(), samples)
    names = written.groupBy(*bare.columns).agg(F.count("*"), F.count_distinct("name")).collect()
    assert {tuple(r[-2:]) for r in names} == {(1000, 1000)} and sorted(map(repr, (r[:-2] for r in names))) == sorted(map(repr, map(tuple, bare.collect())))
    parts = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/*.parquet")]
    groups = [m.row_group(g) for m in parts for g in range(m.num_row_groups)]
    assert sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns)) < 200 * 40_000
