"""The written order of reads and its index against plain filters."""

import random

import pytest

from cladespark.sources import read_store
from tests.conftest import rows_of

READS = "sample_id string, chrom string, start long, end long, mapq int"
REGIONS = [("c1", 0, 50), ("c1", 700, 701), ("c1", 4000, 9000), ("2", 0, 10**9), ("c1", 10**7, 10**8), ("none", 0, 5), ("c1", 30, 30), ("c1", 60, 20)]


@pytest.fixture
def rows():
    rng = random.Random(6)
    out = [(f"s{rng.randrange(5)}", rng.choice(["c1", "c1", "2"]), s, s + rng.randrange(1, 300), rng.randrange(60))
           for s in (rng.choice([rng.randrange(10_000), 700]) for _ in range(1500))]
    # One read across the whole contig, one without a base, one that is there twice.
    return out + [("long", "c1", 3, 9_500, 1), ("empty", "c1", 40, 40, 1), out[0]]


@pytest.mark.parametrize(("window", "rows_per_file"), [(16, 50), (1024, 100_000)])
def test_regions_against_a_filter(spark, table, tmp_path, rows, window, rows_per_file):
    path = str(tmp_path / "store")
    read_store.write_reads(table(READS, rows), path, window, rows_per_file)
    for chrom, start, end in REGIONS:
        found = read_store.reads_in_region(spark, path, chrom, start, end)
        assert rows_of(found, "sample_id", "chrom", "start", "end", "mapq") == sorted(
            (r for r in rows if r[1] == chrom and max(r[2], start) < min(r[3], end)), key=repr
        )


def test_only_files_that_can_hold_a_region_are_read(spark, table, tmp_path, rows):
    path = str(tmp_path / "store")
    short = [r for r in rows if r[0] != "long"]
    read_store.write_reads(table(READS, short), path, 64, 40)
    every = read_store.reads_index(spark, path).select("file").distinct().count()
    region = read_store.reads_in_region(spark, path, "c1", 5000, 5100)
    able = {r["file"] for r in read_store.reads_index(spark, path).where("chrom = 'c1' AND first_start < 5100 AND last_end > 5000").collect()}
    assert {f.rpartition("/")[2] for f in region.inputFiles()} == {f.rpartition("/")[2] for f in able}
    assert len(able) < every / 4
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(start,5100)" in plan and "GreaterThan(end,5000)" in plan


def test_rows_of_the_index_lie_where_it_says(spark, table, tmp_path, rows):
    path = str(tmp_path / "store")
    read_store.write_reads(table(READS, rows), path, 128, 100)
    stored = read_store._stored(spark, path).selectExpr("_metadata.file_path AS file", "_metadata.row_index AS row", "start", "end")
    by_place = {(r["file"], r["row"]): (r["start"], r["end"]) for r in stored.collect()}
    index = read_store.reads_index(spark, path).collect()
    assert sum(r["last_row"] - r["first_row"] + 1 for r in index) == len(rows) == len(by_place)
    for r in index:
        held = [by_place[r["file"], i] for i in range(r["first_row"], r["last_row"] + 1)]
        assert {start // 128 for start, _ in held} == {r["window"]} and held == sorted(held)
        assert (min(s for s, _ in held), max(e for _, e in held)) == (r["first_start"], r["last_end"])


def test_many_files_are_one_scan_of_the_contig(spark, table, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(read_store, "MOST_FILES", 2)
    path = str(tmp_path / "store")
    read_store.write_reads(table(READS, rows), path, 128, 100)
    found = read_store.reads_in_region(spark, path, "c1", 0, 20_000)
    assert found.count() == sum(r[1] == "c1" and r[2] < r[3] for r in rows)
    assert "PartitionFilters: [isnotnull(chrom" in found._jdf.queryExecution().executedPlan().toString()


def test_empty_store(spark, table, tmp_path):
    path = str(tmp_path / "store")
    read_store.write_reads(table(READS, []), path)
    assert read_store.reads_in_region(spark, path, "c", 0, 10).count() == 0
    read_store.write_reads(table(READS, [("s", "c", 1, 2, 3)]), path)
    read_store.write_reads(table(READS, [("s", "d", 5, 9, 3)]), path)
    assert read_store.reads_in_region(spark, path, "c", 0, 10).count() == 0
    assert read_store.reads_in_region(spark, path, "d", 0, 10).count() == 1
