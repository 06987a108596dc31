"""Interval operators over aligned reads: overlap join, target coverage, depth runs.

Intervals are 0-based and half-open. Reads are (sample_id, chrom, start, end, ...).

The overlap join is an equi-join on bins at any panel size. Targets cut into bins of one width are counted first: up
to a limit they are broadcast, and no read is moved before it is folded by a partial aggregate. Beyond it equal reads are
folded, and both sides are shuffled by bins of several widths (``interval_levels``), where an interval of any length is in
a few bins and a crowded bin is many tasks. All later groups are bounded by a bin or a tile, never by the number of reads of a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions.tables import BROADCAST_ROWS, broadcast_if_small, dealt, deals, fits, in_parts, in_shares, share, unrolled, with_panel, with_zeros
from cladespark.operators.interval_levels import level_of, overlapping

BIN_WIDTH = 4096
TILE_WIDTH = 65536
LIST_LINES = 512
LINE_SHARES = 32
TARGET = ("chrom", "start", "end")


def markers_to_targets(markers: DataFrame) -> DataFrame:
    """1-based marker positions as one-base target intervals."""
    return markers.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))


def targets_to_markers(targets: DataFrame) -> DataFrame:
    """One-base target intervals as 1-based positions."""
    return targets.where(F.col("end") - F.col("start") == 1).select("chrom", F.col("end").alias("pos"))


def _div(value: Column, width: int) -> Column:
    return F.call_function("div", value, F.lit(width))


def _with_bins(intervals: DataFrame, width: int) -> DataFrame:
    bins = F.sequence(_div(F.col("start"), width), _div(F.col("end") - 1, width))
    return intervals.where(F.col("start") < F.col("end")).withColumn("bin", F.explode(bins))


def binned_rows(intervals: DataFrame, width: int) -> int:
    """How many rows the intervals take once they are cut into bins."""
    bins = _div(F.col("end") - 1, width) - _div(F.col("start"), width) + 1
    return intervals.where(F.col("start") < F.col("end")).agg(F.coalesce(F.sum(bins), F.lit(0))).first()[0]


def overlaps(reads: DataFrame, targets: DataFrame, bin_width: int = BIN_WIDTH, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Overlapping (read, target) pairs, one row per bin they share.

    Read columns are kept; target columns come back as t_start, t_end and any others under
    their own names. [lo, hi) is the overlap inside the bin. ``is_first`` marks the first
    row of a pair, so that pairs can be counted without a distinct. Reads and targets without a base overlap nothing.
    """
    return _overlaps(reads, targets, bin_width, binned_rows(targets, bin_width) <= max_rows)


def _overlaps(reads: DataFrame, targets: DataFrame, bin_width: int, small: bool, cut: bool = True) -> DataFrame:
    """As ``overlaps``; without ``cut`` a pair may be one row, of its first bin, and has no lo and hi."""
    start, end = F.greatest("start", "t_start"), F.least("end", "t_end")
    if small:
        right = _with_bins(targets, bin_width).withColumnsRenamed({"start": "t_start", "end": "t_end"})
        joined = _with_bins(reads, bin_width).join(F.broadcast(right), ["chrom", "bin"])
        joined = joined.where((F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")))
    else:
        joined = overlapping(reads, targets, bin_width)
        if not cut:
            return joined.withColumn("is_first", F.lit(True))
        bins = F.sequence(_div(start, bin_width), _div(end - 1, bin_width))
        joined = joined.withColumn("bin", F.explode(bins))
    bin_start = F.col("bin") * bin_width
    return (
        joined.withColumn("lo", F.greatest(start, bin_start))
        .withColumn("hi", F.least(end, bin_start + bin_width))
        .where(F.col("lo") < F.col("hi"))
        .withColumn("is_first", _div(start, bin_width) == F.col("bin"))
    )


def _counted_overlaps(reads: DataFrame, targets: DataFrame, bin_width: int, small: bool, cut: bool = True) -> DataFrame:
    """Overlaps of reads with their number in ``n``; equal reads are folded first where reads have to be moved."""
    reads = reads.select("sample_id", *TARGET)
    counted = reads.withColumn("n", F.lit(1).cast("long")) if small else reads.groupBy("sample_id", *TARGET).agg(F.count("*").alias("n"))
    return _overlaps(counted, targets, bin_width, small, cut)


def sample_ids(reads: DataFrame) -> DataFrame:
    return reads.select("sample_id").distinct()


def target_fragments(
    reads: DataFrame, targets: DataFrame, samples: DataFrame, bin_width: int = BIN_WIDTH, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Reads per (sample, target), with a zero row where a sample has none."""
    targets = targets.select(*TARGET).distinct()
    small = binned_rows(targets, bin_width) <= max_rows
    if not small:
        return _numbered_fragments(reads, targets, samples, bin_width)
    hits = _counted_overlaps(reads, targets, bin_width, small, cut=False).where("is_first").select(
        "sample_id", "chrom", F.col("t_start").alias("start"), F.col("t_end").alias("end"), "n"
    )
    return _count_with_zeros(hits, targets, samples)


def _numbered_fragments(reads: DataFrame, panel: DataFrame, samples: DataFrame, bin_width: int) -> DataFrame:
    """Reads per (sample, target) of a large panel of targets or markers.

    Targets of about one length and place are a part. Reads, equal ones folded, are moved to the parts that they reach into, and
    meet the targets there; no overlap is ever moved, of which there may be very many for each read.
    """
    def as_targets(entries: DataFrame) -> DataFrame:
        if "pos" in entries.columns:
            entries = entries.withColumns({"start": F.col("pos") - 1, "end": F.col("pos")}).drop("pos")
        return entries.withColumn("level", level_of(bin_width))

    order = [F.col("chrom")] if "pos" in panel.columns else [F.col("chrom"), level_of(bin_width)]
    listed, samples = in_parts(panel, order=order), samples.select("sample_id").distinct()
    tasks, shares = deals(samples, listed)
    targets = as_targets(listed).where(F.col("start") < F.col("end"))
    reaches = targets.groupBy("part", "chrom", "level").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    small = binned_rows(reaches, bin_width) <= BROADCAST_ROWS
    read = ["sample_id", *TARGET]
    placed = _overlaps(reads.select(*read), reaches, bin_width, small, cut=False).where("is_first")
    folded = placed.groupBy("part", "level", *read).agg(F.count("*").alias("n")).withColumn("share", share(["sample_id"], shares))
    right = in_shares(targets.withColumnsRenamed({"chrom": "t_chrom", "start": "t_start", "end": "t_end", "level": "t_level"}), tasks, shares)
    met = folded.repartition(tasks, "part", "share").join(right.hint("merge"), ["part", "share"])
    # Contig and level are compared as ranges: as further keys of the join they would have all rows after it moved again.
    same = [F.col(c).between(F.col(f"t_{c}"), F.col(f"t_{c}")) for c in ("chrom", "level")]
    met = met.where((F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")) & same[0] & same[1])
    sums = met.groupBy("part", "share", "sample_id", "number").agg(F.sum("n").alias("n_covering_frags"))
    return unrolled(sums, samples, listed, ["n_covering_frags"], tasks, shares)


def marker_fragments(
    reads: DataFrame, markers: DataFrame, samples: DataFrame, bin_width: int = BIN_WIDTH, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Reads per (sample, marker position), with a zero row where a sample has none.

    The same as counting over one-base targets, but left partitioned by the genotype key, so
    that joining mutations to it moves nothing again.
    """
    markers = markers.select("chrom", "pos").distinct()
    targets = markers_to_targets(markers)
    small = binned_rows(targets, bin_width) <= max_rows
    if not small:
        return _numbered_fragments(reads, markers, samples, bin_width)
    hits = _counted_overlaps(reads, targets, bin_width, small, cut=False).select("sample_id", "chrom", F.col("t_end").alias("pos"), "n")
    return _count_with_zeros(hits, markers, samples)


def _for_every_sample(samples: DataFrame, panel: DataFrame) -> DataFrame:
    """A row for every (sample, panel entry) of a panel that is small; no task holds more than its share of them."""
    return with_panel(dealt(samples.select("sample_id"), panel.count(), "sample_id"), panel)


def _count_with_zeros(hits: DataFrame, panel: DataFrame, samples: DataFrame) -> DataFrame:
    """Summed hits of every (sample, panel entry) of a panel that is small: its zeros are added to the hits."""
    zeros = _for_every_sample(samples, panel).withColumn("n", F.lit(0).cast("long"))
    key = [c for c in hits.columns if c != "n"]
    return hits.unionByName(zeros).groupBy(*key).agg(F.sum("n").alias("n_covering_frags"))


def target_coverage(
    reads: DataFrame, targets: DataFrame, samples: DataFrame, bin_width: int = BIN_WIDTH, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Reads, covered bases, size and covered fraction of every (sample, target).

    Covered bases are the length of the union of the reads. Overlaps are first folded to
    the longest one per start, so the running maximum that finds the gaps walks at most
    ``bin_width`` rows per group however deep the sample is.

    Targets without a base have no reads, size 0 and a NULL fraction. Equal intervals are measured once; targets with
    further columns, such as a name, keep one row for each of their rows.
    """
    lines, targets = targets, targets.select(*TARGET).distinct()
    piece = ["sample_id", "chrom", "t_start", "t_end", "bin"]
    small = binned_rows(targets, bin_width) <= max_rows
    folded = (
        _counted_overlaps(reads, targets, bin_width, small)
        .groupBy(*piece, "lo")
        .agg(F.max("hi").alias("hi"), F.sum(F.when(F.col("is_first"), F.col("n")).otherwise(0)).alias("n"))
    )
    before = Window.partitionBy(*piece).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    covered_to = F.coalesce(F.max("hi").over(before), F.col("lo"))
    measured = folded.withColumn("covered", F.greatest(F.col("hi") - F.greatest("lo", covered_to), F.lit(0)))
    measured = measured.select(
        "sample_id", "chrom", F.col("t_start").alias("start"), F.col("t_end").alias("end"), F.col("n").alias("n_covering_frags"),
        F.col("covered").alias("n_covered_bases"),
    )
    sums = ["n_covering_frags", "n_covered_bases"]
    if small:
        zeros = _for_every_sample(samples, targets).withColumns({c: F.lit(0).cast("long") for c in sums})
        measured = measured.unionByName(zeros).groupBy("sample_id", *TARGET).agg(*[F.sum(c).alias(c) for c in sums])
    else:
        measured = with_zeros(measured, samples.select("sample_id").distinct(), targets, sums)
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    measured = measured.withColumn("size", size).withColumn(
        "frac_covered", F.try_divide(F.col("n_covered_bases").cast("double"), F.col("size"))
    )
    if set(lines.columns) == set(TARGET):
        return measured
    return _for_every_line(measured, lines, samples, max_rows)


def _for_every_line(measured: DataFrame, lines: DataFrame, samples: DataFrame, max_rows: int) -> DataFrame:
    """A row of ``measured`` (sample_id, target, ...) for every line of its target, with the further columns of the line.

    Measured rows are few bytes and become very many rows, so they are dealt by the rows that go out, a target and a share of the samples
    at a time. Lines of one target travel as lists of up to ``LIST_LINES``, unrolled in place. A list meets all samples of a share before the
    next list does: the same few names come over and over, and a file keeps a name once and not in every row. Beyond ``max_rows`` the lists
    go to the shares, so that a target with very many lines is many tasks.
    """
    key, further = list(TARGET), [c for c in lines.columns if c not in TARGET]
    found = [c for c in measured.columns if c not in TARGET]
    tasks, shares = deals(samples, lines.withColumn("part", F.struct(*key)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key)) - 1
    listed = lines.withColumn("_list", _div(place, LIST_LINES)).groupBy(*key, "_list").agg(F.collect_list(F.struct(*further)).alias("_lines"))
    # Not in the order of the fold before: that would be its own exchange, which is merged by the bytes that come in.
    deal = [*key, "_share"]
    if fits(lines, max_rows):
        # A target has shares by its lines, and a task about as many of any as ``LINE_SHARES``.
        of_line = tasks * LINE_SHARES / max(1, lines.count())
        sizes = lines.groupBy(*key).agg(F.ceil(F.count("*") * of_line).alias("_shares"), F.ceil(F.count("*") / LIST_LINES).alias("_lists"))
        dealt_out = measured.join(F.broadcast(sizes), key).withColumn("_share", F.pmod(F.xxhash64("sample_id"), F.col("_shares"))).repartition(tasks, *deal)
        lists = dealt_out.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lists") - 1)))
        # A file that begins with a page of NULL alone keeps the column as it stands, so targets without a base come last.
        ordered = lists.sortWithinPartitions(F.col("start") >= F.col("end"), *deal, "_list")
        # The planner drops a sort below a join unless something between depends on the partition.
        met = ordered.where(F.spark_partition_id() >= 0).join(F.broadcast(listed.withColumn("_list", F.col("_list").cast("long"))), [*key, "_list"])
    else:
        numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
        right = listed.withColumn("_share", numbers).repartition(tasks, *deal)
        met = measured.withColumn("_share", share(["sample_id"], shares)).repartition(tasks, *deal).join(right.hint("merge"), deal)
    return met.select(*key, *found, F.inline("_lines"))


def coverage_by_position(coverage: DataFrame) -> DataFrame:
    """Fragment count of one-base targets by 1-based position."""
    return coverage.select("sample_id", "chrom", F.col("end").alias("pos"), "n_covering_frags")


def _depth_events(reads: DataFrame, contigs: DataFrame, tile: int, one_tile: bool) -> DataFrame:
    """Per read and tile it touches, where it raises and where it lowers the depth.

    ``step`` is the effect on the depth counted inside the tile, ``change`` the effect seen
    from outside: entering from the previous tile is a step but no change, and ending on a
    tile border is a change but no step.
    """
    first, last = _div(F.col("start"), tile), _div(F.col("end") - 1, tile)
    inside = (
        reads.select("sample_id", "chrom", "start", "end")
        .join(broadcast_if_small(contigs), "chrom")
        .withColumn("end", F.least("end", "length"))
        .where(F.col("start") < F.col("end"))
        .withColumn("k", F.lit(0).cast("long") if one_tile else F.explode(F.sequence(first, last)))
    )
    zero, one, minus = (F.lit(n).cast("long") for n in (0, 1, -1))
    return inside.select(
        "sample_id",
        "chrom",
        F.stack(
            F.lit(2),
            F.greatest(F.col("start"), F.col("k") * tile), one, F.when(F.col("k") == first, one).otherwise(zero),
            F.when(F.col("k") == last, F.col("end")), F.when(F.col("end") % tile == 0, zero).otherwise(minus), minus,
        ).alias("p", "step", "change"),
    ).where("p IS NOT NULL")


def depth_runs(
    reads: DataFrame, contigs: DataFrame, samples: DataFrame, tile: int = TILE_WIDTH
) -> DataFrame:
    """Maximal runs of equal depth, zero depth included, covering [0, length) of every contig.

    A sweep over read starts and ends. Every tile of a contig is swept on its own: reads that
    cross into a tile are counted at its first base, so no running total is carried over and
    no window sees more than ``tile`` positions. The depth changes at a position exactly when
    its starts and ends differ, which is known without looking across the tile border; only
    the outermost changes of each tile are matched up with their neighbours, and that step
    falls away when no contig is longer than a tile.
    """
    one_tile = fits(contigs.where(F.col("length") > tile), 0)
    zero = F.lit(0).cast("long")
    origins = with_panel(samples.select("sample_id"), contigs.select("chrom")).select(
        "sample_id", "chrom", zero.alias("p"), zero.alias("step"), zero.alias("change")
    )
    is_change = (F.col("change") != 0) | (F.col("p") == 0)
    points = (
        _depth_events(reads, contigs, tile, one_tile)
        .unionByName(origins)
        .groupBy("sample_id", "chrom", "p")
        .agg(F.sum("step").alias("step"), F.sum("change").alias("change"))
        .where(is_change | (F.col("p") % tile == 0))
        .select("sample_id", "chrom", "p", _div(F.col("p"), tile).alias("tile"), is_change.alias("is_change"), "step")
    )
    in_tile = Window.partitionBy("sample_id", "chrom", "tile").orderBy("p")
    swept = (
        points.withColumn("depth", F.sum("step").over(in_tile.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_p", F.lead("p").over(in_tile))
        .withColumn("is_head", ~F.coalesce(F.lag("is_change").over(in_tile), F.lit(False)))
        .where("is_change")
    )
    run = ["sample_id", "chrom", F.col("p").alias("start"), F.col("next_p").alias("end"), "depth"]
    if one_tile:
        runs = swept.select(*run)
    else:
        across = Window.partitionBy("sample_id", "chrom").orderBy("p")
        inner = swept.where("next_p IS NOT NULL").select(*run)
        border = swept.where("next_p IS NULL OR is_head").withColumn("after", F.lead("p").over(across))
        runs = inner.unionByName(border.where("next_p IS NULL").withColumn("next_p", F.col("after")).select(*run))
    return (
        runs.join(broadcast_if_small(contigs), "chrom")
        .withColumn("end", F.coalesce("end", "length"))
        .where(F.col("start") < F.col("end"))
        .select("sample_id", "chrom", "start", "end", "depth")
    )


def on_contig(intervals: DataFrame, prefix: str) -> DataFrame:
    return intervals.where(F.col("chrom").startswith(prefix))


def uncovered(runs: DataFrame, min_depth: int = 1) -> DataFrame:
    """Runs below a depth."""
    return runs.where(F.col("depth") < min_depth)


def sort_reads(reads: DataFrame) -> DataFrame:
    """Coordinate-sorted layout, every read tagged with its read group.

    The range partitioning uses the whole row order and then the partition a read comes
    from, so neither a crowded position nor a large group of equal reads ends in one task.
    """
    order = ["chrom", "start", "end", "sample_id"]
    return (
        reads.withColumn("read_group", F.col("sample_id"))
        .withColumn("_from", F.spark_partition_id())
        .repartitionByRange(*order, "_from")
        .sortWithinPartitions(*order)
        .drop("_from")
    )
