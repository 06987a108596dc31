"""Aligned reads written in coordinate order, with an index by which a region is read from the files that can hold it.

Files hold one contig and a stretch of it each. The linear index has a row for each file and window of the contig: where in the file the
reads that start there lie, and how far the longest of them reaches, so that reads that begin before a region are found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.intervals import sort_reads

WINDOW = 16_384
ROWS_PER_FILE = 5_000_000
MOST_FILES = 10_000


def _reads(path: str) -> str:
    return f"{path.rstrip('/')}/reads"


def _schema(path: str) -> str:
    return f"{path.rstrip('/')}/schema"


def _index(path: str) -> str:
    return f"{path.rstrip('/')}/index"


def write_reads(reads: DataFrame, path: str, window: int = WINDOW, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write (sample_id, chrom, start, end, any more columns) sorted by (chrom, start, end, sample_id), and its index.

    Neither a crowded position nor a contig with most of the reads is one task or one file. Writing to a path again replaces what is there.
    """
    spark = reads.sparkSession
    writer = sort_reads(reads).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("chrom")
    writer.parquet(_reads(path))
    columns = [c for c in reads.columns if c != "chrom"]
    # An empty table of the same columns: readers need no look into the files.
    reads.withColumn("read_group", F.col("sample_id")).select(*columns, "read_group", "chrom").limit(0).write.mode("overwrite").parquet(_schema(path))
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = _stored(spark, path).select("chrom", "start", "end", file.alias("file"), row.alias("row"))
    index = placed.groupBy("chrom", F.call_function("div", "start", F.lit(window)).alias("window"), "file").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("start").alias("first_start"), F.max("end").alias("last_end")
    )
    index.repartitionByRange("chrom", "window").sortWithinPartitions("chrom", "window").write.mode("overwrite").parquet(_index(path))


def _stored(spark: SparkSession, path: str, files: Sequence[str] = ()) -> DataFrame:
    return spark.read.schema(spark.read.parquet(_schema(path)).schema).option("basePath", _reads(path)).parquet(*(files or [_reads(path)]))


def reads_index(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, window, file, first_row, last_row, first_start, last_end) of a written store."""
    return spark.read.parquet(_index(path))


def reads_in_region(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Reads that overlap [start, end) of a contig, from the files that can hold some.

    The index gives the files; the region's bounds are pushed to their scan, where the sorted starts let row groups be skipped. A region
    without reads gives no rows. One that takes more than ``MOST_FILES`` files is a scan of the contig's folder.
    """
    holding = (F.col("chrom") == chrom) & (F.col("first_start") < end) & (F.col("last_end") > start)
    found = reads_index(spark, path).where(holding).select("file").distinct().limit(MOST_FILES + 1).collect()
    listed = [r["file"] for r in found] if len(found) <= MOST_FILES else []
    rows = _stored(spark, path, listed).where(F.col("chrom") == chrom)
    overlaps = (F.col("start") < end) & (F.col("end") > start) & (F.col("start") < F.col("end")) & F.lit(start < end)
    return rows.where(overlaps if found else F.lit(False))
