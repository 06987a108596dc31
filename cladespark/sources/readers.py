"""Readers with explicit schemas. Nothing is inferred.

Per-sample files carry the sample in their name; a whole cohort is one scan over a glob
and the name becomes the ``sample_id`` column. A reader is a scan of lines (path, value) and a parser of such lines,
which serves files, streams and tables of lines alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import schemas
from cladespark.operators.scoring import long_profiles


def sample_from_name(path: Column, pattern: str) -> Column:
    """Sample id: first group of a pattern over the file name. A name without one is an error, or strays would become one sample."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no sample id in file name "), name)))


def _file_name() -> Column:
    """Spark gives the name as a URL does; a plus sign is just a plus sign there."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("path")


def scan_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with the name of their file."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths).select(_file_name(), "value")


def _parsed(lines: DataFrame, schema: str, header: str | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    rows = lines.where(F.trim("value") != "")
    if header is not None:
        rows = rows.where(F.col("value") != header)
    if comment is not None:
        rows = rows.where(~F.col("value").startswith(comment))
    options = {"sep": sep, "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE"}
    return rows.select("path", F.from_csv("value", schema, options).alias("_row")).select("path", "_row.*")


def _of_samples(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.withColumn("sample_id", sample_from_name(F.col("path"), pattern)).drop("path")


def header_of(schema: str, sep: str = ",") -> str:
    return sep.join(column.rsplit(" ", 1)[0].strip("`") for column in schema.split(", "))


def parse_variants(lines: DataFrame, sample_pattern: str = r"(.*)\.vcf$") -> DataFrame:
    """Headerless tab-separated variants, comment lines skipped; a quality that is no number is NULL."""
    return _of_samples(_parsed(lines, schemas.VARIANTS, sep="\t", comment="#"), sample_pattern)


def read_variants(spark: SparkSession, path: str, sample_pattern: str = r"(.*)\.vcf$") -> DataFrame:
    return parse_variants(scan_lines(spark, path), sample_pattern)


def parse_target_coverage(lines: DataFrame, sample_pattern: str = r"(.*)_coverage\.bed$", headed: bool = False) -> DataFrame:
    """Target coverage: headerless and tab-separated, or ``headed`` with commas as it is exported."""
    rows = (
        _parsed(lines, schemas.TARGET_COVERAGE, header=header_of(schemas.TARGET_COVERAGE))
        if headed
        else _parsed(lines, schemas.TARGET_COVERAGE, sep="\t")
    )
    return _of_samples(rows, sample_pattern)


def read_target_coverage(spark: SparkSession, path: str, sample_pattern: str = r"(.*)_coverage\.bed$") -> DataFrame:
    return parse_target_coverage(scan_lines(spark, path), sample_pattern)


def read_target_coverage_csv(spark: SparkSession, path: str, sample_pattern: str = r"(.*)_coverage\.csv$") -> DataFrame:
    return parse_target_coverage(scan_lines(spark, path), sample_pattern, headed=True)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(scan_lines(spark, path), schemas.TARGETS, sep="\t").drop("path")


def parse_markers(lines: DataFrame) -> DataFrame:
    """Marker list; the file's first column is headed ``chr``."""
    return _parsed(lines, schemas.MARKERS, header="chr,pos,ref").drop("path")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    return parse_markers(scan_lines(spark, path))


def parse_mutations(lines: DataFrame, chrom: str, sample_pattern: str = r"(.*)_mutations\.csv$") -> DataFrame:
    """Decomposed mutations. The files drop the contig, so it is given."""
    rows = _of_samples(_parsed(lines, schemas.MUTATIONS, header=header_of(schemas.MUTATIONS)), sample_pattern)
    return rows.withColumn("chrom", F.lit(chrom))


def read_mutations(spark: SparkSession, path: str, chrom: str, sample_pattern: str = r"(.*)_mutations\.csv$") -> DataFrame:
    return parse_mutations(scan_lines(spark, path), chrom, sample_pattern)


def parse_cohort(
    lines: DataFrame, schema: str = schemas.MARKER_STATES, sample_pattern: str = r"(.*)_markers\.csv$", chrom: str | None = None
) -> DataFrame:
    """Headed files of one kind of all samples, with their contig if it is given."""
    rows = _of_samples(_parsed(lines, schema, header=header_of(schema)), sample_pattern)
    return rows if chrom is None else rows.withColumn("chrom", F.lit(chrom))


def read_cohort(
    spark: SparkSession,
    path: str,
    schema: str = schemas.MARKER_STATES,
    sample_pattern: str = r"(.*)_markers\.csv$",
    chrom: str | None = None,
) -> DataFrame:
    """All samples' files of one kind in one scan."""
    return parse_cohort(scan_lines(spark, path), schema, sample_pattern, chrom)


def stream_cohort(
    spark: SparkSession,
    path: str,
    schema: str = schemas.MARKER_STATES,
    sample_pattern: str = r"(.*)_markers\.csv$",
    chrom: str | None = None,
) -> DataFrame:
    """Samples' files of one kind as they arrive in a folder."""
    lines = spark.readStream.text(path).select(_file_name(), "value")
    return parse_cohort(lines, schema, sample_pattern, chrom)


def read_cohort_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_cohort(spark, path, schemas.SCORES, r"(.*)_scores_vs_strains\.csv$")


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(nullValue="", emptyValue="", header=True, **options).csv(path)


def read_naming_systems(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.NAMING_SYSTEMS)


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.COLOURS)


def read_profiles(
    spark: SparkSession, prefix: str, systems: Sequence[str], positions: Sequence[int], chrom: str | None = None
) -> DataFrame:
    """Wide profile tables ``<prefix>_<system>.csv`` of all systems, in long form."""
    schema = ", ".join(["clade string", *[f"`{p}` string" for p in positions]])
    tables = [
        long_profiles(_csv(spark, f"{prefix}_{system}.csv", schema, enforceSchema=False), system, chrom) for system in systems
    ]
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.unionByName(table)
    return combined


def parse_profile_sheet(lines: DataFrame, clades: Sequence[str], system_id: str) -> DataFrame:
    """Transposed profile sheet: one row per position, base counts, one column per clade."""
    schema = ", ".join(
        ["Position long", *[f"{b} long" for b in "ATCGN"], *[f"`{c}` string" for c in clades],
         "`AA changes` string", "`markers for` string"]
    )
    sheet = _parsed(lines, schema, header=header_of(schema, "\t"), sep="\t")
    return sheet.unpivot(["Position"], list(clades), "clade", "alt").select(
        F.lit(system_id).alias("id"), "clade", F.col("Position").alias("pos"), "alt"
    )


def read_profile_sheet(spark: SparkSession, path: str, clades: Sequence[str], system_id: str) -> DataFrame:
    return parse_profile_sheet(scan_lines(spark, path), clades, system_id)
