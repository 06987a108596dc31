"""Sinks: Parquet by default, CSV with a header and empty cells for NULL at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a table, optionally into folders by value and sorted by range.

    Folders suit few values (contig, naming system). With very many samples, cluster by
    ``sample_id`` instead: the files then hold disjoint ranges of it and a filter on a sample
    skips the others by their statistics.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*partition_by, *cluster_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(header=True, nullValue="", emptyValue="").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
