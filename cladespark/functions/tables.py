"""Helpers for the small tables that travel next to a big one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.session import shared_folder

BROADCAST_ROWS = 500_000
PANEL_ROWS = 100_000
PART_ENTRIES = 512
HOT_SHARE = 1000
FEW_COLUMNS = 100
TASK_ROWS = 500_000
TASK_UNROLLED = 20_000_000
TASK_SHARES = 4


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def values(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """A literal table as a local relation: planned with its exact size, no Python scan."""
    columns = [column.strip().rsplit(" ", 1) for column in schema.split(",")]
    table = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns))
    aliases = ", ".join(f"c{i}" for i in range(len(columns)))
    return spark.sql(f"SELECT {casts} FROM VALUES {table} AS t({aliases})")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows; looks at no more than one row beyond them.

    Literal tables need no job: the optimizer knows a bound on their rows.
    """
    bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    if bound.isDefined() and bound.get() <= max_rows:
        return True
    return df.offset(max_rows).isEmpty()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the cluster's shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a reference table once its size is checked, else leave the join to the planner."""
    return F.broadcast(df) if fits(df, max_rows) else df


def join_reference(rows: DataFrame, reference: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with a table of one row per key; neither side's size matters, nor how many rows one key has.

    A reference beyond ``max_rows`` is shuffled. Keys with more than one in ``HOT_SHARE`` of all rows, which are fewer than
    ``HOT_SHARE``, are broadcast then, and their rows stay spread over all tasks by a salt.
    """
    found = [c for c in reference.columns if c != key]
    if fits(reference, max_rows):
        return rows.join(F.broadcast(reference), key, "left").select(*rows.columns, *found)
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where((F.col("n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key)
    values = F.struct(*reference.columns)
    listed = reference.join(F.broadcast(hot), key, "left_semi").select(key, values.alias("_hot"))
    salted = hot.withColumn("_is_hot", F.lit(True))
    spread_out = rows.join(F.broadcast(listed), key, "left").join(F.broadcast(salted), key, "left")
    # NULL and a hot key that the reference lacks are salted too: they find nothing on either side.
    salt = F.when(F.col("_is_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1024))).cast("int")
    cold = reference.select(key, F.lit(0).alias("_salt"), values.alias("_cold"))
    placed, tasks = spread_out.withColumn("_salt", salt), total // TASK_ROWS + 1
    if tasks > 1:
        # What a task sorts, here and in a fold of the joined rows, stays the same as the rows grow.
        tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed, cold = placed.repartition(tasks, key, "_salt"), cold.repartition(tasks, key, "_salt")
    joined = placed.join(cold, [key, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in found])


def dealt(rows: DataFrame, entries: int, *keys: str) -> DataFrame:
    """The rows of a narrow table, each to be unrolled to ``entries``, in as many tasks as keep one near ``TASK_ROWS`` unrolled rows.

    A table that is small on disk is read by a task or two, which would hold all it is unrolled to. Few rows stay where they are.
    ``keys`` tell rows apart, so that no task gets more than its share.
    """
    tasks = rows.count() * entries // TASK_ROWS + 1
    return rows if tasks == 1 else rows.repartition(tasks, *keys)


def with_panel(rows: DataFrame, panel: DataFrame, max_rows: int = PANEL_ROWS) -> DataFrame:
    """Give every row of ``rows`` one output row per panel entry.

    The panel is a reference table. Up to ``max_rows`` entries it travels as one array
    value and is unrolled in place, without a join. A larger panel is hashed into parts of
    about that size and every part is joined with salted shares of the rows, so neither a
    part nor a share is held by a single task.
    """
    if fits(panel, max_rows):
        entries = panel.agg(F.collect_list(F.struct(*panel.columns)).alias("entries"))
        return rows.select("*", F.inline(entries.scalar()))
    parts = panel.count() // max_rows + 1
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    shares = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).withColumn(
        "_part", numbers(parts)
    )
    pieces = panel.withColumn("_part", F.pmod(F.xxhash64(*panel.columns), F.lit(parts))).withColumn(
        "_salt", numbers(salts)
    )
    return shares.join(pieces, ["_part", "_salt"]).drop("_part", "_salt")


def numbered(panel: DataFrame, columns: Sequence[str], per_part: int) -> tuple[DataFrame, int]:
    """Distinct panel entries with a ``part`` of about ``per_part`` of them and their ``number`` in it, from 0; and the number of parts."""
    parts = panel.count() // per_part + 1
    dealt = panel.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    return dealt.withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy(*columns)).cast("long") - 1), parts


def dense(entries: Column, size: Column, absent: Column) -> Column:
    """Sorted (number, value) structs as an array of ``size`` values, ``absent`` where a number is not there.

    Gaps are filled in one go, so the work grows with the array and not with its square.
    """
    def filled(i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get(entries, i - 1)["number"])
        here = F.get(entries, i)
        return F.concat(F.array_repeat(absent, (here["number"] - before - 1).cast("int")), F.array(here["value"]))

    last = F.coalesce(F.get(entries, F.size(entries) - 1)["number"], F.lit(-1).cast("long"))
    tail = F.array(F.array_repeat(absent, (size - 1 - last).cast("int")))
    inner = F.transform(F.sequence(F.lit(0), F.size(entries) - 1), filled)
    return F.flatten(F.when(F.size(entries) > 0, F.concat(inner, tail)).otherwise(tail))


def in_parts(panel: DataFrame, per_part: int = PART_ENTRIES, order: Sequence[Column] = ()) -> DataFrame:
    """Distinct panel entries with a ``part`` of about ``per_part`` neighbours and their ``number`` in it, from 0, written to a table.

    Entries are in the ``order`` given or that of their columns, so that what falls on a stretch of them is in few parts.
    """
    by = [*order, *panel.columns]
    ranged = panel.repartitionByRange(panel.count() // per_part + 1, *by).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy(*by)).cast("long") - 1
    return stored(ranged.withColumn("number", number), "parts")


def deals(rows: DataFrame, listed: DataFrame) -> tuple[int, int]:
    """In how many tasks the parts of a ``listed`` panel are unrolled for all ``rows``, and to how many shares of the rows a part goes."""
    n_rows, (n_entries, n_parts) = rows.count(), listed.agg(F.count("*"), F.count_distinct("part")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows * n_entries // TASK_UNROLLED + 1)
    return tasks, max(1, TASK_SHARES * tasks // max(1, n_parts))


def share(key: Sequence[str], shares: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(shares))


def in_shares(parts: DataFrame, tasks: int, shares: int) -> DataFrame:
    """Rows with a ``part``, once for each share, dealt by part and share."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    return parts.withColumn("share", numbers).repartition(tasks, "part", "share")


def with_zeros(counts: DataFrame, rows: DataFrame, panel: DataFrame, values: Sequence[str], per_part: int = PART_ENTRIES) -> DataFrame:
    """One row per (row, panel entry) with the summed ``values`` of ``counts``, zero where it has none.

    A key that only ``counts`` has keeps its entries that are not zero. ``rows`` are distinct keys, ``panel`` distinct entries, ``counts`` has the columns of both.
    """
    key, listed = rows.columns, in_parts(panel, per_part)
    tasks, shares = deals(rows, listed)
    placed = counts.join(broadcast_if_small(listed), panel.columns)
    summed = placed.groupBy(*key, "part", "number").agg(*[F.sum(v).alias(v) for v in values])
    return unrolled(summed.withColumn("share", share(key, shares)).repartition(tasks, "part", "share"), rows, listed, values, tasks, shares)


def unrolled(sums: DataFrame, rows: DataFrame, listed: DataFrame, values: Sequence[str], tasks: int, shares: int) -> DataFrame:
    """As ``with_zeros``, of sums (part, share, key, number, values) that are dealt by part and share.

    The pairs of a key and a part are made in the task that unrolls them. What a key has there is folded to one sorted array with zeros
    between, and read next to the entries of the part: neither a zero nor such a pair is ever moved.
    """
    key, deal = rows.columns, ["part", "share"]
    entry = [c for c in listed.columns if c not in ("part", "number")]
    # A number of partitions is given, since few bytes come in and a row for every entry goes out.
    parts = listed.select("part").distinct()
    if fits(rows, BROADCAST_ROWS):
        pairs = in_shares(parts, tasks, shares).join(F.broadcast(rows.withColumn("share", share(key, shares))), "share")
    else:
        pairs = with_panel(rows, parts).withColumn("share", share(key, shares)).repartition(tasks, *deal)
    value = F.struct(*values)
    kind = sums.select(value.alias("value")).schema["value"].dataType.simpleString()
    pairs = pairs.select(*deal, *key, F.lit(True).alias("every"), F.lit(None).cast("long").alias("number"), F.lit(None).cast(kind).alias("value"))
    found = F.when(F.col("number").isNotNull(), F.struct("number", "value"))
    folded = (
        pairs.unionByName(sums.select(*deal, *key, F.lit(None).cast("boolean").alias("every"), "number", value.alias("value")))
        .groupBy(*deal, *key)
        .agg(F.coalesce(F.max("every"), F.lit(False)).alias("every"), F.sort_array(F.collect_list(found)).alias("found"))
    )
    zeros = F.struct(*[F.lit(0).cast("long").alias(v) for v in values])
    full = F.when(F.size("found") > 0, dense(F.col("found"), F.element_at("found", -1)["number"] + 1, zeros))
    met = folded.select(*deal, *key, "every", full.alias("full"))
    each = met.join(in_shares(listed, tasks, shares).hint("merge"), deal)
    here = F.get("full", F.col("number").cast("int"))
    each = each.select(*key, *entry, "every", *[F.coalesce(here[v], F.lit(0).cast("long")).alias(v) for v in values])
    return each.where(F.col("every") | F.greatest(F.lit(0), *[F.abs(v) for v in values]).cast("boolean")).drop("every")


def spread(
    df: DataFrame, keys: Sequence[str], column: str, value: str, labels: dict, reject_duplicates: bool = True
) -> DataFrame:
    """Long to wide, one output column per entry of ``labels`` (cell value -> column name).

    The column list is explicit, so there is no extra job to discover it and the order is
    fixed. Two rows for one cell are an error, and so is a row whose cell is not listed: no value is lost in silence. A few columns
    are folded by one partial aggregate with a few values for each; beyond ``FEW_COLUMNS`` the cells of a row are folded to one array.
    """
    if len(labels) > FEW_COLUMNS:
        return _spread_arrays(df, keys, column, value, labels, reject_duplicates)
    listed = F.coalesce(F.col(column).isin(*labels), F.lit(False)) if labels else F.lit(False)
    stray = F.max(F.when(~listed, F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))

    def cell(label, name):
        here = F.col(column) == F.lit(label)
        folded = F.max(F.when(here, F.col(value)))
        if reject_duplicates:
            message = F.lit(f"more than one row for {column}={label}")
            folded = F.when(F.count_if(here) > 1, F.raise_error(message)).otherwise(folded)
        message = F.concat(F.lit(f"no column is listed for {column}="), stray)
        return F.when(stray.isNotNull(), F.raise_error(message)).otherwise(folded).alias(name)

    return df.groupBy(*keys).agg(*[cell(label, name) for label, name in labels.items()])


def _spread_arrays(df: DataFrame, keys: Sequence[str], column: str, value: str, labels: dict, reject_duplicates: bool) -> DataFrame:
    """As ``spread`` for any number of columns: cells are numbered by their column, moved once to their row, folded to
    a sorted array there and unrolled. The work for a row grows with its cells and columns, not with their product.
    """
    kind = df.schema[column].dataType.simpleString()
    numbers = values(df.sparkSession, f"_label {kind}, _number long", [(label, i) for i, label in enumerate(labels)])
    name = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
    stray = F.raise_error(F.concat(F.lit(f"no column is listed for {column}="), name)).cast("long")
    placed = df.select(*keys, F.col(column), F.col(value).alias("_value")).join(F.broadcast(numbers), F.col(column) == F.col("_label"), "left")
    cells = placed.select(*keys, F.coalesce("_number", stray).alias("number"), "_value", name.alias("_name"))
    folded = F.max("_value")
    if reject_duplicates:
        message = F.concat(F.lit(f"more than one row for {column}="), F.min("_name"))
        folded = F.when(F.count("*") > 1, F.raise_error(message)).otherwise(folded)
    one = cells.repartition(*keys).groupBy(*keys, "number").agg(folded.alias("value"))
    rows = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("number", "value"))).alias("_found"))
    absent = F.lit(None).cast(df.schema[value].dataType)
    filled = rows.select(*keys, dense(F.col("_found"), F.lit(len(labels)).cast("long"), absent).alias("_cells"))
    quoted = [n.replace("`", "``") for n in labels.values()]
    return filled.selectExpr(*[f"`{k}`" for k in keys], *[f"_cells[{i}] AS `{n}`" for i, n in enumerate(quoted)])


def site_columns(sites: Sequence[tuple[str, int]]) -> dict[str, str]:
    """Matrix column of every (contig, position): the position, with its contig where the panel has several."""
    ordered = sorted(set(sites))
    alone = len({chrom for chrom, _ in ordered}) == 1
    return {f"{chrom}:{pos}": str(pos) if alone else f"{chrom}:{pos}" for chrom, pos in ordered}


def spread_sites(
    df: DataFrame, keys: Sequence[str], value: str, sites: Sequence[tuple[str, int]], prefix: str = ""
) -> DataFrame:
    """Long (keys, chrom, pos, value) to wide, a column for each of ``sites``; a second row for one cell or another site is an error."""
    keyed = df.withColumn("_marker", F.concat_ws(":", "chrom", F.col("pos").cast("string")))
    return spread(keyed, keys, "_marker", value, {label: f"{prefix}{name}" for label, name in site_columns(sites).items()})
