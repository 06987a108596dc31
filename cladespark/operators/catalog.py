"""Accounts, projects, files and runs, and the history of run states.

Entities are one table each and every to-many reference is a link table of two ids. Trees
are returned as flat rows: a project may own any number of files, so they are not gathered
into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions.expressions import fan_out_path, safe_file_name
from cladespark.functions.tables import BROADCAST_ROWS, join_reference
from cladespark.operators.patterns import matching_names
from cladespark.operators.transitions import Transitions, applied_events, decided_by_the_last

# Run states, and the states from which a run can be removed.
RETRACTABLE, STOPPABLE = "initiated", "running"
REMOVABLE = ("retracted", "initiation-failed", "succeeded", "failed", "stopped")

# Changes that take effect only from one exact state.
GUARDED = {"running": ("initiated",), "retracted": ("initiated",)}

SLICE = "HOUR"
NO_TIME = -(1 << 63)


def pair_files(files: DataFrame, mates: tuple[str, str] = ("_R1.fastq.gz", "_R2.fastq.gz")) -> DataFrame:
    """Read pairs by sample: files whose names differ only in the mate's suffix.

    A sample is emitted only with exactly one file of each mate. Files are folded, not
    collected.
    """
    path = F.col("path")
    first, second = (path.endswith(mate) for mate in mates)
    suffix = F.when(first, F.lit(len(mates[0]))).otherwise(F.lit(len(mates[1])))
    name = F.substring_index(path, "/", -1)
    return (
        files.where(first | second)
        .groupBy(F.left(name, F.length(name) - suffix).alias("sample_id"))
        .agg(
            F.max(F.when(first, path)).alias("r1"),
            F.max(F.when(second, path)).alias("r2"),
            F.count("*").alias("_n"),
        )
        .where("_n = 2 AND r1 IS NOT NULL AND r2 IS NOT NULL")
        .drop("_n")
    )


def drop_blacklisted(samples: DataFrame, patterns: Sequence[str] | DataFrame) -> DataFrame:
    """Samples whose id contains a match of none of the patterns, a list or a table (pattern).

    A table may list any number of patterns: a sample is tested only against those whose required text it holds (``patterns``).
    """
    if isinstance(patterns, DataFrame):
        return samples.join(matching_names(samples, patterns, "sample_id"), "sample_id", "left_anti")
    for pattern in patterns:
        samples = samples.where(~F.col("sample_id").rlike(pattern))
    return samples


def file_manifest(files: DataFrame) -> DataFrame:
    """Stored name and storage path of every file."""
    return files.select(
        "file_id", safe_file_name(F.col("name")).alias("name"), fan_out_path(F.col("file_id")).alias("path")
    )


def project_files(projects: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Files of every project; sorted only on export."""
    return (
        projects.withColumnRenamed("name", "project_name")
        .join(links, "project_id")
        .join(files.withColumnRenamed("name", "file_name"), "file_id")
        .select("project_id", "project_name", "file_id", "file_name", "size")
    )


def sort_project_files(files: DataFrame) -> DataFrame:
    """Export order: by project and name."""
    return files.orderBy("project_id", "file_name", "file_id")


def run_files(runs: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Output files of every run, one row per file, with the name and path each is stored under."""
    stored = files.select("file_id", safe_file_name(F.col("name")).alias("file_name"), fan_out_path(F.col("file_id")).alias("path"), "size")
    return runs.select("run_id").join(links, "run_id").join(stored, "file_id").select("run_id", "file_id", "file_name", "path", "size")


def account_tree(
    accounts: DataFrame,
    account_projects: DataFrame,
    projects: DataFrame,
    account_runs: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Every account with its projects and runs, one row per child, one empty row without any.

    An inner join and the accounts left over, not an outer join: adaptive execution can
    split an account with very many children only in the former. Accounts left over are those without a link, so the
    children are built once; a link to something that is gone is a child without a name.
    """
    owned_projects = account_projects.join(projects, "project_id", "left").select(
        "account_id", F.lit("project").alias("kind"), F.col("project_id").alias("child_id"), "name",
        F.lit(None).cast("string").alias("status"),
    )
    owned_runs = account_runs.join(runs, "run_id", "left").select(
        "account_id", F.lit("run").alias("kind"), F.col("run_id").alias("child_id"), "name", "status"
    )
    children = owned_projects.unionByName(owned_runs)
    linked = account_projects.select("account_id").unionByName(account_runs.select("account_id"))
    childless = accounts.join(linked, "account_id", "left_anti")
    return accounts.join(children, "account_id").unionByName(childless, allowMissingColumns=True)


def lookup(entities: DataFrame, column: str, value: str) -> DataFrame:
    """Entity by a unique attribute; the filter reaches the scan."""
    return entities.where(F.col(column) == value)


def account_counts(accounts: DataFrame, account_projects: DataFrame, account_runs: DataFrame) -> DataFrame:
    """Number of projects and runs of every account."""
    zero = F.lit(0).cast("long")
    counted = (
        account_projects.select("account_id", F.lit("project").alias("kind"))
        .unionByName(account_runs.select("account_id", F.lit("run").alias("kind")))
        .groupBy("account_id")
        .agg(
            F.count_if(F.col("kind") == "project").alias("n_projects"),
            F.count_if(F.col("kind") == "run").alias("n_runs"),
        )
    )
    return accounts.select("account_id").join(counted, "account_id", "left").select(
        "account_id",
        F.coalesce("n_projects", zero).alias("n_projects"),
        F.coalesce("n_runs", zero).alias("n_runs"),
    )


def unlink(links: DataFrame, removed: DataFrame) -> DataFrame:
    """Links that were not removed; the linked entities are untouched."""
    return links.join(removed, links.columns, "left_anti")


def refresh_sizes(files: DataFrame, listing: DataFrame) -> DataFrame:
    """File sizes as found in a storage listing; NULL where a file is gone."""
    return files.drop("size").join(listing.select("file_id", "size"), "file_id", "left")


def _latest(column: str) -> Column:
    """Last value written; an event that leaves the column empty does not change it."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct("ts", "event_id")))


def committed(log: DataFrame, unit: str = SLICE, transitions: Transitions = GUARDED) -> DataFrame:
    """The events that took effect: a rejected change writes nothing. The operators below take such a log."""
    return run_transitions(log, unit, transitions).where("applied").drop("previous", "applied")


def run_status(log: DataFrame) -> DataFrame:
    """Last status of every run of a committed log, and the last message given with any; one partial aggregate."""
    return log.groupBy("run_id").agg(_latest("status").alias("status"), _latest("message").alias("message"))


def run_status_asof(log: DataFrame, instant: str) -> DataFrame:
    """State as of an instant, itself included, from a committed log."""
    return run_status(log.where(F.col("ts") <= F.lit(instant)))


def known_runs(log: DataFrame) -> DataFrame:
    """Runs of a raw log in which some change took effect.

    A guarded change takes effect only after an unguarded one, so any unguarded event tells; no run is folded.
    """
    return log.where(~F.coalesce(F.col("status").isin(*GUARDED), F.lit(False))).select("run_id").distinct()


def run_actions(runs: DataFrame) -> DataFrame:
    """What can be done with a run in its current state."""
    status = F.col("status")
    action = (
        F.when(status == RETRACTABLE, F.lit("retract"))
        .when(status == STOPPABLE, F.lit("stop"))
        .when(status.isin(*REMOVABLE), F.lit("remove"))
    )
    return runs.withColumn("action", action)


def with_commit_time(facts: DataFrame, transactions: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Facts (entity, attribute, value, tx) with the ``instant`` their transaction (tx, instant) was committed.

    A fact whose transaction is not listed, has no instant or is NULL has no instant itself. A transaction listed more than once was
    committed at its first instant. A transaction may hold any share of the facts, and there may be any number of transactions.
    """
    committed_at = transactions.groupBy("tx").agg(F.min("instant").alias("instant"))
    return join_reference(facts.select("entity", "attribute", "value", "tx"), committed_at, "tx", max_rows)


def current_values(facts: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per entity with the last value of each attribute, and the instant of the entity's first fact (``created``).

    Facts are those of ``with_commit_time``. Later instants win, and later transactions of one instant, then the greater value; facts without
    an instant come before all others. One partial aggregate, whatever the history of an entity.
    """
    order = F.struct("instant", "tx", "value")

    def last(attribute: str) -> Column:
        return F.max_by("value", F.when((F.col("attribute") == attribute) & F.col("value").isNotNull(), order)).alias(attribute)

    return facts.groupBy("entity").agg(*[last(a) for a in attributes], F.min("instant").alias("created"))


def pending_entities(facts: DataFrame, attribute: str = "status", n: int | None = None) -> DataFrame:
    """Entities whose last status waits to be taken, by the instant of their first fact; those without any come last."""
    waiting = current_values(facts, [attribute]).where(F.col(attribute) == RETRACTABLE).select("entity", "created")
    ordered = waiting.orderBy(F.col("created").asc_nulls_last(), "entity")
    return ordered if n is None else ordered.limit(n)


def pending_runs(log: DataFrame, n: int | None = None) -> DataFrame:
    """Runs of a committed log that wait to be taken, by the instant that created them; the first ``n`` if given."""
    pending = (
        log.groupBy("run_id")
        .agg(_latest("status").alias("status"), F.min("ts").alias("created"))
        .where(F.col("status") == RETRACTABLE)
        .select("run_id", "created")
        .orderBy("created", "run_id")
    )
    return pending if n is None else pending.limit(n)


def earliest_projects(projects: DataFrame, n: int = 5) -> DataFrame:
    """Projects created at one of the ``n`` earliest commit instants."""
    instants = projects.select("created").distinct().orderBy("created").limit(n)
    return projects.join(F.broadcast(instants), "created", "left_semi")


def with_time_slices(log: DataFrame, unit: str = SLICE) -> DataFrame:
    """Number the time slices of a log, one per hour or other unit; events without a time share the slice before all others."""
    since = F.timestamp_diff(unit, F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return log.withColumn("slice", F.coalesce(since, F.lit(NO_TIME)))


def with_previous(log: DataFrame, unit: str = SLICE) -> DataFrame:
    """Every event of a log next to the last status given before it in the same run; events without a time come first.

    Events are ordered inside time slices, so a run that holds a large share of the log is
    spread over the slices. Only the first events of a slice look further back, to a table
    with one row per (run, slice).
    """
    sliced = with_time_slices(log.select("run_id", "ts", "event_id", "status", "message"), unit)
    inside = Window.partitionBy("run_id", "slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("run_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("run_id", "slice")
        .agg(_latest("status").alias("last_status"))
        .withColumn("carried", F.last("last_status", ignorenulls=True).over(across))
        .select("run_id", "slice", "carried")
    )
    found = F.last("status", ignorenulls=True).over(inside)
    joined = sliced.withColumn("found", found).alias("s").join(
        carried.alias("c"), F.expr("s.run_id <=> c.run_id AND s.slice = c.slice")
    )
    return joined.select("s.run_id", "event_id", "ts", "status", "message", F.coalesce("found", "carried").alias("previous"))


def run_transitions(log: DataFrame, unit: str = SLICE, transitions: Transitions = GUARDED) -> DataFrame:
    """Every event of every run, marked as applied or rejected.

    ``transitions`` lists the states from which a change takes effect; changes it does not list always apply, and events without a
    status change none. Under the default table a guarded change applies only from ``initiated``, and none leads back to it, so the
    event before it decides. Other tables are folded by composing the changes (``applied_events``).
    """
    seen = with_previous(log, unit)
    if not decided_by_the_last(transitions):
        return applied_events(with_time_slices(seen, unit), transitions).drop("slice")
    expected = F.lit(False)
    for target, sources in transitions.items():
        expected = F.when(F.col("status") == target, F.coalesce(F.col("previous").isin(*sources), F.lit(False))).otherwise(expected)
    guarded = F.coalesce(F.col("status").isin(*transitions), F.lit(False))
    return seen.withColumn("applied", ~guarded | expected)


def overwritten_stops(log: DataFrame, unit: str = SLICE) -> DataFrame:
    """Results written over a stop, which does not reach the running child.

    Guarded changes are left out first: none can apply between a stop and the result.
    """
    unguarded = log.where(~F.coalesce(F.col("status").isin(*GUARDED), F.lit(False)))
    return (
        with_previous(unguarded, unit)
        .where((F.col("previous") == "stopped") & F.col("status").isin("succeeded", "failed"))
        .select("run_id", "event_id", "ts", "status")
    )
