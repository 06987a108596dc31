"""The states of all runs as a stored table that grows with the log, so that no look at it folds the whole history.

A batch of new events is judged from the states stored so far. What took effect is appended to the stored log, and the states of
the runs it touched to the stored states; a batch has a folder of each, written anew when the batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.functions.tables import stored
from cladespark.operators.catalog import GUARDED, RETRACTABLE, SLICE, with_time_slices
from cladespark.operators.transitions import Transitions, applied_events

EVENTS = "run_id string, ts timestamp_ntz, event_id long, status string, message string"
STATES = "run_id string, status string, message string, created timestamp_ntz, last_ts timestamp_ntz, last_event long"


def _read(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def create(spark: SparkSession, path: str) -> None:
    """An empty store: its first folders hold no rows."""
    for name, schema in (("log", EVENTS), ("states", STATES)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}/batch=-1")


def committed_log(spark: SparkSession, path: str) -> DataFrame:
    """All events that took effect."""
    return _read(spark, f"{path}/log", EVENTS, None).drop("batch")


def current_runs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """One row per run as of the last batch, or of those before one: a partial aggregate over the states written so far."""
    rows = _read(spark, f"{path}/states", STATES, before)
    names = [c.split()[0] for c in STATES.split(", ")]
    last = F.max_by(F.struct(*names), "batch").alias("run")
    return rows.groupBy("run_id").agg(last).select("run.*")


def extend(events: DataFrame, path: str, batch: int, transitions: Transitions = GUARDED, unit: str = SLICE) -> None:
    """Judge new events (run_id, ts, event_id, status, message) and append them; ``batch`` counts from 0 and may be run again.

    The events of a run come after those stored for it, by time and id: one that does not is an error, as its place among
    judged events is lost. Events without a time belong in a run's first batch, and those without a run are judged within their batch. Only the states of the runs in the batch are read from the store
    for more than their key.
    """
    spark = events.sparkSession
    new = stored(events.select("run_id", "ts", "event_id", "status", "message"), "new-events")
    touched = new.select("run_id").distinct()
    known = stored(current_runs(spark, path, batch).join(touched, "run_id", "left_semi"), "touched-runs")
    # A run's stored state stands before its new events as one that always applies, without a number among them.
    seeds = known.where("status IS NOT NULL").select("run_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(-(1 << 63)).alias("event_id"), "status",
                         F.lit(None).cast("string").alias("message"), F.lit(True).alias("is_seed"))
    last = known.select("run_id", "last_ts", "last_event")
    early = F.coalesce(F.struct("ts", "event_id") <= F.struct("last_ts", "last_event"), F.lit(False))
    message = F.concat(F.lit("an event comes before those stored for its run: "), F.col("event_id").cast("string"))
    checked = new.join(last, "run_id", "left").withColumn("is_seed", F.when(early, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    both = checked.select(*seeds.columns).unionByName(seeds)
    judged = applied_events(with_time_slices(both, unit), transitions, "is_seed").where("applied AND NOT is_seed")
    names = [c.split()[0] for c in EVENTS.split(", ")]
    judged.select(*names).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")

    order = F.struct("ts", "event_id")

    def latest(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    applied = spark.read.schema(EVENTS).parquet(f"{path}/log/batch={batch}")
    gained = applied.groupBy("run_id").agg(latest("status"), latest("message"), F.min("ts").alias("created"))
    ends = new.groupBy("run_id").agg(F.max(order).alias("end"))
    old = known.select("run_id", *[F.col(c).alias(f"old_{c}") for c in ("status", "message", "created")])
    states = ends.join(gained, "run_id", "left").join(old, "run_id", "left")
    merged = states.select(
        "run_id", *[F.coalesce(c, f"old_{c}").alias(c) for c in ("status", "message")], F.coalesce("old_created", "created").alias("created"),
        F.col("end.ts").alias("last_ts"), F.col("end.event_id").alias("last_event"),
    )
    merged.write.mode("overwrite").parquet(f"{path}/states/batch={batch}")


def pending_runs(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Runs that wait to be taken, by the instant that created them, from the stored states alone."""
    waiting = current_runs(spark, path).where(F.col("status") == RETRACTABLE).select("run_id", "created").orderBy("created", "run_id")
    return waiting if n is None else waiting.limit(n)


def compact_states(spark: SparkSession, path: str, target: str, batch: int) -> None:
    """The states as of ``batch`` as one folder at another place, which can take the place of all up to that batch."""
    current_runs(spark, path, batch + 1).write.mode("overwrite").parquet(f"{target}/states/batch={batch}")
