"""Structured Streaming jobs for samples and status rows that arrive over time.

Both write one folder per micro-batch and overwrite it on a retry, so a batch that is run
again after a failure leaves the same result. Readers take the newest batch of a key; ``compact`` folds old batches
into one folder, so that neither files nor work grow with the age of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladespark.operators.catalog import GUARDED, run_status
from cladespark.operators.scoring import score_profiles
from cladespark.operators.transitions import Transitions
from cladespark.streaming.stateful import gathered_states, judged_status


def _write_batches(output: str, transform: Callable[[DataFrame], DataFrame]):
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return write


def _start(writer, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def stream_scores(
    states: DataFrame, profiles: DataFrame, output: str, checkpoint: str, once: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Score samples as their marker states arrive; all states of a sample come in one file (else ``stream_gathered_scores``)."""
    writer = states.writeStream.foreachBatch(_write_batches(output, lambda batch: score_profiles(batch, profiles)))
    return _start(writer, checkpoint, once, interval)


def stream_gathered_scores(
    states: DataFrame, profiles: DataFrame, output: str, checkpoint: str, arrived: str = "arrived", patience_hours: int = 24,
    once: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Score a sample once states at all sites of the profiles have come, in any number of files, and again when more come.

    ``states`` has a time in ``arrived``. Samples that stay incomplete until the watermark, ``patience_hours`` behind the latest file, is as many hours past their last are listed in
    the folder ``<output>-incomplete`` (sample_id, n_sites) and are not scored.
    """
    gathered = gathered_states(states, profiles, arrived, f"{patience_hours} hours", patience_hours * 3_600_000)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        complete = batch.where("is_complete").select("sample_id", "chrom", "pos", "alt")
        score_profiles(complete, profiles).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        rest = batch.where("NOT is_complete").select("sample_id", "n_sites").distinct()
        rest.write.mode("overwrite").parquet(f"{output.rstrip('/')}-incomplete/batch={batch_id}")
        batch.unpersist()

    return _start(gathered.writeStream.outputMode("append").foreachBatch(write), checkpoint, once, interval)


def stream_judged_status(
    log: DataFrame, output: str, checkpoint: str, transitions: Transitions = GUARDED, lateness: str = "1 day", once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Keep the status and message of every run of a raw log, guarded changes judged as they arrive (``judged_status``)."""
    writer = judged_status(log, transitions, lateness).writeStream.outputMode("update").foreachBatch(_write_batches(output, lambda batch: batch))
    return _start(writer, checkpoint, once, interval)


def stream_run_status(
    log: DataFrame, output: str, checkpoint: str, once: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Keep the last status and message of every run of a committed log; only changed runs are written.

    The state is one row per run and does not depend on arrival order, so late rows need no
    watermark. The aggregate is the batch operator's own.
    """
    writer = run_status(log).writeStream.outputMode("update").foreachBatch(_write_batches(output, lambda batch: batch))
    return _start(writer, checkpoint, once, interval)


def newest(spark: SparkSession, output: str, key: str) -> DataFrame:
    """Rows of the newest batch of every key: a sample or run that came again replaces the old one.

    The newest batch of a key is found by a partial aggregate, one row per key.
    """
    rows = spark.read.parquet(output)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, output: str, target: str, key: str, last_batch: int) -> None:
    """Write the newest rows up to ``last_batch`` to another place as that one batch.

    A reader that unites ``target`` with the later batches sees what it saw before; the old folders can then go. Run it
    again after a failure: it overwrites its own result.
    """
    rows = spark.read.parquet(output).where(F.col("batch") <= last_batch)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    kept = rows.join(last, [key, "batch"], "left_semi").drop("batch")
    kept.write.mode("overwrite").parquet(f"{target}/batch={last_batch}")
