"""Streams against the batch operators."""

import datetime as dt
import random

import pandas as pd

from cladespark import refdata
from cladespark.operators import catalog, scoring
from cladespark.sources import readers
from cladespark.streaming import jobs, stateful
from tests.conftest import rows_of
from test_catalog import LOG, TABLES, log_rows
from test_scoring import M1, M2, STATES, state_rows


def test_scores_of_arriving_samples(spark, table, tmp_path):
    arrived, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    profiles = refdata.profiles(spark)

    def arrive(rows):
        table(STATES, rows).coalesce(1).write.mode("append").parquet(arrived)
        states = spark.readStream.schema(STATES).option("maxFilesPerTrigger", 1).parquet(arrived)
        jobs.stream_scores(states, profiles, out, log).awaitTermination()

    arrive(state_rows("x", M1))
    arrive(state_rows("y", M2))
    both = table(STATES, state_rows("x", M1) + state_rows("y", M2))
    assert rows_of(jobs.newest(spark, out, "sample_id")) == rows_of(scoring.score_profiles(both, profiles))
    arrive(state_rows("x", M2))
    again = table(STATES, state_rows("x", M2) + state_rows("y", M2))
    assert rows_of(jobs.newest(spark, out, "sample_id")) == rows_of(scoring.score_profiles(again, profiles))


def test_status_of_arriving_events(spark, table, tmp_path):
    arrived, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = log_rows(random.Random(1), 300)
    random.Random(2).shuffle(rows)
    for part in (rows[:100], rows[100:200], rows[200:]):
        table(LOG, part).coalesce(1).write.mode("append").parquet(arrived)
        jobs.stream_run_status(spark.readStream.schema(LOG).parquet(arrived), out, log).awaitTermination()
    expected = catalog.run_status(table(LOG, rows))
    assert rows_of(jobs.newest(spark, out, "run_id")) == rows_of(expected)
    late = ("hot", dt.datetime(2020, 1, 1), 10_000, "failed", "late")
    table(LOG, [late]).write.mode("append").parquet(arrived)
    jobs.stream_run_status(spark.readStream.schema(LOG).parquet(arrived), out, log).awaitTermination()
    assert rows_of(jobs.newest(spark, out, "run_id")) == rows_of(expected)
    batches = sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "out").glob("batch=*"))
    jobs.compact(spark, out, str(tmp_path / "compacted"), "run_id", batches[-1])
    assert rows_of(jobs.newest(spark, str(tmp_path / "compacted"), "run_id")) == rows_of(expected)


def test_scores_of_arriving_sample_files(spark, tmp_path):
    arrived, out, log = (tmp_path / n for n in ("in", "out", "log"))
    arrived.mkdir()
    for sample, changes in (("x", M1), ("y", M2)):
        lines = ["pos,n_covering_frags,ref,alt,is_mutated,original_ref"]
        lines += [f"{r[2]},{r[3]},{r[4]},{r[5]},{r[6] or ''},{r[4]}" for r in state_rows(sample, changes)]
        (arrived / f"{sample}_markers.csv").write_text("\n".join(lines) + "\n")
        states = readers.stream_cohort(spark, str(arrived), chrom=refdata.CONTIG)
        jobs.stream_scores(states, refdata.profiles(spark), str(out), str(log)).awaitTermination()
    calls = scoring.clade_calls(jobs.newest(spark, str(out), "sample_id"))
    assert {(r.sample_id, r.id): r.call for r in calls.collect()}["y", "gisaid"] == "GH_1"
    assert calls.count() == 6


def shuffled_states(rng, changes):
    """States of several samples, one of them incomplete and one with two mutations at a site."""
    rows = [r for sample, c in changes.items() for r in state_rows(sample, c)]
    rows += [(*r[:5], "N", "yes") for r in state_rows("two", {}) if r[2] in (241, 28144)] + state_rows("two", M2)
    rows += state_rows("short", M1, skip=(28144,)) + [("x", "other contig", 5, 9, "A", "A", None)]
    rng.shuffle(rows)
    return rows


def test_samples_whose_states_come_in_several_files(spark, table, tmp_path):
    arrived, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    profiles = refdata.profiles(spark)
    rows = shuffled_states(random.Random(4), {"x": M1, "y": M2, "z": {}})
    schema = f"{STATES}, arrived timestamp"

    def arrive(part, hour):
        at = dt.datetime(2024, 1, 1, hour)
        table(schema, [(*r, at) for r in part]).coalesce(1).write.mode("append").parquet(arrived)
        states = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        jobs.stream_gathered_scores(states, profiles, out, log, patience_hours=2).awaitTermination()

    for hour, part in enumerate((rows[0::3], rows[1::3], rows[2::3])):
        arrive(part, hour)
    whole = table(STATES, [r for r in rows if r[0] != "short"])
    expected = rows_of(scoring.score_profiles(whole, profiles))
    assert rows_of(jobs.newest(spark, out, "sample_id")) == expected
    assert spark.read.parquet(f"{out}-incomplete").count() == 0
    # Much later the incomplete sample is given up and listed; a complete one keeps its scores.
    arrive(state_rows("late", M1), 12)
    arrive(state_rows("later", M1), 20)
    found = rows_of(jobs.newest(spark, out, "sample_id"))
    assert [r for r in found if r[0] in ("x", "y", "z", "two")] == expected and {r[0] for r in found} == {"x", "y", "z", "two", "late", "later"}
    assert rows_of(spark.read.parquet(f"{out}-incomplete"), "sample_id", "n_sites") == [("short", 16)]


def test_status_of_a_raw_log(spark, table, tmp_path):
    """Events out of order, late, repeated, without a time or a status: the stream ends where the batch does."""
    for name, transitions in (("fixed", catalog.GUARDED), ("any", TABLES[0])):
        arrived, out, log = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "log"))
        rng = random.Random(len(name))
        rows = log_rows(rng, 300) + [("a", None, 900, "initiated", "first"), ("b", dt.datetime(2024, 1, 1, 0, 1), 901, None, "note")]
        rows += rng.sample(rows, 60)
        rng.shuffle(rows)
        for part in (rows[:120], rows[120:200], rows[200:300], rows[300:]):
            table(LOG, part).coalesce(1).write.mode("append").parquet(arrived)
            stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(arrived)
            jobs.stream_judged_status(stream, out, log, transitions, "1 day").awaitTermination()
        expected = catalog.run_status(catalog.committed(table(LOG, rows).distinct(), transitions=transitions))
        found = [r for r in rows_of(jobs.newest(spark, out, "run_id"), "run_id", "status", "message") if r[1:] != (None, None)]
        assert found == rows_of(expected, "run_id", "status", "message")


def test_events_later_than_the_watermark_are_dropped(spark, table, tmp_path):
    arrived, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    day = dt.timedelta(days=1)
    start = dt.datetime(2024, 1, 1)
    parts = [
        [("a", start, 1, "initiated", None)], [("a", start + 9 * day, 3, "running", None), ("b", start + 9 * day, 4, "running", "no")],
        [("c", start + 10 * day, 5, "initiated", None)], [("b", start + 2 * day, 2, "initiated", "too late")],
        [("b", start + 9 * day - day / 2, 6, "initiated", "in time")],
    ]
    for part in parts:
        table(LOG, part).coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(arrived)
        jobs.stream_judged_status(stream, out, log, lateness="2 days").awaitTermination()
    found = {r[0]: r[1:] for r in rows_of(jobs.newest(spark, out, "run_id"), "run_id", "status", "message")}
    assert found == {"a": ("running", None), "b": ("running", "no"), "c": ("initiated", None)}


def test_a_group_of_events_is_read_without_further_frames(monkeypatch):
    """A run's batch is a few rows, and there are very many: a frame built on the way cost forty times the rest of the reading."""
    class Held:
        exists = False

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def update(self, value):
            self.value = value

    batch = pd.DataFrame(
        {"at": [30.0, None, 10.0], "event_id": [3, 1, 2], "status": ["running", "initiated", None], "message": [None, "first", float("nan")]}
    )
    monkeypatch.setattr(pd.DataFrame, "astype", None)
    held = Held()
    (out,) = stateful._status(catalog.GUARDED)(("a",), iter([batch, batch.iloc[:0]]), held)
    assert out.to_dict("list") == {"run_id": ["a"], "status": ["running"], "message": ["first"]}
    assert held.value[5:] == ([stateful.NO_TIME, 10, 30], [1, 2, 3], ["initiated", None, "running"], ["first", None, None])
