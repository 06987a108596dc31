"""The stored log and states against folding the whole log."""

import datetime as dt
import random

import pytest

from cladespark.operators import catalog, run_store
from tests.conftest import rows_of
from tests.test_catalog import LOG, T0, TABLES, log_rows


@pytest.mark.parametrize("transitions", [catalog.GUARDED, TABLES[0], TABLES[1]])
def test_batches_give_what_the_whole_log_does(spark, table, tmp_path, transitions):
    """A run of two batches, one that only some batches have, one without any change that takes effect; a batch run twice."""
    rng = random.Random(5)
    rows = log_rows(rng, 400) + [("still", T0 + dt.timedelta(seconds=5), 9000, "running", None), ("a", None, 9001, "initiating", "first")]
    rows += [("hot", T0 + dt.timedelta(seconds=77), 9002, None, "a note")]
    cuts = [T0 + dt.timedelta(seconds=s) for s in (0, 60, 61, 150, 400)]
    path = str(tmp_path / "store")
    run_store.create(spark, path)
    assert rows_of(run_store.current_runs(spark, path)) == []
    for batch, (first, end) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if first <= (r[1] or T0) < end]
        for _ in range(1 + (batch == 1)):
            run_store.extend(table(LOG, part), path, batch, transitions, "MINUTE")
    log = catalog.committed(table(LOG, rows), transitions=transitions)
    columns = ("run_id", "ts", "event_id", "status", "message")
    assert rows_of(run_store.committed_log(spark, path), *columns) == rows_of(log, *columns)
    known = [r for r in rows_of(run_store.current_runs(spark, path), "run_id", "status", "message") if r[1:] != (None, None)]
    assert known == rows_of(catalog.run_status(log), "run_id", "status", "message")
    assert run_store.pending_runs(spark, path).collect() == catalog.pending_runs(log).collect()
    assert run_store.pending_runs(spark, path, 1).collect() == catalog.pending_runs(log, 1).collect()
    run_store.compact_states(spark, path, str(tmp_path / "compact"), 3)
    assert rows_of(run_store.current_runs(spark, str(tmp_path / "compact"))) == rows_of(run_store.current_runs(spark, path))


def test_an_event_before_those_stored_is_an_error(spark, table, tmp_path):
    path = str(tmp_path / "store")
    run_store.create(spark, path)
    run_store.extend(table(LOG, [("a", T0, 5, "initiated", None)]), path, 0)
    with pytest.raises(Exception, match="before those stored for its run: 4"):
        run_store.extend(table(LOG, [("a", T0, 4, "running", None)]), path, 1)
    run_store.extend(table(LOG, [("a", T0, 6, "running", None), ("b", T0 - dt.timedelta(days=9), 1, "running", None)]), path, 1)
    assert rows_of(run_store.current_runs(spark, path), "run_id", "status") == [("a", "running"), ("b", None)]


def test_runs_known_without_a_fold(table):
    rows = log_rows(random.Random(3), 200) + [("only", T0, 999, "running", None), ("noted", T0, 1000, None, "x")]
    log = table(LOG, rows)
    assert rows_of(catalog.known_runs(log)) == rows_of(catalog.committed(log).select("run_id").distinct())
