"""Catalog and run history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cladespark.functions import tables
from cladespark.functions.expressions import fan_out_path, safe_file_name
from cladespark.operators import catalog
from cladespark.operators import transitions as operators_transitions
from tests.conftest import rows_of

LOG = "run_id string, ts timestamp_ntz, event_id long, status string, message string"
T0 = dt.datetime(2024, 1, 1)
STATUSES = ["initiating", "initiated", "running", "retracted", "succeeded", "failed", "stopped", "initiation-failed"]


def log_rows(rng, n, runs=("a", "b", "hot")):
    rows = []
    for i in range(n):
        run = "hot" if rng.random() < 0.5 else rng.choice(runs)
        ts = T0 + dt.timedelta(seconds=rng.randrange(n // 2))
        rows.append((run, ts, i, rng.choice(STATUSES), f"m{i}"))
    return rows


def fold(rows):
    """State machine, one event at a time: {event: (previous event's status, applied, state before)}."""
    out, state, previous = {}, {}, {}
    for run, ts, event, status, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        applied = status not in ("running", "retracted") or state.get(run) == "initiated"
        out[event] = (previous.get(run), applied, state.get(run))
        previous[run] = status
        if applied:
            state[run] = status
    return out


@pytest.mark.parametrize("unit", ["SECOND", "MINUTE", "DAY"])
def test_transitions_against_a_fold(table, unit):
    rows = log_rows(random.Random(len(unit)), 600)
    expected = fold(rows)
    log = table(LOG, rows)
    found = {r.event_id: (r.previous, r.applied) for r in catalog.run_transitions(log, unit).collect()}
    assert found == {event: e[:2] for event, e in expected.items()}
    stops = {r.event_id for r in catalog.overwritten_stops(log, unit).collect()}
    status = {r[2]: r[3] for r in rows}
    assert stops == {e for e, x in expected.items() if x[2] == "stopped" and status[e] in ("succeeded", "failed")}


def fold_any(rows, transitions):
    out, state = {}, {}
    first = dt.datetime.min
    for run, ts, event, status, _ in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1] or first, r[2])):
        out[event] = status is None or status not in transitions or state.get(run) in transitions[status]
        if out[event] and status is not None:
            state[run] = status
    return out


TABLES = [
    {"running": ("initiated", "stopped"), "stopped": ("running",), "succeeded": ("running",), "retracted": ("initiated", "failed")},
    {"initiating": (None,), "initiated": ("initiating",), "running": ("initiated",), "failed": ("running", "initiated"), "succeeded": ("running",)},
    {s: () for s in STATUSES[:3]},
    {s: STATUSES for s in STATUSES},
    {},
]


@pytest.mark.parametrize("transitions", [*TABLES, *range(6)])
@pytest.mark.parametrize("unit", ["SECOND", "HOUR"])
def test_any_table_against_a_fold(table, monkeypatch, transitions, unit):
    """Fixed and random tables; events without a time, a status or a run; chunks and stretches so small that all levels are used."""
    rng = random.Random(str(transitions) + unit)
    if isinstance(transitions, int):
        transitions = {s: rng.sample([*STATUSES, None], rng.randrange(4)) for s in rng.sample(STATUSES, rng.randint(1, 8))}
        monkeypatch.setattr(operators_transitions, "CHUNK", 3)
        monkeypatch.setattr(operators_transitions, "STRETCH_BITS", 2)
    rows = log_rows(rng, 400)
    rows += [("hot", None, 1000 + i, rng.choice(STATUSES), None) for i in range(3)]
    rows += [("a", T0 + dt.timedelta(seconds=i), 2000 + i, None, "note") for i in range(20)]
    rows += [(None, T0 + dt.timedelta(seconds=i), 3000 + i, rng.choice(STATUSES), None) for i in range(40)]
    found = {r.event_id: r.applied for r in catalog.run_transitions(table(LOG, rows), unit, transitions).collect()}
    assert found == fold_any(rows, transitions)


def test_which_tables_the_last_event_decides():
    decided = operators_transitions.decided_by_the_last
    assert decided(catalog.GUARDED) and decided({}) and decided({"x": ("a", "b"), "y": ("b", "a")})
    assert not any(map(decided, [{"x": ("a",), "y": ("b",)}, {"x": ("x",)}, {"x": ("y",), "y": ("y",)}, {"x": (None,)}]))


def test_hot_run_is_spread_over_the_slices(table):
    rows = [("hot", T0 + dt.timedelta(minutes=6 * i), i, "initiated", "") for i in range(2000)]
    sizes = catalog.with_time_slices(table(LOG, rows)).groupBy("run_id", "slice").count().collect()
    assert len(sizes) == 200 and max(r["count"] for r in sizes) == 10


def test_transitions_with_equal_instants(table):
    rows = [("a", T0, i, s, "") for i, s in enumerate(["initiated", "running", "running", "initiated", "retracted"])]
    found = [r.applied for r in catalog.run_transitions(table(LOG, rows)).orderBy("event_id").collect()]
    assert found == [True, True, False, True, True]


def test_events_without_a_time_or_status_are_kept(table):
    rows = [("a", None, 1, "initiated", "m"), ("a", T0, 2, None, None), ("a", T0, 3, "running", None), (None, T0, 4, "failed", None)]
    found = rows_of(catalog.run_transitions(table(LOG, rows)), "run_id", "event_id", "previous", "applied")
    assert found == sorted([("a", 1, None, True), ("a", 2, "initiated", True), ("a", 3, "initiated", True), (None, 4, None, True)], key=repr)


def test_rejected_changes_write_nothing(table):
    rows = [("a", T0, 1, "succeeded", "done"), ("a", T0 + dt.timedelta(hours=1), 2, "running", "late"),
            ("b", T0, 3, "running", None), ("c", T0, 4, "running", None), ("c", T0 + dt.timedelta(days=9), 5, "initiated", None)]
    log = catalog.committed(table(LOG, rows))
    assert rows_of(catalog.run_status(log)) == [("a", "succeeded", "done"), ("c", "initiated", None)]
    assert rows_of(catalog.pending_runs(log)) == [("c", T0 + dt.timedelta(days=9))]


@pytest.mark.parametrize("seed", [1, 2])
def test_committed_status_against_a_fold(table, seed):
    rows = log_rows(random.Random(seed), 400)
    applied = {event for event, (_, ok, _) in fold(rows).items() if ok}
    last = {}
    for run, ts, event, status, message in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if event in applied:
            last[run] = (run, status, message)
    assert rows_of(catalog.run_status(catalog.committed(table(LOG, rows)))) == sorted(last.values())


def test_status_and_as_of(table):
    rows = [("a", T0 + dt.timedelta(hours=h), h, s, f"m{h}") for h, s in enumerate(["initiating", "initiated", "failed"])]
    log = table(LOG, rows + [("a", T0 + dt.timedelta(hours=2), 9, "stopped", "late")])
    assert rows_of(catalog.run_status(log)) == [("a", "stopped", "late")]
    assert rows_of(catalog.run_status_asof(log, "2024-01-01 01:00:00")) == [("a", "initiated", "m1")]


def test_message_stays_until_the_next_one(table):
    rows = [("a", T0, 1, "failed", "broken"), ("a", T0 + dt.timedelta(hours=1), 2, "initiated", None)]
    assert rows_of(catalog.run_status(table(LOG, rows))) == [("a", "initiated", "broken")]


def test_pending_runs_take_the_oldest_creation(table):
    rows = [
        ("late", T0 + dt.timedelta(hours=5), 1, "initiated", ""),
        ("early", T0, 2, "initiating", ""), ("early", T0 + dt.timedelta(hours=9), 3, "initiated", ""),
        ("busy", T0, 4, "initiated", ""), ("busy", T0 + dt.timedelta(hours=1), 5, "running", ""),
    ]
    log = table(LOG, rows)
    assert [r.run_id for r in catalog.pending_runs(log).collect()] == ["early", "late"]
    assert [r.run_id for r in catalog.pending_runs(log, n=1).collect()] == ["early"]


def test_actions(table):
    runs = table("run_id string, status string", [(s, s) for s in [*STATUSES, "interrupted"]])
    assert {r.run_id: r.action for r in catalog.run_actions(runs).collect()} == {
        "initiating": None, "interrupted": None, "initiated": "retract", "running": "stop", "retracted": "remove",
        "succeeded": "remove", "failed": "remove", "stopped": "remove", "initiation-failed": "remove"}


def test_read_pairs_and_blacklist(table):
    files = table("path string", [(p,) for p in (
        "in/a_R1.fastq.gz", "in/a_R2.fastq.gz", "in/b_R1.fastq.gz", "in/c_R2.fastq.gz", "in/a.bam",
        "in/x_S2_R1.fastq.gz", "in/x_S2_R2.fastq.gz", "in/two_R1.fastq.gz", "other/two_R1.fastq.gz",
        "in/two_R2.fastq.gz", "in/d_R3.fastq.gz")])
    pairs = catalog.pair_files(files)
    assert rows_of(pairs) == [
        ("a", "in/a_R1.fastq.gz", "in/a_R2.fastq.gz"),
        ("x_S2", "in/x_S2_R1.fastq.gz", "in/x_S2_R2.fastq.gz")]
    assert rows_of(catalog.drop_blacklisted(pairs, ["_S2"]), "sample_id") == [("a",)]
    assert catalog.drop_blacklisted(pairs, []).count() == 2
    listed = table("pattern string", [("_S2",), ("^zz",), (None,)])
    assert rows_of(catalog.drop_blacklisted(pairs, listed), "sample_id") == [("a",)]
    assert catalog.drop_blacklisted(pairs, listed.limit(0)).count() == 2


def test_file_names(table):
    df = table("name string, file_id string", [("a b(1).fastq.gz", "05989875-be50")])
    assert rows_of(df.select(safe_file_name(F.col("name")), fan_out_path(F.col("file_id")))) == [
        ("a_b_1_.fastq.gz", "05/989875-be50")]


def test_trees_counts_and_links(table):
    accounts = table("account_id string, email string", [("1", "x@example.org"), ("2", "y@example.org")])
    owned = table("account_id string, project_id string", [("1", "p"), ("1", "q")])
    projects = table("project_id string, name string", [("p", "P"), ("q", "Q")])
    account_runs = table("account_id string, run_id string", [("1", "r")])
    runs = table("run_id string, name string, status string", [("r", "R", "failed")])
    assert rows_of(catalog.account_tree(accounts, owned, projects, account_runs, runs)) == [
        ("1", "x@example.org", "project", "p", "P", None), ("1", "x@example.org", "project", "q", "Q", None),
        ("1", "x@example.org", "run", "r", "R", "failed"), ("2", "y@example.org", None, None, None, None)]
    assert rows_of(catalog.account_counts(accounts, owned, account_runs)) == [("1", 2, 1), ("2", 0, 0)]
    removed = table("account_id string, project_id string", [("1", "q")])
    assert rows_of(catalog.unlink(owned, removed)) == [("1", "p")]
    assert rows_of(catalog.lookup(accounts, "email", "y@example.org"), "account_id") == [("2",)]


def test_output_files_of_runs(table):
    runs = table("run_id string, status string", [("r", "succeeded"), ("q", "failed")])
    links = table("run_id string, file_id string", [("r", "05989875"), ("r", "gone"), ("x", "05989875")])
    files = table("file_id string, name string, size long", [("05989875", "a b.txt", 3)])
    assert rows_of(catalog.run_files(runs, links, files)) == [("r", "05989875", "a_b.txt", "05/989875", 3)]


def test_links_to_what_is_gone_stay_visible(table):
    accounts = table("account_id string, email string", [("1", "x@example.org")])
    projects = table("project_id string, name string", [])
    none = table("account_id string, run_id string", [])
    tree = catalog.account_tree(accounts, table("account_id string, project_id string", [("1", "p")]), projects, none,
                                table("run_id string, name string, status string", []))
    assert rows_of(tree) == [("1", "x@example.org", "project", "p", None, None)]


def test_files_of_projects(table):
    projects = table("project_id string, name string", [("p", "P")])
    links = table("project_id string, file_id string", [("p", "f2"), ("p", "f1")])
    files = table("file_id string, name string, size long", [("f1", "b", 1), ("f2", "a", 2)])
    found = catalog.sort_project_files(catalog.project_files(projects, links, files))
    assert [r.file_name for r in found.collect()] == ["a", "b"]
    listing = table("file_id string, size long", [("f1", 7)])
    assert rows_of(catalog.refresh_sizes(files, listing), "file_id", "size") == [("f1", 7), ("f2", None)]


def test_earliest_projects_keep_ties(table):
    rows = [(f"p{i}", T0 + dt.timedelta(days=i // 2)) for i in range(20)]
    projects = table("project_id string, created timestamp_ntz", rows)
    assert rows_of(catalog.earliest_projects(projects), "project_id") == [(f"p{i}",) for i in range(10)]


FACTS = "entity string, attribute string, value string, tx long"


@pytest.mark.parametrize("max_rows", [0, 500_000])
def test_facts_and_their_transactions(table, max_rows):
    """A transaction with a third of all facts, one with very many that is not listed, some without an instant, a NULL, one listed twice."""
    rng = random.Random(9)
    txs = [(i, None if i % 7 == 0 else T0 + dt.timedelta(minutes=i)) for i in range(60)] + [(5, T0)]
    facts = [(f"e{rng.randrange(40)}", rng.choice(["status", "note"]), rng.choice([*STATUSES, None]), rng.choice([1, 999, None, rng.randrange(70)]))
             for _ in range(900)]
    instants = dict(reversed(txs))
    instants[5] = T0
    timed = catalog.with_commit_time(table(FACTS, facts).withColumn("instant_", F.lit(1)), table("tx long, instant timestamp_ntz", txs), max_rows)
    assert rows_of(timed) == sorted(((*f, instants.get(f[3])) for f in facts), key=repr)
    last, created = {}, {}
    first = dt.datetime.min
    for entity, attribute, value, tx in sorted(facts, key=lambda f: (instants.get(f[3]) or first, -1 if f[3] is None else f[3], f[2] or "")):
        at = instants.get(tx)
        created[entity] = min(created.get(entity) or at or dt.datetime.max, at or dt.datetime.max)
        if value is not None:
            last[entity, attribute] = value
    expected = sorted(((e, last.get((e, "status")), last.get((e, "note")), None if c == dt.datetime.max else c) for e, c in created.items()), key=repr)
    assert rows_of(catalog.current_values(timed, ["status", "note"])) == expected
    waiting = [e[0] for e in sorted(expected, key=lambda e: (e[3] is None, e[3] or first, e[0])) if e[1] == "initiated"]
    assert [r["entity"] for r in catalog.pending_entities(timed).collect()] == waiting
    assert [r["entity"] for r in catalog.pending_entities(timed, n=1).collect()] == waiting[:1]


def test_rows_of_a_hot_key_are_spread(spark):
    """Whatever the reference has of them, the rows of a hot key do not meet in one partition."""
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 3 = 0 THEN NULL ELSE id END AS k", "id")
    for reference in (spark.range(5000).selectExpr("id AS k", "id * 2 AS v"), spark.range(10, 5000).selectExpr("id AS k", "id * 2 AS v")):
        out = tables.join_reference(rows, reference, "k", max_rows=0)
        for hot in ("k = 7", "k IS NULL"):
            sizes = [r["count"] for r in out.where(hot).groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < sum(sizes) / 2
        assert out.count() == 20_000
        assert out.where("v IS NOT NULL AND v <> 2 * k").count() == 0


def test_rows_joined_with_a_large_reference_are_dealt_by_their_number(spark, monkeypatch):
    """Partitions planned by bytes, or by the files read, hold more rows the more there are."""
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    rows = spark.range(0, 20_000, 1, 1).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 > 0 THEN id END AS k", "id")
    reference = spark.range(15_000).selectExpr("id AS k", "id * 2 AS v")
    out = tables.join_reference(rows, reference, "k", max_rows=0)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4 * 500
    expected = [(r["k"], r["id"], None if r["k"] is None or r["k"] >= 15_000 else 2 * r["k"]) for r in rows.collect()]
    assert rows_of(out) == sorted(expected, key=repr)
