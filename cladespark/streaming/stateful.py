"""Keyed state for streams: samples until they are complete, runs until their changes can no longer come late.

The state of a key is a few rows: a panel's worth of states, or the events of a run that are newer than the watermark. Both are
plain folds over what has arrived, so the order of arrival does not matter within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cladespark.operators.transitions import Transitions

STATES = "sample_id string, chrom string, pos long, alt string"
GATHERED = f"{STATES}, n_sites long, is_complete boolean"
HELD = "last long, chrom array<string>, pos array<long>, alt array<string>"
STATUS = "run_id string, status string, message string"
HISTORY = (
    "known boolean, state string, status string, message string, folded_to long, "
    "ts array<long>, event_id array<long>, statuses array<string>, messages array<string>"
)
NO_TIME = -(1 << 63)


def _gather(n_sites: int, patience_ms: int):
    """Hold a sample's states; send all of them whenever its sites are complete, or once when its time is over."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *lists = state.get if state.exists else (0, [], [], [])
        chrom, pos, alt = (list(c) for c in lists)
        for batch in batches:
            if not len(batch):  # a group that is only timed out
                continue
            last = max([last, *map(int, batch["arrived_ms"].dropna())])
            chrom += batch["chrom"].tolist()
            pos += batch["pos"].tolist()
            alt += batch["alt"].where(batch["alt"].notna(), None).tolist()
        seen = len(set(zip(chrom, pos, strict=True)))
        over = state.hasTimedOut
        if over:
            state.remove()
        else:
            state.update((last, chrom, pos, alt))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last) + patience_ms)
        if seen >= n_sites and not over or seen < n_sites and over:
            yield pd.DataFrame(
                {"sample_id": key[0], "chrom": chrom, "pos": pos, "alt": alt, "n_sites": seen, "is_complete": seen >= n_sites}
            )

    return run


def gathered_states(states: DataFrame, sites: DataFrame, arrived: str, patience: str, patience_ms: int) -> DataFrame:
    """Stream of the states (sample_id, chrom, pos, alt) of samples that have one at every site of ``sites``, however many files they come in.

    Each time a complete sample gets more states all of them are sent again. A sample that is not complete when the watermark on
    ``arrived``, which is ``patience`` behind the latest, is ``patience`` past its last arrival is sent once as it is, marked, and forgotten. States off the sites are left out.
    """
    panel = sites.select("chrom", "pos").distinct()
    n_sites = panel.count()
    narrow = states.withWatermark(arrived, patience).join(F.broadcast(panel), ["chrom", "pos"], "left_semi")
    at = F.unix_millis(arrived).alias("arrived_ms")
    return narrow.select("sample_id", "chrom", "pos", "alt", arrived, at).groupBy("sample_id").applyInPandasWithState(
        _gather(n_sites, patience_ms), GATHERED, HELD, "append", GroupStateTimeout.EventTimeTimeout
    )


def _plain(column: pd.Series) -> list:
    """The values of a column, None where one is missing. A group is a few rows, so a frame of objects would cost more than they do."""
    return [None if v is None or v != v else v for v in column.tolist()]


def _status(transitions: Transitions) -> Callable:
    """Apply a run's changes in the order of time and id: those before the watermark for good, newer ones on top, again with every arrival."""

    def applied(state: str | None, status: str) -> bool:
        return status not in transitions or state in transitions[status]

    def fold(state, status, message, events):
        for _, _, new, note in events:
            if new is not None and not applied(state, new):
                continue
            state = new if new is not None else state
            status = new if new is not None else status
            message = note if note is not None else message
        return state, status, message

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known, state, status, message, folded_to, *lists = held.get if held.exists else (False, None, None, None, NO_TIME, [], [], [], [])
        events = {(t, i): (t, i, s, m) for t, i, s, m in zip(*lists, strict=True)}
        for batch in batches:
            for t, i, s, m in zip(*[_plain(batch[c]) for c in ("at", "event_id", "status", "message")], strict=True):
                t = NO_TIME if t is None else int(t)
                if t > folded_to or not known:
                    events[t, int(i)] = (t, int(i), s, m)
        ordered = sorted(events.values(), key=lambda e: e[:2])
        settled = max(held.getCurrentWatermarkMs(), 0) * 1000
        old = [e for e in ordered if e[0] <= settled]
        if old and old[-1][0] != NO_TIME:
            state, status, message = fold(state, status, message, old)
            known, folded_to, ordered = True, max(folded_to, old[-1][0]), ordered[len(old) :]
        _, last, note = fold(state, status, message, ordered)
        held.update((known, state, status, message, folded_to, *([list(c) for c in zip(*ordered, strict=True)] or [[], [], [], []])))
        if last is not None or note is not None or known:
            yield pd.DataFrame({"run_id": [key[0]], "status": [last], "message": [note]})

    return run


def judged_status(log: DataFrame, transitions: Transitions, lateness: str) -> DataFrame:
    """Stream of the status and message of every run that raw events (run_id, ts, event_id, status, message) arrived for.

    Guarded changes are judged here, as ``run_transitions`` judges a whole log. Events may come in any order and more than once within
    ``lateness`` of the latest; what comes later than that is dropped. Until then a run's status is that of what has arrived
    so far, and is sent again when an event changes the past. Events without a time come first; they count while nothing of their run is settled.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = log.withColumn("at", at).withColumn("seen", F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()))
    return timed.withWatermark("seen", lateness).groupBy("run_id").applyInPandasWithState(
        _status(transitions), STATUS, HISTORY, "update", GroupStateTimeout.NoTimeout
    )
