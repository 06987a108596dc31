"""Guarded changes of state under any table of transitions, as compositions of small maps.

An event is a map from the state before it to the state after it, and so is any stretch of events: the maps composed. Events are
composed within time slices, slices within long stretches of time, and those within a run; the states that these begin with then go back down. No
step walks a whole run event by event. States that no change is guarded by count as one, so a map is a few numbers.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions.tables import stored

#: By status: the states it takes effect from, None for a run without any. Other changes always apply.
Transitions = Mapping[str, Collection[str | None]]

CHUNK = 256
STRETCH_BITS = 12
RUN = ("_run", "_without")
OTHER = 0


def decided_by_the_last(transitions: Transitions) -> bool:
    """Whether the event before a guarded one decides: all guards are the same, and no guarded change leads to them.

    Then a run is in a state of the guards exactly after an event that gives it: whatever follows either overwrites it or is let through.
    """
    guards = {frozenset(sources) for sources in transitions.values()}
    return len(guards) <= 1 and not any(None in g or g & set(transitions) for g in guards)


class _States:
    """The states that guards tell apart, numbered; all others are ``OTHER``."""

    def __init__(self, transitions: Transitions):
        told_apart = {s for sources in transitions.values() for s in sources}
        self.numbers = {s: i for i, s in enumerate(sorted(told_apart, key=lambda s: (s is not None, s)), OTHER + 1)}
        self.transitions, self.every = transitions, range(len(self.numbers) + 1)

    def number(self, state: str | None) -> int:
        return self.numbers.get(state, OTHER)

    def _allowed(self, status: str) -> set[int]:
        return {self.number(s) for s in self.transitions[status]} if status in self.transitions else set(self.every)

    def by_status(self, of_status, unknown: list) -> Column:
        """A constant array for each status, for others that of a change that always applies, and one for no change."""
        def literal(values: list) -> Column:
            return F.array(*[F.lit(v) for v in values])

        status = F.col("status")
        chosen = literal(of_status(OTHER, set(self.every)))
        for name in {*self.transitions, *(s for s in self.numbers if s is not None)}:
            chosen = F.when(status == name, literal(of_status(self.number(name), self._allowed(name)))).otherwise(chosen)
        return F.when(status.isNull(), literal(unknown)).otherwise(chosen)

    def after(self) -> Column:
        """The state after an event, by the state before it."""
        return self.by_status(lambda to, allowed: [to if s in allowed else s for s in self.every], list(self.every))

    def taken(self) -> Column:
        """The state that an event gives, whatever the state before it."""
        return self.by_status(lambda to, _: [to for _ in self.every], list(self.every))

    def applies(self) -> Column:
        """Whether an event applies, by the state before it."""
        return self.by_status(lambda _, allowed: [s in allowed for s in self.every], [True for _ in self.every])


def _composed(maps: Column, n_states: int) -> Column:
    unchanged = F.array(*[F.lit(i) for i in range(n_states)])
    return F.aggregate(maps, unchanged, lambda done, step: F.transform(done, lambda state: step["after"][state]))


def _walk(steps: Column, first: Column, value, kind: str) -> Column:
    """What ``value`` says of every step and the state before it, in order."""
    start = F.struct(first.alias("state"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out"))
    return F.aggregate(
        steps, start,
        lambda done, step: F.struct(
            step["after"][done["state"]].alias("state"), F.array_append(done["out"], value(step, done["state"])).alias("out")
        ),
        lambda done: done["out"],
    )


def applied_events(events: DataFrame, transitions: Transitions, always: str | None = None) -> DataFrame:
    """Rows (run_id, slice, ts, event_id, status, any more columns) with ``applied``: whether each event took effect in its run.

    Events are in the order of slice, time and id; one without a status changes nothing and counts as applied. Where the column
    ``always`` is true, a change applies whatever the state. Of a run, no row
    holds more than ``CHUNK`` events, or the maps of more than one stretch of slices.
    """
    states = _States(transitions)
    n = len(states.every)
    columns = events.columns
    run = [F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("_run"), F.col("run_id").isNull().alias("_without")]
    order = Window.partitionBy(*RUN, "slice").orderBy("ts", "event_id")
    numbered = events.select("*", *run).withColumn("_place", F.row_number().over(order))
    after, applies = states.after(), states.applies()
    if always is not None:
        after = F.when(F.col(always), states.taken()).otherwise(after)
        applies = F.when(F.col(always), F.array(*[F.lit(True) for _ in states.every])).otherwise(applies)
    event = F.struct("_place", F.struct(*columns).alias("row"), after.alias("after"), applies.alias("applies"))
    chunk = ((F.col("_place") - 1) / CHUNK).cast("long")
    chunks = stored(
        numbered.groupBy(*RUN, "slice", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(event)).alias("events")), "event-chunks"
    )
    maps = chunks.select(*RUN, "slice", "chunk", F.shiftright("slice", STRETCH_BITS).alias("stretch"), _composed(F.col("events"), n).alias("after"))
    stretches = maps.groupBy(*RUN, "stretch").agg(F.sort_array(F.collect_list(F.struct("slice", "chunk", "after"))).alias("parts"))
    whole = stretches.select(*RUN, "stretch", _composed(F.col("parts"), n).alias("after"))
    runs = whole.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("stretch", "after"))).alias("parts"))

    first = F.lit(states.number(None))
    begun = runs.select(
        *RUN, F.inline(_walk(F.col("parts"), first, lambda p, s: F.struct(p["stretch"].alias("stretch"), s.alias("state")), "struct<stretch: bigint, state: int>"))
    )
    inner = stretches.join(begun, [*RUN, "stretch"]).select(
        *RUN,
        F.inline(
            _walk(
                F.col("parts"), F.col("state"), lambda p, s: F.struct(p["slice"].alias("slice"), p["chunk"].alias("chunk"), s.alias("state")),
                "struct<slice: bigint, chunk: bigint, state: int>",
            )
        ),
    )
    flags = _walk(F.col("events"), F.col("state"), lambda e, s: e["applies"][s], "boolean")
    told = chunks.join(inner, [*RUN, "slice", "chunk"]).select(F.explode(F.arrays_zip("events", flags.alias("applied"))).alias("e"))
    return told.select("e.events.row.*", "e.applied")
