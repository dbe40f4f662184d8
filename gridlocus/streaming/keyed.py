"""Keyed state that sees the rows of a key one by one in event-time order.

Rows wait in the state store until the watermark has passed their instant: so rows may arrive in any order
within the allowed lateness, in any micro-batch.  Each call to the state store costs far more than a row, so keys share
the state of one of ``GROUPS`` groups, which is read and written a few times per micro-batch, not per key or row; the
first rows that wait lie together, those of a busy group in slots of ten minutes, so no more rows of a group are in
memory than ``FEW`` and those of a slot.  Rows behind the watermark are dropped by the engine.  What is known of a key
is a record of constant size that goes when its time to live is over.  The state store has to keep timers on disk
(``session.ENGINE_CONF`` names it)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MICROS = 1_000_000
#: Groups of keys, by hash.  A stream's state is bound to this number.
GROUPS = 4096
#: Rows of a group that wait together, and the width in milliseconds of the slots that more of them wait in.
FEW = 16_384
SLOT = 600_000


def until(micros: int) -> int:
    """The first millisecond not before an instant: a watermark there has passed the instant."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """``known`` is the schema of what is known of a key (nothing yet: None), ``keep`` its life in seconds after ``since``.

    ``decide(key, known, micros, id, kind)`` gives (known, output row or None).  Rows of one instant come by kind, then id.
    An input row without id only moves the watermark on.  The grouping key is the number of a group whose rows name their own
    ``key``, of the type ``kind_of_key``; rows that name none have the grouping key."""

    known = "n bigint"
    keep = 24 * 3600
    kind_of_key = "string"

    def decide(self, key: Any, known: tuple | None, micros: int, number: int, kind: int) -> tuple[tuple | None, Row | None]:
        raise NotImplementedError

    def since(self, known: tuple) -> int:
        """The instant from which a record's life counts, in microseconds."""
        raise NotImplementedError

    def life(self, known: tuple) -> int:
        return self.keep

    def init(self, handle) -> None:
        self.handle = handle
        rows = f"micros array<bigint>, ids array<bigint>, kinds array<int>, keys array<{self.kind_of_key}>"
        fields = [field.strip().split(" ", 1) for field in self.known.split(", ")]
        self.waiting = handle.getValueState("waiting", f"{rows}, slots array<bigint>")
        self.filed = handle.getMapState("filed", "slot bigint", rows)
        self.record = handle.getValueState("record", ", ".join([f"{n} array<{kind}>" for n, kind in fields] + [f"keys array<{self.kind_of_key}>"]))
        self.alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.take((row.micros, row.kind, row.id, row.key if "key" in row else key[0]) for row in rows if row.id is not None)
        return iter(())

    def take(self, rows: Iterable[tuple]) -> None:
        """Let rows (micros, kind, id, key) wait."""
        few, slots = self._waiting()
        before = self._next(few, slots)
        for row in rows:
            few.append(row)
            if len(few) >= FEW:
                slots, few = self._file(few, slots), []
        self._wait(few, slots, before)

    def _waiting(self) -> tuple[list[tuple], list[int]]:
        """The rows (micros, kind, id, key) that wait together, and the slots that hold others, in order."""
        state = self.waiting.get()
        return (list(zip(state[0], state[2], state[1], state[3])), list(state[4])) if state else ([], [])

    def _file(self, few: list[tuple], slots: list[int]) -> list[int]:
        """Put rows into their slots; gives the slots in use."""
        by_slot: dict[int, list[tuple]] = {}
        for row in few:
            by_slot.setdefault(until(row[0]) // SLOT, []).append(row)
        known = set(slots)
        for slot, rows in by_slot.items():
            held = self.filed.getValue((slot,)) if slot in known else ([], [], [], [])
            micros, kinds, ids, keys = zip(*rows)
            self.filed.updateValue((slot,), ([*held[0], *micros], [*held[1], *ids], [*held[2], *kinds], [*held[3], *keys]))
        return sorted(known | by_slot.keys())

    def _next(self, few: list[tuple], slots: list[int]) -> int | None:
        """The first instant to look at the waiting rows again."""
        return min([until(row[0]) for row in few] + [slot * SLOT for slot in slots[:1]], default=None)

    def _wait(self, few: list[tuple], slots: list[int], rings: int | None) -> None:
        """Keep the rows; ``rings`` is the instant of the timer that is set already."""
        at = self._next(few, slots)
        if at is None:
            if self.waiting.exists():
                self.waiting.clear()
            return
        self.waiting.update(([r[0] for r in few], [r[2] for r in few], [r[1] for r in few], [r[3] for r in few], slots))
        if at != rings:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rang = expiredTimerInfo.getExpiryTimeInMs()
        now = max(rang, timerValues.getCurrentWatermarkInMs() - 1)  # instants up to here have passed
        few, slots = self._waiting()
        records = self._records()
        if few or slots:
            late = [row for row in few if until(row[0]) > now]
            due = sorted((row for row in few if until(row[0]) <= now), key=itemgetter(0))
            passed = [slot for slot in slots if slot * SLOT <= now]
            for part, slot in self._parts(due, passed):
                if slot is not None:
                    micros, ids, kinds, keys = self.filed.getValue((slot,))
                    self.filed.removeKey((slot,))
                    filed = list(zip(micros, kinds, ids, keys))
                    late += [row for row in filed if until(row[0]) > now]
                    part += [row for row in filed if until(row[0]) <= now]
                by_key: dict[Any, list[tuple]] = {}
                for row in part:
                    by_key.setdefault(row[3], []).append(row)
                for one, rows in by_key.items():
                    known, outs = self._decided(one, records.pop(one, None), rows)
                    if known is not None:
                        records[one] = known
                    yield from outs
            self._wait(late, slots[len(passed) :], None)
        self._store({one: known for one, known in records.items() if self._over(known) >= now}, now)

    def _records(self) -> dict[Any, tuple]:
        """What is known of each key of the group."""
        state = self.record.get()
        return dict(zip(state[-1], zip(*state[:-1]))) if state else {}

    def _decided(self, key: Any, known: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        """The record after rows of one key, taken by instant, kind and id, and the output."""
        outs = []
        for at, same in groupby(sorted(rows, key=itemgetter(0, 1, 2)), lambda row: until(row[0])):
            if known is not None and self._over(known) + 1 < at:
                known = None
            for micros, kind, number, _ in same:
                known, out = self.decide(key, known, micros, number, kind)
                if out is not None:
                    outs.append(out)
            if known is not None and self._over(known) < at:
                known = None
        return known, outs

    @staticmethod
    def _parts(due: list[tuple], slots: list[int]) -> Iterator[tuple[list[tuple], int | None]]:
        """The due rows in order, each slot together with those of its time."""
        first = 0
        for slot in slots:
            start = first
            while first < len(due) and until(due[first][0]) < slot * SLOT:
                first += 1
            yield due[start:first], None
            start = first
            while first < len(due) and until(due[first][0]) < (slot + 1) * SLOT:
                first += 1
            yield due[start:first], slot
        yield due[first:], None

    def _over(self, known: tuple) -> int:
        """The end of a record's life."""
        return until(self.since(known) + self.life(known) * MICROS)

    def _store(self, records: dict[Any, tuple], now: int) -> None:
        """Keep the records and one alarm, at which they are looked at again; each later alarm replaces the one that rang."""
        if not records:
            for state in (self.record, self.alarm):
                if state.exists():
                    state.clear()
            return
        self.record.update((*(list(field) for field in zip(*records.values())), list(records)))
        alarm = self.alarm.get()
        if alarm is None or alarm[0] <= now:
            ring = max(min(map(self._over, records.values())), now) + 1
            self.alarm.update((ring,))
            self.handle.registerTimer(ring)

    def close(self) -> None:
        pass


class InFrames(StatefulProcessor):
    """A processor that takes and gives its rows as frames: Spark converts each cell of a row by itself, a frame by columns."""

    def __init__(self, rows: InOrder):
        self.rows = rows

    def init(self, handle) -> None:
        self.rows.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        of = int if self.rows.kind_of_key in INTEGERS else lambda k: k
        self.rows.take(
            (micros, None if kind < 0 else kind, number, None if k is None else of(k))
            for frame in rows
            for micros, kind, number, k, real in zip(*(frame[c].tolist() for c in ("micros", "kind", "id", "key", "real")))
            if real)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        outs = self.rows.handleExpiredTimer(key, timerValues, expiredTimerInfo)
        while rows := list(islice(outs, 10_000)):
            # objects: a column of integers and nulls would become one of doubles
            yield pd.DataFrame({name: pd.Series(list(column), dtype=object) for name, column in zip(rows[0].__fields__, zip(*rows))})

    def close(self) -> None:
        pass


#: Types of keys that a frame cannot hold beside a null; they travel as text.
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def in_order(rows: DataFrame, processor: InOrder, schema: str, key: str, ts: str, number: str, kind, late: str) -> DataFrame:
    """Decisions of the processor on a stream.  ``late`` is how long a row may come after later ones.  Keys are integers or texts."""
    processor.kind_of_key = rows.schema[key].dataType.simpleString()
    if processor.kind_of_key not in (*INTEGERS, "string"):
        raise TypeError(f"{key}: keys are integers or texts, not {processor.kind_of_key}")
    named = rows.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("group"), F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("micros"),
        F.coalesce(F.col(number).cast("long"), F.lit(0)).alias("id"), F.col(number).cast("long").isNotNull().alias("real"),
        F.coalesce(kind.cast("int"), F.lit(-1)).alias("kind"))
    return named.groupBy("group").transformWithStateInPandas(InFrames(processor), schema, "append", "eventTime")


class RateLimit(InOrder):
    """Known: the instants of the last accepted rows of the window."""

    known = "recent array<bigint>"

    def __init__(self, limit: int, seconds: int):
        self.limit, self.keep = limit, seconds

    def since(self, known):
        return known[0][-1] if known[0] else 0

    def decide(self, key, known, micros, number, kind):
        recent = [t for t in (known[0] if known else []) if t > micros - self.keep * MICROS]
        accepted = len(recent) < self.limit
        out = Row(event_id=number, key=key, micros=micros, accepted=accepted, remaining=max(0, self.limit - len(recent) - 1))
        return ((recent + [micros] if accepted else recent),), out


class RollingCount(InOrder):
    """Known: the last ``most`` instants.  Earlier rows of the window are counted, up to ``most``."""

    known = "recent array<bigint>"

    def __init__(self, most: int, seconds: int):
        self.most, self.keep = most, seconds

    def since(self, known):
        return known[0][-1]

    def decide(self, key, known, micros, number, kind):
        recent = [t for t in (known[0] if known else []) if t > micros - self.keep * MICROS]
        out = Row(event_id=number, key=key, n_before=len(recent), limited=len(recent) >= self.most)
        return ([*recent, micros][-self.most :],), out


class LatestLookup(InOrder):
    """Known: the last lookup.  Kind 0 is a lookup, kind 1 a click."""

    known = "id bigint, micros bigint"

    def __init__(self, seconds: int):
        self.keep = seconds

    def since(self, known):
        return known[1]

    def decide(self, key, known, micros, number, kind):
        if not kind:
            return (number, micros), None
        near = known is not None and micros - known[1] <= self.keep * MICROS
        return known, Row(click_id=number, key=key, lookup_id=known[0] if near else None)


class FailureRun(InOrder):
    """Known: failures in a row and the instant of the last call.  Kind 1 is a success."""

    known = "run bigint, micros bigint"

    def __init__(self, threshold: int, cooldown: int, keep: int):
        self.threshold, self.cooldown, self.keep = threshold, cooldown, keep

    def since(self, known):
        return known[1]

    def decide(self, key, known, micros, number, kind):
        run, last = known or (0, None)
        disabled = run >= self.threshold and last is not None and micros - last <= self.cooldown * MICROS
        run = 0 if kind else run + 1
        return (run, micros), Row(call_id=number, source=key, run_length=run, disabled=disabled)


class CacheLives(InOrder):
    """Known: the entry in the cache.  A request finds it while it is younger than the life of its kind, else it asks again and the
    answer (the row's kind) takes the entry's place; a failure is never kept, nor does it remove an entry."""

    known = "id bigint, micros bigint, kind int"

    def __init__(self, lives: dict[int, int]):
        self.lives = lives

    def since(self, known):
        return known[1]

    def life(self, known):
        return self.lives[known[2]]

    def decide(self, key, known, micros, number, kind):
        if known is not None and micros - known[1] < self.lives[known[2]] * MICROS:
            return known, Row(request_id=number, key=key, cached=True, answered_by=known[0])
        if kind in self.lives:
            known = (number, micros, kind)
        return known, Row(request_id=number, key=key, cached=False, answered_by=number if kind in self.lives else None)
