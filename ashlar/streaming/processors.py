"""Keyed state for streams. Each processor holds a few values per key; rows arrive in Arrow batches.
``Sagas`` holds many keys in one state, since its keys are many and short-lived.

Inputs are reduced before they reach a processor (controls only, one row per bucket), so the rows
of a key in one micro-batch are few and may be ordered here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REGIONS = "track BIGINT, started TIMESTAMP, stopped TIMESTAMP"
REROUTES = "task BIGINT, ts TIMESTAMP, old_target STRING, new_target STRING"
SAGAS = "key BIGINT, sent TIMESTAMP, done TIMESTAMP, state STRING"
CONFLICTS = "worktree BIGINT, ts TIMESTAMP, holder BIGINT, intruder BIGINT"
#: A time that no row has, and the rows that a slot of sagas may take in before it is read again.
NEVER = np.iinfo("i8").max
LOG_ROWS = 50_000
RUNS = "trigger STRING, first_bucket TIMESTAMP, fired_bucket TIMESTAMP, buckets BIGINT"


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _due(micros: int) -> int:
    """The first millisecond at which a moment has passed."""
    return -(-micros // 1000)


class CaptureRegions(StatefulProcessor):
    """Controls of a track → one row per closed region, in the order of their time whatever batch brings them.

    Controls wait in a list until the watermark has passed them, when none before them can come any more; one timer for
    the earliest of them is set. State: the waiting controls and the start of the open region.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started BIGINT")
        self.timer = handle.getValueState("timer", "due BIGINT")
        self.waiting = handle.getListState("waiting", "ts BIGINT, seq BIGINT, event STRING")

    def _wait(self, controls: list[tuple[int, int, str]]) -> None:
        due = _due(min(ts for ts, _, _ in controls)) if controls else None
        before = self.timer.get()[0] if self.timer.exists() else None
        if due == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(c) for c in self.waiting.get()] if self.waiting.exists() else []
        fresh = [(_micros(r.ts), int(r.seq), r.event) for part in rows for r in part.itertuples()]
        self.waiting.put(known + fresh)
        self._wait(known + fresh)
        yield pd.DataFrame(columns=["track", "started", "stopped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        controls = sorted(tuple(c) for c in self.waiting.get()) if self.waiting.exists() else []
        started = self.open.get()[0] if self.open.exists() else None
        out, left = [], []
        for ts, seq, event in controls:
            if ts > passed:
                left.append((ts, seq, event))
            elif event == "CAPTURE" and started is None:
                started = ts
            elif event == "STOP" and started is not None:
                out.append((key[0], _stamp(started), _stamp(ts)))
                started = None
        if started is None:
            self.open.clear()
        else:
            self.open.update((started,))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self.timer.clear()  # it has fired
        self._wait(left)
        yield pd.DataFrame(out, columns=["track", "started", "stopped"])

    def close(self) -> None:
        pass


class Sagas(StatefulProcessor):
    """Commands and steps of many keys, dealt over slots → the rows of the batch form once ``patience`` has passed since a
    key's first row.

    A call of Python costs milliseconds and most keys have a row or two, so the state is kept by slot: rows are appended as
    they come, without reading what is there, and one timer stands for the key of the slot that is due first. When it
    fires, or when more rows came in than the last reading left, the slot is read as arrays: due keys are closed, and of
    the others only rows that can still matter stay: the first command, the first step of all (an orphan if it comes before
    the command), the first that answers the command, and those before the command that are not behind the watermark,
    since an earlier command could still come in front of them.
    """

    def __init__(self, limit_s: float, patience_s: float) -> None:
        self.limit, self.patience = int(limit_s * 1_000_000), int(patience_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "key ARRAY<BIGINT>, at ARRAY<BIGINT>, command ARRAY<BOOLEAN>")
        self.size = handle.getValueState("size", "due BIGINT, left BIGINT, fresh BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, left, fresh = self.size.get() if self.size.exists() else (None, 0, 0)
        before = due
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            self.log.appendValue((part["key"].tolist(), at.tolist(), part["command"].tolist()))
            fresh += len(part)
            opened = _due(int(at.min()) + self.patience)
            due = opened if due is None else min(due, opened)
        if fresh > max(left, LOG_ROWS):
            _, left = self._sweep(timerValues.getCurrentWatermarkInMs(), closing=False)
            fresh = 0
        self.size.update((due, left, fresh))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        yield self._rows([], [], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, left, made = None, 0, self._rows([], [], [], [])
        if self.log.exists():
            (first, made), left = self._sweep(timerValues.getCurrentWatermarkInMs(), closing=True)
        if first is None:
            self.size.clear()
        else:
            self.size.update((_due(first + self.patience), left, 0))
            self.handle.registerTimer(_due(first + self.patience))
        yield made

    def _sweep(self, watermark: int, closing: bool) -> tuple[tuple[int | None, pd.DataFrame], int]:
        """Reads the slot and writes back what can still matter: the first time left and the rows of closed keys, rows left."""
        columns = zip(*self.log.get(), strict=True)
        key, at, command = (np.concatenate([np.array(c, kind) for c in part]) for part, kind in zip(columns, ("i8", "i8", "?"), strict=True))
        order = np.lexsort((command, at, key))
        key, at, command = key[order], at[order], command[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))

        def earliest(which: np.ndarray) -> np.ndarray:
            return np.minimum.reduceat(np.where(which, at, NEVER), starts)

        first, sent, step = at[starts], earliest(command), earliest(~command)
        done = earliest(~command & (at >= sent[group]))
        closed = np.full(len(starts), closing) & (-(-(first + self.patience) // 1000) <= watermark)
        again = np.r_[False, (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (command[1:] == command[:-1])]
        matters = np.where(
            command, at == sent[group], (at == step[group]) | (at == done[group]) | ((at < sent[group]) & (at > watermark * 1000))
        )
        stays = matters & ~again & ~closed[group]
        if stays.any():
            self.log.put([(key[stays].tolist(), at[stays].tolist(), command[stays].tolist())])
        else:
            self.log.clear()
        asked, orphan = closed & (sent != NEVER), closed & (step < sent)
        answered = done[asked] != NEVER
        late = answered & (np.where(answered, done[asked], 0) - sent[asked] > self.limit)
        state = np.where(answered, np.where(late, "late step", "complete"), "missing step")
        keys, none = key[starts], np.full(orphan.sum(), NEVER)
        made = self._rows(
            np.r_[keys[asked], keys[orphan]], np.r_[sent[asked], none], np.r_[done[asked], step[orphan]],
            [*state.tolist(), *["orphan step"] * len(none)],
        )
        return (None if closed.all() else int(first[~closed].min()), made), int(stays.sum())

    def _rows(self, key, sent, done, state) -> pd.DataFrame:
        def time(at) -> pd.Series:
            at = np.asarray(at, "i8")
            return pd.Series(np.where(at == NEVER, np.iinfo("i8").min, at).astype("datetime64[us]"))  # the least number is NaT

        return pd.DataFrame({"key": np.asarray(key, "i8"), "sent": time(sent), "done": time(done), "state": pd.Series(state, dtype=object)})

    def close(self) -> None:
        pass


class Reroutes(StatefulProcessor):
    """Observed shapes of a task → a row when its latest shape asks for another target.

    A new task starts with the target of its first shape. A task that isn't observed for ``idle`` is over: an event-time
    timer frees its state, and if it is observed again, it is a new one.
    """

    def __init__(self, targets: dict[str, str], default: str, idle_s: float) -> None:
        self.targets, self.default, self.idle = targets, default, int(idle_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "ts BIGINT, target STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        oldest = newest = None
        for part in rows:  # only two rows are kept, so a busy task costs no memory
            low, high = part.loc[part["ts"].idxmin()], part.loc[part["ts"].idxmax()]
            oldest = low if oldest is None or low["ts"] < oldest["ts"] else oldest
            newest = high if newest is None or high["ts"] > newest["ts"] else newest
        at = _micros(newest["ts"])
        seen, current = self.current.get() if self.current.exists() else (None, None)
        if seen is not None and seen > at:
            return
        if seen is None or _micros(oldest["ts"]) - seen >= self.idle:  # new, or over though its timer lags behind
            current = self.targets.get(oldest["shape"], self.default)
        if seen != at:
            if seen is not None:
                self.handle.deleteTimer(_due(seen + self.idle))
            self.handle.registerTimer(_due(at + self.idle))
        target = self.targets.get(newest["shape"], self.default)
        self.current.update((at, target))
        if target != current:
            yield pd.DataFrame([(key[0], newest["ts"], current, target)], columns=["task", "ts", "old_target", "new_target"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.current.clear()
        yield pd.DataFrame(columns=["task", "ts", "old_target", "new_target"])

    def close(self) -> None:
        pass


class WorktreeHolder(StatefulProcessor):
    """Activity buckets of a worktree → a row each time another agent edits while the holder holds it.

    The first agent holds the worktree until ``hold_s`` pass without an edit of its own; an
    event-time timer then frees the state.
    """

    def __init__(self, hold_s: int) -> None:
        self.hold = hold_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "agent BIGINT, seen BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        agent, seen = self.holder.get() if self.holder.exists() else (None, 0)
        before, out = seen, []
        for r in _ordered(rows, ["ts", "agent"]).itertuples():
            at = _micros(r.ts)
            if agent is None or at - seen >= self.hold:
                agent, seen = int(r.agent), at
            elif r.agent == agent:
                seen = max(seen, at)
            else:
                out.append((key[0], r.ts, agent, int(r.agent)))
        self.holder.update((agent, seen))
        if before:
            self.handle.deleteTimer((before + self.hold) // 1000)
        self.handle.registerTimer((seen + self.hold) // 1000)
        yield pd.DataFrame(out, columns=["worktree", "ts", "holder", "intruder"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.holder.clear()
        yield pd.DataFrame(columns=["worktree", "ts", "holder", "intruder"])

    def close(self) -> None:
        pass


class SustainedRuns(StatefulProcessor):
    """Buckets that meet one trigger, the key → one row when a run reaches its length."""

    def __init__(self, bucket_s: int) -> None:
        self.step = bucket_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "first BIGINT, last BIGINT, n BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.run.get() if self.run.exists() else (0, 0, 0)
        out = []
        for r in _ordered(rows, ["bucket"]).itertuples():
            at = _micros(r.bucket)
            if n and at - last == self.step:
                n += 1
            else:
                first, n = at, 1
            last = at
            if n == r.sustain:
                out.append((*key, _stamp(first), r.bucket, n))
        self.run.update((first, last, n))
        yield pd.DataFrame(out, columns=["trigger", "first_bucket", "fired_bucket", "buckets"])

    def close(self) -> None:
        pass
