"""Keyed state with timers and expiry: what a key keeps is of bounded size, whatever has passed.

Each processor folds the frames of a key one by one. Rows that come late, or again, have stated effects.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The weight of a new answer, while there are few and later.
EARLY, LATER, FEW = 0.6, 0.4, 2
#: Milliseconds of event time for which a repeated event is known again.
REMEMBERED = 7 * 86_400_000


class Mastery(StatefulProcessor):
    """An exponential mean of right answers, one event at a time.

    Events of a batch count in order of (ts, event_id). One that comes in a later batch than a newer one counts when
    it comes. One whose id was seen within REMEMBERED of the newest event counts once.
    """

    OUTPUT = "user_id long, event_type string, attempts long, mastery double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "attempts long, mastery double")
        self.seen = handle.getValueState("seen", "ms array<long>, event_id array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mastery = (self.mean.get() if self.mean.exists() else None) or (0, 0.0)
        known = dict(zip(*reversed(tuple(self.seen.get())), strict=True)) if n else {}
        new = sorted((int(m), int(e), float(v)) for frame in rows for m, e, v in zip(frame["ms"], frame["event_id"], frame["value"], strict=True))
        for ms, event, value in new:
            if event in known:
                continue
            known[event] = ms
            n += 1
            weight = EARLY if n <= FEW else LATER
            mastery = round((1 - weight) * mastery + weight * float(value > 10), 4)
        kept = {e: ms for e, ms in known.items() if ms > max(known.values()) - REMEMBERED} if known else {}
        self.seen.update((list(kept.values()), list(kept)))
        self.mean.update((int(n), float(mastery)))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "attempts": [n], "mastery": [mastery]})


class Timings(StatefulProcessor):
    """Count, last and 95th percentile of the last ``window`` values of a key, by (ts, event_id).

    A value older than all of a full window has no effect, one that is in it already has none either; late ones
    take their place.
    """

    OUTPUT = "event_type string, n long, last double, p95 double"

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ms array<long>, event_id array<long>, value array<double>")

    def last(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each frame what can be among the last of a key, so that a key with many rows sends few."""
        for frame in frames:
            yield frame.sort_values(["ms", "event_id"]).groupby("event_type", sort=False, dropna=False).tail(self.window)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(m, e): v for m, e, v in zip(*self.held.get(), strict=True)} if self.held.exists() else {}
        for frame in rows:
            held.update({(int(m), int(e)): float(v) for m, e, v in zip(frame["ms"], frame["event_id"], frame["value"], strict=True)})
            held = dict(sorted(held.items())[-self.window :])
        values = list(held.values())
        self.held.update(([m for m, _ in held], [e for _, e in held], values))
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(values)], "last": [values[-1]], "p95": [sorted(values)[min(int(len(values) * 0.95), len(values) - 1)]]})


class Memory(StatefulProcessor):
    """The last turns of a conversation, and a digest of those before once there are more than ``after``.

    Turns of a batch are in order of (turn, role, text); a turn that comes in a later batch is after them.
    """

    OUTPUT = "conv_id long, messages long, recent string, summary string"

    def __init__(self, window: int, after: int, chars: int):
        self.window, self.after, self.chars = window, after, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "messages long")
        self.digest = handle.getValueState("digest", "summary string")
        self.recent = handle.getValueState("recent", "lines array<string>")

    def cut(self, text: str) -> str:
        half = self.chars // 2
        return text if len(text) <= self.chars else f"{text[:half]}\n...\n{text[-half:]}"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.count.get()[0] if self.count.exists() else 0
        summary = (self.digest.get()[0] if self.digest.exists() else "") or ""
        recent = list(self.recent.get()[0]) if seen else []
        new = sorted((int(t), r or "", (x or "").strip()[:400]) for frame in rows for t, r, x in zip(frame["turn"], frame["role"], frame["text"], strict=True))
        every = recent + [f"{'Learner' if role == 'user' else 'Tutor'}: {text}" for _, role, text in new]
        seen += len(new)
        older, recent = every[: -self.window], every[-self.window :]
        if older:  # the digest takes in what leaves the window, and is shown once there are enough
            summary = self.cut("\n".join(filter(None, [summary, *older])))
        self.count.update((seen,)), self.digest.update((summary,)), self.recent.update((recent,))
        yield pd.DataFrame({"conv_id": [key[0]], "messages": [seen], "recent": ["\n".join(recent)], "summary": [summary if summary and seen > self.after else None]})


class Cache(StatefulProcessor):
    """The last value that was put under a key, until ``ttl`` milliseconds of event time later a timer takes it away.

    A value older than the one that is there has no effect. Putting a value anew puts the timer off.
    """

    OUTPUT = "user_id long, event_type string, value double, expired boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "ms long, event_id long, value double")

    def _row(self, key, value: float, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "value": [value], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.entry.get() if self.entry.exists() else None
        newest = max(max(zip(f["ms"], f["event_id"], f["value"], strict=True)) for f in rows if len(f))
        newest = (int(newest[0]), int(newest[1]), float(newest[2]))
        if before is None or tuple(before)[:2] < newest[:2]:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.ttl)
            self.handle.registerTimer(newest[0] + self.ttl)
            self.entry.update(newest)
            yield self._row(key, newest[2], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            value = self.entry.get()[2]
            self.entry.clear()
            yield self._row(key, value, True)
