"""Keyed state of the streaming jobs, one processor per kind of key.

State is bounded: running counts and sums, at most ``VOLUME_HISTORY`` samples, at most one window of matches, and a
map with one entry per known value. Every entry has a time to live that starts again when it is used, and a
timer per key drops what is left of a key that nothing arrives for, so keys and values that are gone cost nothing.
A row is judged by what came before it and learned afterwards. A key's rows of one micro-batch are taken together,
ordered by time and id; the source options bound how many that are.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from secflow.plans.behaviour import FULL_CONFIDENCE, MIN_EVENTS, MIN_SAMPLES, VOLUME_HISTORY
from secflow.plans.risk import CEILING, DECAY_PER_HOUR

#: How long the state of a key or value outlives its last use.
KEEP = "30 days"
DAY_MS = 86_400_000
NO_TIME = np.iinfo(np.int64).min


def milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows by time and id, those without a time last; ``micros`` is the time or NO_TIME."""
    frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
    return frame.assign(micros=frame["ts"].astype("datetime64[us]").astype("int64"))


class Keyed(StatefulProcessor):
    """A processor whose keys end after ``keep`` without rows."""

    def __init__(self, keep: str = KEEP) -> None:
        self.keep = milliseconds(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "at bigint", self.keep * 2)
        self.states = self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> list:
        raise NotImplementedError

    def used(self, now: int) -> None:
        """Move the key's timer; once in a tenth of its life is enough."""
        ends = self.ends.get()
        if ends is not None and ends[0] - now > self.keep * 0.9:
            return
        if ends is not None:
            self.handle.deleteTimer(ends[0])
        self.ends.update((now + self.keep,))
        self.handle.registerTimer(now + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for state in [*self.states, self.ends]:
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Rows (shift, low, high) of x -> clamp(x + shift, low, high): ``first``, then ``then``."""
    low, high = (np.clip(first[:, i] + then[:, 0], then[:, 1], then[:, 2]) for i in (1, 2))
    return np.stack([first[:, 0] + then[:, 0], low, high], axis=1)


def clamped_scan(start: float, moves: np.ndarray, low: np.ndarray, high: float) -> np.ndarray:
    """Scores after each row where a row turns s into clamp(s + move, low, high); pairs are composed in log n passes."""
    steps = np.stack([moves, low, np.full(len(moves), high)], axis=1)
    width = 1
    while width < len(steps):
        steps = np.concatenate([steps[:width], _compose(steps[:-width], steps[width:])])
        width *= 2
    return np.clip(start + steps[:, 0], steps[:, 1], steps[:, 2])


class Risk(Keyed):
    """Entity risk: it decays with time and grows with each event. A row without a time adds to the risk as it is."""

    OUT = "event_id bigint, entity string, previous double, score double"

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.risk = handle.getValueState("risk", "score double, last bigint", self.keep)
        return [self.risk]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        score, last = self.risk.get() or (0.0, NO_TIME)
        frame = ordered(rows)
        times = frame["micros"].to_numpy()
        known = np.maximum.accumulate(np.r_[last, times])
        hours = np.where((known[:-1] == NO_TIME) | (times == NO_TIME), 0.0, (known[1:] - known[:-1]) / 3.6e9)
        add = frame["increment"].to_numpy(float)
        after = clamped_scan(score, add - DECAY_PER_HOUR * hours, np.minimum(add, CEILING), CEILING)
        self.risk.update((float(after[-1]), int(known[-1])))
        self.used(timerValues.getCurrentProcessingTimeInMs())
        yield frame[["event_id"]].assign(entity=key[0], previous=np.r_[score, after[:-1]], score=after)


class VolumeWindow(Keyed):
    """``count`` matches of a key within ``seconds``; windows never share a match.

    The state holds at most count - 1 matches, all of them inside the window. A row that is older than the key's
    newest one by more than ``delay`` is put out as ``late`` and one without a time as ``untimed``, for the
    quarantine; neither counts.
    """

    OUT = "group string, event_id bigint, kind string, related string"

    def __init__(self, count: int, seconds: int, delay: str, keep: str = KEEP) -> None:
        super().__init__(keep)
        self.count, self.span, self.delay = count, seconds * 1_000_000, milliseconds(delay) * 1000

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.matches = handle.getListState("matches", "micros bigint, event bigint", self.keep)
        self.newest = handle.getValueState("newest", "micros bigint", self.keep)
        return [self.matches, self.newest]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(m) for m in self.matches.get()]
        newest = (self.newest.get() or (NO_TIME,))[0]
        out = []
        frame = ordered(rows)
        for micros, event in zip(frame["micros"].tolist(), frame["event_id"].tolist(), strict=True):
            if micros == NO_TIME or micros < newest - self.delay:
                out.append((key[0], event, "untimed" if micros == NO_TIME else "late", ""))
                continue
            newest = max(newest, micros)
            insort(held, (micros, event))
            while held[0][0] < micros - self.span:
                held.pop(0)
            if len(held) >= self.count:
                out.append((key[0], event, "hit", ",".join(str(e) for _, e in held if e != event)))
                held = []
        if held:
            self.matches.put(held)
        else:
            self.matches.clear()
        if newest != NO_TIME:
            self.newest.update((newest,))
        self.used(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["group", "event_id", "kind", "related"])


class Baseline(Keyed):
    """What is usual for a user or host: hours, known values and volumes; deviations of a row from what came before."""

    OUT = "event_id bigint, entity string, kind string, score double, confidence double"

    def open(self, handle: StatefulProcessorHandle) -> list:
        self.counts = handle.getValueState("counts", "n bigint, hours array<bigint>", self.keep)
        self.known = handle.getMapState("known", "value string", "used bigint", self.keep)
        self.volumes = handle.getListState("volumes", "volume double", self.keep)
        return [self.counts, self.known, self.volumes]

    def _fresh(self, values: pd.Series, now: int) -> np.ndarray:
        """Whether a row shows its value for the first time; one look for each distinct value of the batch."""
        first = values.notna() & ~values.duplicated()
        fresh = np.zeros(len(values), bool)
        for i in np.flatnonzero(first.to_numpy()):
            value = (values.iat[i],)
            seen = self.known.getValue(value)
            fresh[i] = seen is None
            if seen is None or now - seen[0] > self.keep // 10:
                self.known.updateValue(value, (now,))
        return fresh

    def _deviation(self, volumes: np.ndarray) -> np.ndarray:
        """z of each volume against the samples before it, at most VOLUME_HISTORY; nan where it is not defined."""
        rows = np.flatnonzero(~np.isnan(volumes))
        z = np.full(len(volumes), np.nan)
        if not len(rows):
            return z
        past = np.array([v[0] for v in self.volumes.get()], float)
        whole = np.r_[past, volumes[rows]]
        self.volumes.put([(float(v),) for v in whole[-VOLUME_HISTORY:]])
        # Running sums of the values less their mean, so that large values lose nothing.
        centre = whole.mean()
        moved = whole - centre
        sums, squares = (np.r_[0.0, np.cumsum(x)] for x in (moved, moved ** 2))
        at = np.arange(len(past), len(whole))
        start = np.maximum(0, at - VOLUME_HISTORY)
        n = at - start
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (sums[at] - sums[start]) / n
            var = (squares[at] - squares[start]) / n - mean ** 2
            std = np.sqrt(np.where(var > 1e-12 * np.maximum(1.0, squares[-1] / len(whole)), var, 0.0))
            z[rows] = np.where((n >= MIN_SAMPLES) & (std > 0), (moved[at] - mean) / std, np.nan)
        return z

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kind, entity = key
        now = timerValues.getCurrentProcessingTimeInMs()
        n, hours = self.counts.get() or (0, [0] * 24)
        frame = ordered(rows)
        prior = n + np.arange(len(frame))
        hour = frame["hour"].to_numpy(float)
        timed = ~np.isnan(hour)
        seen = np.zeros((len(frame) + 1, 24), np.int64)
        seen[0] = hours
        seen[1:][timed, hour[timed].astype(int)] = 1
        seen = seen.cumsum(0)
        in_hour = seen[np.flatnonzero(timed), hour[timed].astype(int)]
        unusual = np.zeros(len(frame), bool)
        unusual[timed] = in_hour < np.maximum(0.02 * prior[timed], 1)
        fresh = self._fresh(frame["value"], now)
        judged = prior >= MIN_EVENTS
        sure = np.minimum(prior / FULL_CONFIDENCE, 1.0)
        found = [("unknown_ip" if kind == "user" else "unknown_process", judged & fresh,
                  np.full(len(frame), 65.0 if kind == "user" else 55.0))]
        if kind == "user":
            found.append(("unusual_hour", judged & unusual, np.full(len(frame), 70.0)))
        else:
            z = self._deviation(frame["volume"].to_numpy(float))
            found.append(("unusual_volume", judged & (z >= 3), np.minimum(50.0 + 10.0 * (z - 3.0), 100.0)))
        self.counts.update((int(n + len(frame)), seen[-1].tolist()))
        self.used(now)
        ids = frame["event_id"].to_numpy()
        yield pd.concat([pd.DataFrame({"event_id": ids[hit], "entity": entity, "kind": name, "score": score[hit],
                                       "confidence": sure[hit]}) for name, hit, score in found], ignore_index=True)
