"""Trackers, windows and links over streams: rows come once, and late by a bounded number of frames.

The state of a key is a machine that takes frames in order; what it gives is final.
Rows that could still change are held back, and come when later frames have made
them final or, if no more arrive, when the watermark passes the key's last row by
`idle`. Micro-batches of any size give the same rows, as long as a frame's rows
of one key come together and frames in order; rows of a frame that was followed
already are left out. A restart from the checkpoint goes on where the last batch
ended. The input has a time column `ts` with a watermark.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from . import staged

EDGES = "video string, frame bigint, parent bigint, child bigint, overlap double"
STILL = "key string, frame bigint"
#: Frames that are compared as plain numbers.
_FEW = 32


class Follower(StatefulProcessor):
    """A machine for each key. machine: step(frame, rows), final() and rest(), the last two giving lists of rows without the key.

    One that holds back nothing (`prompt`) needs no timer; one with steps(rows) takes all rows of a call.
    """

    def __init__(self, make: Callable[[], object], columns: list[str], idle: timedelta):
        self.make, self.columns, self.idle = make, columns, int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("machine", "held binary")

    def _table(self, key: tuple, rows: list) -> pd.DataFrame:
        if not rows:
            return pd.DataFrame(columns=self.columns)
        return pd.DataFrame(dict(zip(self.columns, ([key[0]] * len(rows), *zip(*rows)))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        held = self.held.get()
        machine = pickle.loads(held[0]) if held else self.make()
        if hasattr(machine, "steps"):
            machine.steps(pdf)
        else:
            for frame, own in pdf.sort_values("frame", kind="stable").groupby("frame", sort=True):
                machine.step(int(frame), own)
        final = machine.final()
        self.held.update((pickle.dumps(machine),))
        if not getattr(machine, "prompt", False):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(pdf["ts"].max().timestamp() * 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle)
        if final:
            yield self._table(key, final)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key has been silent: what it holds is final."""
        if self.held.exists():
            machine = pickle.loads(self.held.get()[0])
            rest = machine.rest()
            self.held.update((pickle.dumps(machine),))
            yield self._table(key, rest)

    def close(self) -> None:
        pass


class Begins:
    """A frame with `count` detections of score `least` or more."""

    def __init__(self, count: int, least: float):
        self.count, self.least = count, least

    def __call__(self, rows: pd.DataFrame) -> bool:
        return len(rows) >= self.count and rows["score"].iloc[self.count - 1] >= self.least


class Tracking:
    """Frames for a tracker of staged; frames that lack are steps without detections. first: the frame that may begin, none: any."""

    def __init__(self, tracker, first: Begins | None = None):
        self.tracker, self.first, self.last = tracker, first, None

    def step(self, frame: int, rows: pd.DataFrame) -> None:
        if self.last is not None and frame <= self.last:
            return
        rows = rows.sort_values(["score", "det"], ascending=[False, True])
        if self.last is None:
            if self.first and not self.first(rows):
                return
        else:
            none = np.zeros((0, len(staged.VALUES))), np.zeros(0), np.zeros(0)
            for f in range(self.last + 1, frame):
                self.tracker.step(f, *none)
        self.tracker.step(frame, rows[staged.VALUES].to_numpy(float), rows["score"].to_numpy(float), rows["det"].to_numpy())
        self.last = frame

    def final(self) -> list:
        return [] if self.last is None else _plain(self.tracker.release(self.last - self.tracker.memory))

    def rest(self) -> list:
        return _plain(self.tracker.release(None))


def _plain(rows: list[list]) -> list[list]:
    return [[*map(int, r[:4]), *map(float, r[4:])] for r in rows]


class Still:
    """Rows of one track in windows in which it hardly moves, as static_windows() has them: the last `window` frames are held, and a row comes as soon as a window takes it."""

    prompt = True

    def __init__(self, window: int, presence: float, iou: float, displacement: float):
        self.window, self.iou, self.displacement = window, iou, displacement
        self.need = int(np.ceil(presence * window))
        self.seen: list[tuple] = []
        self.given: set[int] = set()
        self.began, self.out = None, []

    def steps(self, rows: pd.DataFrame) -> None:
        """Of several rows of a frame the first counts."""
        order = np.argsort(rows["frame"].to_numpy(), kind="stable")
        for frame, *box in zip(*(rows[c].to_numpy(kind)[order].tolist() for c, kind in (("frame", np.int64), *((c, float) for c in staged.VALUES[:4])))):
            self._step(frame, tuple(box))

    def step(self, frame: int, rows: pd.DataFrame) -> None:
        self._step(frame, tuple(rows[staged.VALUES[:4]].iloc[0].astype(float).tolist()))

    def _step(self, frame: int, box: tuple) -> None:
        if self.seen and frame <= self.seen[-1][0]:
            return
        if not self.seen or frame - self.seen[-1][0] > max(1, self.window - self.need + 1):
            self.seen, self.given, self.began = [], set(), frame
        self.seen.append((frame, box))
        self.seen = [x for x in self.seen if x[0] > frame - self.window]
        self.given = {f for f in self.given if f > frame - self.window}
        if frame - self.began < self.window - 1 or len(self.seen) < self.need:
            return
        held = [x for _, x in self.seen]
        still = self._few if len(held) <= _FEW and all(math.isfinite(v) for x in held for v in x) else self._many
        if still(held):
            new = [f for f, _ in self.seen if f not in self.given]
            self.given |= set(new)
            self.out += [[f] for f in new]

    def _many(self, held: list[tuple]) -> bool:
        b = np.array(held)
        mid = b[len(b) // 2]
        side = lambda c, s: np.maximum(np.minimum(b[:, c] + b[:, s] / 2, mid[c] + mid[s] / 2) - np.maximum(b[:, c] - b[:, s] / 2, mid[c] - mid[s] / 2), 0.0)
        both = side(0, 2) * side(1, 3)
        union = b[:, 2] * b[:, 3] + mid[2] * mid[3] - both
        shared = np.divide(both, union, out=np.zeros_like(both), where=union != 0)
        return bool(np.hypot(*np.ptp(b[:, :2], axis=0)) <= self.displacement * np.median(b[:, 2:4].max(1)) and np.median(shared) >= self.iou)

    def _few(self, held: list[tuple]) -> bool:
        """The same on plain numbers, which for a short window cost less than arrays."""
        xs, ys = [x[0] for x in held], [x[1] for x in held]
        if not np.hypot(max(xs) - min(xs), max(ys) - min(ys)) <= self.displacement * _median([max(x[2], x[3]) for x in held]):
            return False
        mx, my, mw, mh = held[len(held) // 2]
        shared = []
        for x, y, w, h in held:
            both = max(min(x + w / 2, mx + mw / 2) - max(x - w / 2, mx - mw / 2), 0.0) * max(min(y + h / 2, my + mh / 2) - max(y - h / 2, my - mh / 2), 0.0)
            union = w * h + mw * mh - both
            shared.append(both / union if union else 0.0)
        return _median(shared) >= self.iou

    def final(self) -> list:
        out, self.out = self.out, []
        return out

    rest = final


def _median(values: list[float]) -> float:
    values, n = sorted(values), len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


class Links:
    """Overlaps of a frame's boxes with those of the frame before, the only one that is held."""

    prompt = True

    def __init__(self):
        self.last, self.ids, self.box, self.out = None, np.zeros(0, np.int64), np.zeros((0, 4)), []

    def step(self, frame: int, rows: pd.DataFrame) -> None:
        if self.last is not None and frame <= self.last:
            return
        ids, box = rows["det"].to_numpy(), rows[staged.VALUES[:4]].to_numpy(float)
        if self.last == frame - 1 and len(ids) and len(self.ids):
            a, b = self.box[:, None], box[None]
            side = lambda c: np.minimum(a[..., c] + a[..., c + 2] / 2, b[..., c] + b[..., c + 2] / 2) - np.maximum(a[..., c] - a[..., c + 2] / 2, b[..., c] - b[..., c + 2] / 2)
            meet = lambda c: np.abs(a[..., c] - b[..., c]) < (a[..., c + 2] + b[..., c + 2]) / 2  # noqa: E731  (as temporal_edges() asks: by their sides boxes that only touch could seem to meet)
            shared = np.maximum(side(0), 0.0) * np.maximum(side(1), 0.0)
            for i, j in zip(*np.nonzero(meet(0) & meet(1))):
                self.out.append([frame - 1, int(self.ids[i]), int(ids[j]), float(shared[i, j])])
        self.last, self.ids, self.box = frame, ids, box

    def final(self) -> list:
        out, self.out = self.out, []
        return out

    rest = final


def _run(rows: DataFrame, key: str, make: Callable[[], object], schema: str, idle: timedelta) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the state of such keys needs it
    columns = [part.split()[0] for part in schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(Follower(make, columns, idle), schema, "append", "EventTime")


def population_stream(det: DataFrame, count: int, limits: staged.Limits | None = None, least: float = 0.5, idle: timedelta = timedelta(minutes=1)) -> DataFrame:
    """staged.SCHEMA for a known number of animals, followed forwards from the first frame with `count` detections of score `least`. det: video, frame, det, score, VALUES, ts."""
    limits = limits or staged.Limits()
    return _run(det.select("video", "frame", "det", "score", *staged.VALUES, "ts"), "video", lambda: Tracking(staged.Population(count, limits), Begins(count, least)), staged.SCHEMA, idle)


def variable_stream(det: DataFrame, policy: staged.Policy, idle: timedelta = timedelta(minutes=1)) -> DataFrame:
    """staged.SCHEMA for any number of animals, as track_variable() has them."""
    return _run(det.select("video", "frame", "det", "score", *staged.VALUES, "ts"), "video", lambda: Tracking(staged.Changing(policy)), staged.SCHEMA, idle)


def static_stream(tracks: DataFrame, window: int, presence: float = 0.98, iou: float = 0.8, displacement: float = 0.2, idle: timedelta = timedelta(minutes=1)) -> DataFrame:
    """key, frame, as static_windows() has them. tracks: key (a track's name), frame, VALUES, ts."""
    return _run(tracks.select("key", "frame", *staged.VALUES[:4], "ts"), "key", lambda: Still(window, presence, iou, displacement), STILL, idle)


def links_stream(det: DataFrame, idle: timedelta = timedelta(minutes=1)) -> DataFrame:
    """video, frame, parent, child, overlap, as temporal_edges() has them. det: video, frame, det, VALUES, ts."""
    return _run(det.select("video", "frame", "det", *staged.VALUES[:4], "ts"), "video", Links, EDGES, idle)
