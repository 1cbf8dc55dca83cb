"""Headings that are known up to their sign, and boxes that are missing, resolved along a track."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kalman import Filter
from ..session import spread
from .matching import shared_areas


def apart(a: float, b: float) -> float:
    return abs((a - b + 180.0) % 360.0 - 180.0)


def signs(axes: list[float], left: float | None, right: float | None) -> list[int]:
    """For axes without a direction, 0 to keep or 1 to turn each by 180 degrees: the least sum of turns from the left anchor through all to the right one. Ties keep; without an anchor the first is kept."""
    if not axes:
        return []
    options = [(a, (a + 180.0) % 360.0) for a in axes]
    if left is not None:
        cost = [apart(left, o) for o in options[0]]
    else:
        cost = [0.0, 0.0 if right is not None else np.inf]
    back: list[list[int]] = []
    for before, now in zip(options, options[1:]):
        step = [[cost[i] + apart(before[i], now[j]) for i in (0, 1)] for j in (0, 1)]
        back.append([0 if s[0] <= s[1] else 1 for s in step])
        cost = [min(s) for s in step]
    if right is not None:
        cost = [c + apart(o, right) for c, o in zip(cost, options[-1])]
    state = 0 if cost[0] <= cost[1] else 1
    out = [state]
    for choice in reversed(back):
        state = choice[state]
        out.append(state)
    return out[::-1]


def resolve_signs(tracks: DataFrame) -> DataFrame:
    """tracks (tid, frame, heading, axis) with resolved: heading, or the axis turned so that it fits the track. A block of rows without a heading spans frames without a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        heading, axis = pdf["heading"].to_numpy(float), pdf["axis"].to_numpy(float)
        out, i, n = heading.copy(), 0, len(pdf)
        while i < n:
            if not np.isnan(heading[i]):
                i += 1
                continue
            j = i
            while j < n and np.isnan(heading[j]):
                j += 1
            known = [k for k in range(i, j) if not np.isnan(axis[k])]
            turned = signs([axis[k] for k in known], heading[i - 1] if i else None, heading[j] if j < n else None)
            for k, t in zip(known, turned):
                out[k] = (axis[k] + 180.0 * t) % 360.0
            i = j
        return pd.DataFrame({"tid": pdf["tid"], "frame": pdf["frame"], "resolved": out})

    return spread(tracks.select("tid", "frame", "heading", "axis"), "tid").groupBy("tid").applyInPandas(run, "tid bigint, frame bigint, resolved double")


def predicted_gaps(tracks: DataFrame, max_age: int) -> DataFrame:
    """tid, frame, cx, cy for the frames of gaps shorter than max_age: where a constant-velocity filter, fed with the track up to the gap, sees it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frames, at = pdf["frame"].to_numpy(), pdf[["cx", "cy"]].to_numpy(float)
        rows, f = [], Filter(at[0])
        for before, now, seen in zip(frames, frames[1:], at[1:]):
            guesses = [f.predict() for _ in range(int(now - before))] if now - before <= max_age else None
            if guesses is None:  # too long ago: begin anew
                f = Filter(seen)
                continue
            rows += [(int(before) + k + 1, *g) for k, g in enumerate(guesses[:-1])]
            f.update(seen)
        out = pd.DataFrame(rows, columns=["frame", "cx", "cy"]).astype({"frame": "int64", "cx": float, "cy": float})
        out.insert(0, "tid", pdf["tid"].iloc[0])
        return out

    return spread(tracks.select("tid", "frame", "cx", "cy"), "tid").groupBy("tid").applyInPandas(run, "tid bigint, frame bigint, cx double, cy double")


#: The four numberings of a box's corners.
_TURNS = (np.arange(4)[:, None] + np.arange(4)) % 4


def corners(box: np.ndarray) -> np.ndarray:
    """The corners of cx, cy, w, h, heading in turn, the first edge along w."""
    cx, cy, w, h, a = box.tolist()
    s, c = math.sin(math.radians(a)), -math.cos(math.radians(a))
    x, y, u, v = w / 2 * s, w / 2 * c, h / 2 * -c, h / 2 * s
    return np.array([(cx + (-x - u), cy + (-y - v)), (cx + (x - u), cy + (y - v)), (cx + (x + u), cy + (y + v)), (cx + (-x + u), cy + (-y + v))])


def between(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The box that share of the way along the chords of the corners, b's numbered as near to a's as can be: its centre, mean edges and first edge's direction."""
    p, q = corners(a), corners(b)
    turned = q[_TURNS]
    q = turned[int(((turned - p) ** 2).reshape(4, 8).sum(1).argmin())]
    c = (1 - share) * p + share * q
    along, side = (c[1] - c[0] + c[2] - c[3]) / 2, (c[2] - c[1] + c[3] - c[0]) / 2
    if np.hypot(*side) > np.hypot(*along):
        along, side = side, -along
    return np.array([*c.mean(0), np.hypot(*along), np.hypot(*side), np.degrees(np.arctan2(along[0], -along[1])) % 360.0])


def on_long_axis(axis: float, heading: float, most: float) -> float | None:
    """The direction along the axis next to the heading, if it is within `most` degrees."""
    way = axis % 360.0 if apart(axis, heading) <= 90.0 else (axis + 180.0) % 360.0
    return way if apart(way, heading) <= most else None


#: Why a gap is left open, and how one is filled.
TOO_LONG, RISKY, NO_OVERLAP, TURNED, OFF_AXIS, FILLED = "length", "risky", "overlap", "heading", "axis", "filled"
GAP = "tid bigint, before bigint, after bigint, action string, branch string, iou double, turn double, boxes array<struct<frame:bigint,cx:double,cy:double,w:double,h:double,heading:double>>"
_GAP_BOX = pa.struct([("frame", pa.int64()), *((c, pa.float64()) for c in ("cx", "cy", "w", "h", "heading"))])
_GAP_FIELDS = [pa.field(n, t) for n, t in (("tid", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("action", pa.string()), ("branch", pa.string()), ("iou", pa.float64()), ("turn", pa.float64()), ("boxes", pa.list_(_GAP_BOX)))]


def _gap(before: np.ndarray, after: np.ndarray, iou: list[float], headings: tuple[float, float, float], n: int, frame: int, limits: dict) -> tuple[str, str | None, float, float, list]:
    """action, branch, iou, turn and boxes of a gap of n frames after `frame` whose ends are sure. iou: of the box after it with the predicted one and with that before; headings: before, after, predicted."""
    branch = next((b for b, x in zip(("prediction", "previous"), iou) if x >= limits["iou"]), None)
    if branch is None:
        return NO_OVERLAP, None, max(iou), float("nan"), []
    a, b, toward = headings
    way = toward if branch == "prediction" else a
    turn = 0.0 if np.isnan(way) or np.isnan(b) else float(apart(way, b))
    best = iou[0] if branch == "prediction" else iou[1]
    if turn > limits["turn"]:
        return TURNED, branch, best, turn, []
    boxes = []
    for k in range(1, n + 1):
        share = k / (n + 1)
        box = between(before, after, share)
        if np.isnan(a) and np.isnan(b):
            heading = float("nan")
        elif np.isnan(a) or np.isnan(b):
            heading = b if np.isnan(a) else a
        else:
            heading = (a + share * ((b - a + 180.0) % 360.0 - 180.0)) % 360.0
        if not np.isnan(heading):
            heading = on_long_axis(box[4], heading, limits["axis"])
            if heading is None:
                return OFF_AXIS, branch, best, turn, []
        boxes.append((frame + k, *box[:4].tolist(), None if np.isnan(heading) else float(heading)))
    return FILLED, branch, best, turn, boxes


def shared_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the union of each of a with that of b in its row (rows of cx, cy, w, h, heading)."""
    both = shared_areas(a, b)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def gaps_of(frames: np.ndarray, box: np.ndarray, heading: np.ndarray, risky: np.ndarray, limits: dict) -> list[tuple]:
    """before, after, action, branch, iou, turn, boxes of the gaps of one track, by frame.

    The filters run along the track first; the boxes that they predict, and those
    before the gaps, are then compared with those behind all at once.
    """
    axes, known = box[:, 4].tolist(), heading.tolist()
    # the side of its axis that each heading is on, as a vector
    ways = [math.radians(a if math.isnan(h) else on_long_axis(a, h, 90.0)) for a, h in zip(axes, known)]
    ways = [(math.sin(a), -math.cos(a)) for a in ways]
    places, sizes, steps = box[:, :2].tolist(), box[:, 2:4].tolist(), np.diff(frames).tolist()
    place, shape, turn = Filter(places[0]), Filter(sizes[0]), Filter(ways[0], noise=0.005, drift=(0.005, 0.005, 0.02, 0.02))
    asked, guesses, toward = [], [], []
    for k, n in enumerate(steps, 1):
        for _ in range(n):
            at, size, way = place.predict(), shape.predict(), turn.predict()
        if 1 < n <= limits["age"] and not risky[k] and not risky[k - 1]:
            asked.append(k)
            guesses.append((*at, max(size[0], 1.0), max(size[1], 1.0), axes[k - 1]))
            toward.append(math.degrees(math.atan2(way[0], -way[1])) % 360.0)
        place.update(places[k])
        shape.update(sizes[k])
        turn.update(ways[k])
    rows = {k + 1: (TOO_LONG if n > limits["age"] else RISKY, None, float("nan"), float("nan"), []) for k, n in enumerate(steps) if n > 1}
    if asked:
        iou = shared_parts(np.tile(box[asked], (2, 1)), np.concatenate([guesses, box[np.array(asked) - 1]])).reshape(2, -1).T.tolist()
        for k, shares, way in zip(asked, iou, toward):
            rows[k] = _gap(box[k - 1], box[k], shares, (known[k - 1], known[k], way), steps[k - 1] - 1, int(frames[k - 1]), limits)
    return [(int(frames[k - 1]), int(frames[k]), *found) for k, found in rows.items()]


def gap_fills(tracks: DataFrame, max_age: int = 10, strong_iou: float = 0.5, strong_turn: float = 45.0, axis_error: float = 45.0) -> DataFrame:
    """tid, before, after, action, branch, iou, turn, boxes for each gap of a track (GAP). tracks: tid, frame, cx, cy, w, h, axis (the direction of w), heading (null: not known) and risky.

    Filters of constant velocity follow a track's place, shape and heading. A gap
    is filled along the chord between its ends if it is shorter than max_age,
    neither end is risky, the box behind it overlaps the predicted one or else the
    one before it strongly enough, the heading there fits, and no heading on the way
    is farther than axis_error from its box's axis; else action tells the first
    of these that fails. A track is one group; rows without a box are left out.
    """
    limits = {"age": max_age, "iou": strong_iou, "turn": strong_turn, "axis": axis_error}

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        frames, first = np.unique(columns["frame"], return_index=True)
        box = np.stack([columns[c][first] for c in ("cx", "cy", "w", "h", "axis")], 1)
        rows = gaps_of(frames, box, columns["heading"][first].astype(float), columns["risky"][first].astype(bool), limits)
        values = [[columns["tid"][0]] * len(rows), *(zip(*rows) if rows else [()] * (len(_GAP_FIELDS) - 1))]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, _GAP_FIELDS)], pa.schema(_GAP_FIELDS))

    good = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("cx", "cy", "w", "h", "axis")) + " AND w > 0 AND h > 0 AND tid IS NOT NULL AND frame IS NOT NULL"
    rows = tracks.select(F.col("tid").cast("long").alias("tid"), F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h", "axis", "heading")], F.coalesce("risky", F.lit(False)).alias("risky")).where(good)
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return spread(rows, "tid").groupBy("tid").applyInArrow(run, GAP).select("tid", "before", "after", "action", "branch", nan("iou"), nan("turn"), "boxes")


def repaired(frames: np.ndarray, headings: np.ndarray, least: int, split: float = 60.0, boundary: float = 120.0) -> np.ndarray:
    """headings of one track, short runs turned round where that joins them to a long one.

    Runs are consecutive frames whose headings differ by at most split; those
    of `least` frames or more are anchors and stay. A short run is judged by
    the anchors right next to it from which it differs by boundary or more:
    it turns if the squares of the angles there grow smaller. The run with the
    largest gain goes first (the earliest on a tie), then runs are made anew,
    until none turns; each turn joins two runs, so it ends.
    """
    h = np.asarray(headings, float) % 360.0
    while True:
        far = np.abs((h[1:] - h[:-1] + 180.0) % 360.0 - 180.0)
        near = np.diff(frames) == 1
        first = np.concatenate(([0], np.flatnonzero(~near | (far > split)) + 1)).astype(int)
        last = np.concatenate((first[1:], [len(h)])) - 1
        anchor = frames[last] - frames[first] + 1 >= least if len(h) else np.zeros(0, bool)
        best, at = 0.0, -1
        for r in np.flatnonzero(~anchor):
            ends = [(r - 1, first[r] - 1), (r + 1, last[r])]
            angles = [far[k] for other, k in ends if 0 <= other < len(first) and anchor[other] and near[k] and far[k] >= boundary]
            gain = sum(x * x - (180.0 - x) ** 2 for x in angles)
            if gain > best:
                best, at = gain, r
        if at < 0:
            return h
        h[first[at] : last[at] + 1] = (h[first[at] : last[at] + 1] + 180.0) % 360.0


def repair_flips(tracks: DataFrame, least: int = 5) -> DataFrame:
    """tid, frame, heading, turned. Rows without a heading stay out. A track is one group, as each repair depends on the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        was = pdf["heading"].to_numpy(float) % 360.0
        now = repaired(pdf["frame"].to_numpy(), was, least)
        return pdf[["tid", "frame"]].assign(heading=now, turned=now != was)

    rows = tracks.select("tid", "frame", "heading").where("heading IS NOT NULL AND NOT isnan(heading)")
    return spread(rows, "tid").groupBy("tid").applyInPandas(run, "tid bigint, frame bigint, heading double, turned boolean")
