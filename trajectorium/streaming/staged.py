"""Tracking in stages that loosen: overlap with heading, overlap with axis, distance by speed, distance after a long gap.

A video is one group, as its frames depend on each other; videos are spread
over tasks. A group holds one video's detections and tracks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kalman import Filter
from ..operators.matching import min_cost, shared_areas
from ..session import spread

VALUES = ["cx", "cy", "w", "h", "heading"]
SCHEMA = "video string, frame bigint, tid bigint, det bigint, stage int, " + ", ".join(f"{v} double" for v in VALUES)
#: How sure the heading filter is of a measurement and of its own state.
TURN_NOISE, TURN_DRIFT = 0.005, (0.005, 0.005, 0.02, 0.02)
#: The widest angle between a direction and the axis it is put on; radius of the distance stage in box sizes and in speeds.
AXIS_LIMIT, SIZES, SPEEDS = 67.5, 2.0, 1.5
_AXIS_COS = math.cos(math.radians(AXIS_LIMIT))
#: Stages 1 to 4 as (needs strong overlap, needs a near heading).
OVERLAP_STAGES = [(True, True), (True, False), (False, True), (False, False)]
BY_SPEED, AFTER_GAP, FILLED = 5, 6, 7
#: Stages whose boxes a risky match may be measured against.
TRUSTED = frozenset({0, 1, 2, 3, 4})
#: Why a row was taken back.
BEFORE_MISS, EXCURSION = "before_miss", "excursion"


@dataclass
class Limits:
    """nms_iou: two tracks may not overlap by more; max_age: frames until a track sleeps; strong_*: gates of the first stages; turn_run: frames after which a reversed heading is believed; dt: -1 for a backward pass."""

    nms_iou: float = 0.8
    max_age: int = 10
    strong_iou: float = 0.5
    strong_turn: float = 45.0
    turn_run: int = 3
    dt: float = 1.0


def apart(a, b):
    return np.abs((np.asarray(a) - b + 180.0) % 360.0 - 180.0)


def far_apart(a: float, b: float) -> float:
    """apart() of two numbers."""
    return abs((a - b + 180.0) % 360.0 - 180.0)


def unit(a: float) -> tuple[float, float]:
    return math.sin(math.radians(a)), -math.cos(math.radians(a))


def along(axis: float, v: Sequence[float]) -> float:
    x, y = unit(axis)
    return x * v[0] + y * v[1]


def on_axis(axis: float, v: Sequence[float]) -> float:
    """The direction along the axis next to v."""
    return axis % 360.0 if along(axis, v) >= 0 else (axis + 180.0) % 360.0


def fits_axis(axis: float, v: Sequence[float]) -> bool:
    length = math.hypot(v[0], v[1])
    return length > 1e-6 and abs(along(axis, v)) / length >= _AXIS_COS


def overlaps(a: np.ndarray, b: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """Share of the union for each of a with each of b (rows of VALUES), 0 for pairs that aren't asked for."""
    out = np.zeros((len(a), len(b)))
    reach = np.hypot(a[:, 2], a[:, 3])[:, None] / 2 + np.hypot(b[:, 2], b[:, 3])[None, :] / 2
    near = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) < reach
    i, j = np.nonzero(near if only is None else near & only)
    if len(i):
        both = shared_areas(a[i], b[j])
        union = a[i, 2] * a[i, 3] + b[j, 2] * b[j, 3] - both
        out[i, j] = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    return out


Measure = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def measured(references: list[tuple[np.ndarray, np.ndarray]], miss: np.ndarray, det: np.ndarray, limits: Limits) -> list[Measure]:
    """Of each reference with each detection, as matrices: overlap, angle of the headings (nan: none), and what a match costs by heading and by axis; a reference that overlaps nothing is left out."""
    n, out = len(miss), []
    shares = overlaps(np.concatenate([boxes for boxes, _ in references]), det)
    age = np.minimum(miss / max(limits.max_age, 1), 1.0)[:, None]
    for k, (boxes, headings) in enumerate(references):
        iou = shares[k * n : (k + 1) * n]
        if not iou.any():
            continue
        turn, axis = apart(headings[:, None], det[:, 4]), apart(boxes[:, 4][:, None], det[:, 4])
        base = ((1 - iou) / max(1 - limits.strong_iou, 1e-6)) ** 2 + age
        by_turn, by_axis = (base + (a / max(limits.strong_turn, 1.0)) ** 2 for a in (np.nan_to_num(turn), np.minimum(axis, 180.0 - axis)))
        out.append((iou, turn, by_turn, by_axis))
    return out


def matched(measures: list[Measure], rows: list[int], cols: list[int], strong: bool, directed: bool, limits: Limits) -> list[tuple[int, int]]:
    """Pairs of those rows (tracks) and columns (detections) of the measures; later references serve what is left."""
    pairs: list[tuple[int, int]] = []
    for iou, turn, by_turn, by_axis in measures:
        if not rows or not cols:
            break
        valid = iou >= limits.strong_iou if strong else iou > 1e-9
        if directed:
            valid &= np.isnan(turn) | (turn <= limits.strong_turn)
        if not valid.any():
            continue
        at = np.ix_(rows, cols)
        valid = valid[at]
        if not valid.any():
            continue
        found = [(rows[i], cols[j]) for i, j in min_cost((by_turn if directed else by_axis)[at], valid)]
        pairs += found
        rows, cols = ([x for x in of if x not in {p[k] for p in found}] for k, of in enumerate((rows, cols)))
    return pairs


def by_overlap(references: list[tuple[np.ndarray, np.ndarray]], miss: np.ndarray, det: np.ndarray, strong: bool, directed: bool, limits: Limits) -> list[tuple[int, int]]:
    """Pairs (track, detection). references: boxes and headings (nan: none) of the tracks, predicted ones first; later ones serve the tracks and detections that are left."""
    return matched(measured(references, miss, det, limits), list(range(len(miss))), list(range(len(det))), strong, directed, limits)


def by_distance(boxes: np.ndarray, miss: np.ndarray, det: np.ndarray, max_age: int, speed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of least distance in box sizes; with speed, within a radius that grows with it and with each miss."""
    if not len(boxes) or not len(det):
        return []
    far = np.hypot(boxes[:, None, 0] - det[None, :, 0], boxes[:, None, 1] - det[None, :, 1])
    size = np.sqrt(np.maximum(boxes[:, 2] * boxes[:, 3], 1.0))[:, None]
    valid = np.ones_like(far, bool) if speed is None else far <= SIZES * size * (1 + miss[:, None]) + SPEEDS * speed[:, None]
    return min_cost(far / size + np.minimum(miss / max(max_age, 1), 1.0)[:, None], valid)


@dataclass
class Risk:
    """A match by distance that may be taken back: its step, frame and box, the box before it, and the track as predicted for its frame."""

    step: int
    frame: int
    box: np.ndarray
    anchor: np.ndarray
    trusted: bool
    state: dict


@dataclass
class Track:
    """One animal: its filters, last box, last heading, and the rows written so far."""

    tid: int
    seen: np.ndarray
    limits: Limits
    heading: float = float("nan")
    miss: int = 0
    hits: int = 1
    firm: bool = True
    last: int = 0
    rows: list = field(default_factory=list)
    steps: list = field(default_factory=list)
    reversed_: list = field(default_factory=list)
    risk: Risk | None = None
    erased: list = field(default_factory=list)

    def __post_init__(self):
        self.begin(self.seen)

    def begin(self, box: np.ndarray) -> None:
        dt = self.limits.dt
        self.place, self.shape = Filter(box[:2], dt=dt), Filter(box[2:4], dt=dt)
        self.turn_to(box[4])

    def turn_to(self, heading: float) -> None:
        self.turn, self.heading = Filter(unit(heading), noise=TURN_NOISE, drift=TURN_DRIFT, dt=self.limits.dt), heading % 360.0

    def predict(self) -> None:
        at, size, v = self.place.predict(), self.shape.predict(), self.turn.predict()
        axis = float(self.seen[4])
        self.guess_heading = on_axis(axis, v) if fits_axis(axis, v) else self.heading
        self.guess = np.array([*at, max(size[0], 1e-3), max(size[1], 1e-3), self.guess_heading])

    @property
    def speed(self) -> float:
        return math.hypot(*self.place.x[2:])

    def note(self, frame: int, det: int, stage: int, box: np.ndarray, heading: float) -> None:
        self.rows.append([frame, self.tid, det, stage, *box[:4], heading])

    def take(self, frame: int, det: int, stage: int, box: np.ndarray) -> None:
        """The frame's box is this one. Stages by axis leave the heading open unless a turn has lasted; those by distance freeze it, and a long gap begins the filters anew."""
        heading, axis = float("nan"), float(box[4])
        if stage == AFTER_GAP:
            old = self.heading
            self.begin(box)
            self.heading = old
        else:
            self.place.update(box[:2])
            self.shape.update(box[2:4])
        if stage in (1, 3):
            self.reversed_ = []
            v = self.turn.update(unit(axis))
            heading = self.heading = on_axis(axis, v) if fits_axis(axis, v) else axis % 360.0
        elif stage in (2, 4):
            back = far_apart(axis, self.heading) > self.limits.strong_turn
            same = self.reversed_ and far_apart(self.reversed_[-1][1], axis) <= self.limits.strong_turn
            self.reversed_ = [*(self.reversed_ if same else []), (len(self.rows), axis % 360.0)] if back else []
            if len(self.reversed_) >= max(self.limits.turn_run, 2):
                for k, a in self.reversed_[:-1]:
                    self.rows[k][-1] = a
                heading = axis % 360.0
                self.turn_to(heading)
                self.reversed_ = []
            else:
                self.turn.update(unit(on_axis(axis, self.turn.x[:2])))
        else:
            self.reversed_ = []
        self.note(frame, det, stage, box, heading)
        self.seen, self.miss, self.last, self.hits = box, 0, frame, self.hits + 1
        if stage in (1, 3):
            self.mend_flip()

    def release(self, frame: int | None) -> list[list]:
        """Takes out the rows up to that frame (none: all)."""
        gone = [frame is None or r[0] <= frame for r in self.rows]
        out = [r for r, g in zip(self.rows, gone) if g]
        kept = np.cumsum(~np.array(gone, bool)) - 1
        self.rows = [r for r, g in zip(self.rows, gone) if not g]
        self.reversed_ = [(int(kept[k]), a) for k, a in self.reversed_ if k < len(gone) and not gone[k]]
        return out

    def erase(self, frame: int, why: str) -> None:
        """The row of that frame counts no more."""
        for k in range(len(self.rows) - 1, -1, -1):
            if self.rows[k][0] == frame:
                r = self.rows.pop(k)
                self.erased.append([*r[:4], why])
                # the run of reversed headings names rows by place
                self.reversed_ = [(i - (i > k), a) for i, a in self.reversed_ if i != k]
                return

    def weigh(self, step: int, frame: int, stage: int, box: np.ndarray, max_age: int) -> None:
        """Before a box is taken: of two risky matches within max_age, the first goes if the second is nearer to the box before it; a risky match is remembered with the track as it is now."""
        if stage not in (BY_SPEED, AFTER_GAP):
            self.risk = None
            return
        anchor, old = self.seen, self.risk
        if old is not None and step - old.step - 1 <= max_age and math.dist(box[:2], old.anchor[:2]) < math.dist(old.box[:2], old.anchor[:2]):
            self.erase(old.frame, EXCURSION)
            anchor = old.anchor
        held = next((r[3] for r in reversed(self.rows) if r[0] == self.last), None)
        state = {k: getattr(self, k).copy() for k in ("place", "shape", "turn")} | {k: getattr(self, k) for k in ("heading", "seen", "miss", "last")}
        self.risk = Risk(step, frame, box, anchor, held in TRUSTED, state)

    def missed(self, step: int) -> None:
        """No box. A risky match in the frame just before, from a trusted box, is taken back: it counts as missed and the track goes on as predicted from that box."""
        old = self.risk
        if old is not None and old.step == step - 1 and old.trusted:
            self.erase(old.frame, BEFORE_MISS)
            vars(self).update(old.state)
            self.seen = old.anchor
            self.predict()
            self.miss += 1
            self.steps[-1] = self.guess
            self.risk = None
        self.miss += 1
        self.reversed_ = []

    def mend_flip(self) -> None:
        """Of three neighbouring frames, the middle heading is turned round if it is far from both others and the other way is nearer."""
        if len(self.rows) < 3:
            return
        (f0, *_, a), (f1, *_, b), (f2, *_, c) = self.rows[-3:]
        if abs(f2 - f0) != 2 or math.isnan(a + b + c) or far_apart(a, b) <= self.limits.strong_turn or far_apart(b, c) <= self.limits.strong_turn:
            return
        other = (b + 180.0) % 360.0
        if far_apart(a, other) + far_apart(other, c) < far_apart(a, b) + far_apart(b, c):
            self.rows[-2][-1] = other
            self.turn_to(c)


def claims(tracks: list[Track], det: np.ndarray, free: set[int], limits: Limits, steps: int | None = None) -> dict[int, tuple[int, int]]:
    """Position in tracks -> (detection, stage); free loses what is claimed. steps: boxes so many steps back serve the tracks that sleep (none: they are left out)."""
    found: dict[int, tuple[int, int]] = {}

    def keep(pairs, rows, cols, stage):
        for i, j in pairs:
            found[rows[i]] = (cols[j], stage)
            free.discard(cols[j])

    def left(active: bool) -> tuple[list[int], list[int]]:
        return [k for k, t in enumerate(tracks) if k not in found and (t.miss < limits.max_age) == active], sorted(free)

    table = lambda rows, of: np.array([of(tracks[k]) for k in rows], float).reshape(len(rows), -1)
    rows, cols = left(True)
    if rows and cols:
        # boxes are measured once for all stages, which differ in what they allow
        references = [(table(rows, lambda t: t.guess), table(rows, lambda t: t.guess_heading)[:, 0]), (table(rows, lambda t: t.seen), table(rows, lambda t: t.heading)[:, 0])]
        measures = measured(references, table(rows, lambda t: t.miss)[:, 0], det[cols], limits)
        for stage, (strong, directed) in enumerate(OVERLAP_STAGES, 1):
            if measures:
                keep(matched(measures, [i for i, k in enumerate(rows) if k not in found], [j for j, c in enumerate(cols) if c in free], strong, directed, limits), rows, cols, stage)
    rows, cols = left(True)
    if steps is None:
        rows = [k for k in rows if tracks[k].miss == 0]
    if rows and cols:
        keep(by_distance(table(rows, lambda t: t.guess), table(rows, lambda t: t.miss)[:, 0], det[cols], limits.max_age, table(rows, lambda t: t.speed)[:, 0]), rows, cols, BY_SPEED)
    rows, cols = left(False)
    if steps is not None and rows and cols:
        keep(by_distance(table(rows, lambda t: t.steps[-steps] if len(t.steps) >= steps else t.seen), table(rows, lambda t: t.miss)[:, 0], det[cols], limits.max_age), rows, cols, AFTER_GAP)
    return found


def part_duplicates(found: dict[int, tuple[int, int]], det: np.ndarray, score: np.ndarray, limits: Limits, free: set[int]) -> None:
    """Of two tracks on boxes that overlap by more than nms_iou, the one of the later stage, then of the lower score, then of the later place loses its box."""
    rows = sorted(found)
    if not 0 < limits.nms_iou < 1 or len(rows) < 2:
        return
    boxes = det[[found[k][0] for k in rows]]
    iou = overlaps(boxes, boxes, np.tri(len(rows), k=-1, dtype=bool).T)
    if not (iou > limits.nms_iou).any():
        return
    rank = lambda k: (found[k][1], -score[found[k][0]])
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a in found and b in found and iou[i, j] > limits.nms_iou:
                loser = b if rank(b) >= rank(a) else a
                free.add(found.pop(loser)[0])


def fill_gap(track: Track, box: np.ndarray, frame: int, past: dict[int, list], limits: Limits) -> None:
    """Rows for the frames that the track has missed: the unclaimed box next to the straight line, if it is near and overlaps no claimed one by more than nms_iou."""
    n = abs(frame - track.last)
    start, way = track.seen[:2], (box[:2] - track.seen[:2]) / n
    side = np.sqrt(max(track.seen[2] * track.seen[3], 1.0))
    step = 1 if frame > track.last else -1
    for k in range(1, n):
        held = past.get(track.last + k * step)
        if held is None or not held[2]:
            continue
        det, ids, free, taken = held
        cols = sorted(free)
        far = np.hypot(*(det[cols, :2] - (start + way * k)).T)
        j = cols[int(np.argmin(far))]
        if far.min() > max(SIZES * side, SPEEDS * float(np.hypot(*way))):
            continue
        if taken and overlaps(det[[j]], det[sorted(taken)]).max() > limits.nms_iou:
            continue
        free.discard(j)
        taken.add(j)
        track.note(track.last + k * step, int(ids[j]), FILLED, det[j], float("nan"))


def frames_of(pdf: pd.DataFrame, order: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """frame, boxes, scores, ids in that order; frames without detections too."""
    pdf = pdf.sort_values(["frame", "score", "det"], ascending=[True, False, True])
    frames, boxes, scores, ids = pdf["frame"].to_numpy(), pdf[VALUES].to_numpy(float), pdf["score"].to_numpy(float), pdf["det"].to_numpy()
    for f, a, b in zip(order, *(np.searchsorted(frames, order, side).tolist() for side in ("left", "right"))):
        yield f, boxes[a:b], scores[a:b], ids[a:b]


class Population:
    """A known number of animals, followed frame by frame from the best boxes of the first frame."""

    def __init__(self, count: int, limits: Limits):
        self.count, self.limits = count, limits
        self.tracks: list[Track] = []
        self.past: dict[int, list] = {}
        self.steps = 0

    def step(self, frame: int, det: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """det, score and ids by falling score; frames without detections are steps too."""
        limits, tracks, past = self.limits, self.tracks, self.past
        step, self.steps = self.steps, self.steps + 1
        if not tracks:
            for k in range(min(self.count, len(det))):
                t = Track(k, det[k], limits, last=frame)
                t.note(frame, int(ids[k]), 0, det[k], det[k][4] % 360.0)
                t.steps.append(det[k])
                tracks.append(t)
            past[frame] = [det, ids, set(range(len(tracks), len(det))), set(range(len(tracks)))]
            return
        for t in tracks:
            t.predict()
        free = set(range(len(det)))
        found = claims(tracks, det, free, limits, steps=limits.max_age)
        part_duplicates(found, det, score, limits, free)
        past[frame] = [det, ids, free, {j for j, _ in found.values()}]
        past.pop(frame - int(np.sign(limits.dt)) * self.memory, None)
        for k, t in enumerate(tracks):
            if k in found:
                j, stage = found[k]
                if t.miss and stage != BY_SPEED:
                    fill_gap(t, det[j], frame, past, limits)
                t.weigh(step, frame, stage, det[j], limits.max_age)
                t.take(frame, int(ids[j]), stage, det[j])
                t.steps.append(det[j])
            else:
                t.missed(step)
                t.steps.append(t.guess)
            del t.steps[: -limits.max_age - 1]

    @property
    def memory(self) -> int:
        """Frames back in which rows may still be added, changed or taken back."""
        return max(4 * self.limits.max_age, self.limits.turn_run) + 1

    def release(self, frame: int | None) -> list[list]:
        """The rows up to that frame (none: all), which are final and given once."""
        return [r for t in self.tracks for r in t.release(frame)]


def one_pass(pdf: pd.DataFrame, order: list[int], count: int, limits: Limits) -> list[Track]:
    """The tracks that begin with the best boxes of the first frame of the order."""
    p = Population(count, limits)
    for frame in frames_of(pdf, order):
        p.step(*frame)
    return p.tracks


def start_frame(pdf: pd.DataFrame, count: int, least: float = 0.5) -> int | None:
    """The first frame whose count-th best score is at least `least`, else the frame where it is highest."""
    nth = pdf.sort_values(["frame", "score"], ascending=[True, False]).groupby("frame")["score"].nth(count - 1)
    if not len(nth):
        return None
    frames = pdf.loc[nth.index, "frame"].to_numpy()
    good = frames[nth.to_numpy() >= least]
    return int(good.min()) if len(good) else int(frames[nth.to_numpy() == nth.max()].min())


def _table(video: str, rows: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["frame", "tid", "det", "stage", *VALUES]).astype({"frame": "int64", "tid": "int64", "det": "int64", "stage": "int32"} | dict.fromkeys(VALUES, float))
    out.insert(0, "video", video)
    return out.sort_values(["tid", "frame"])


def _grouped(det: DataFrame, run, schema: str = SCHEMA) -> DataFrame:
    good = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in [*VALUES, "score"])
    rows = det.select("video", "frame", "det", "score", *VALUES).where(f"{good} AND w > 0 AND h > 0 AND frame IS NOT NULL AND det IS NOT NULL")
    out = spread(rows, "video").groupBy("video").applyInPandas(run, schema)
    return out if schema != SCHEMA else out.withColumn("heading", F.when(~F.isnan("heading"), F.col("heading")))


def _both_ways(pdf: pd.DataFrame, count: int, limits: Limits) -> tuple[int, list[Track], list[Track]] | None:
    """The start frame, and the tracks backwards and forwards from it."""
    at = start_frame(pdf, count)
    if at is None:
        return None
    low, high = int(pdf["frame"].min()), int(pdf["frame"].max())
    back = one_pass(pdf, list(range(at, low - 1, -1)), count, Limits(**{**vars(limits), "dt": -1.0}))
    return at, back, one_pass(pdf, list(range(at, high + 1)), count, limits)


def track_population(det: DataFrame, count: int, limits: Limits | None = None) -> DataFrame:
    """video, frame, tid, det, stage and box of a known number of animals. det: video, frame, det, score and VALUES, the heading along w.

    Tracks are numbered by score in the start frame and followed backwards and
    forwards from there. Frames in which an animal isn't seen have no row, and
    a heading that isn't sure is null. A match by distance is taken back if the
    animal is missed right after it or a later such match shows that it was an
    excursion, see retractions(). Videos without a frame of `count` detections
    have no rows; rows with a null, or without an area, are left out.
    """
    limits = limits or Limits()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _both_ways(pdf, count, limits)
        if found is None:
            return _table(key[0], [])
        at, back, ahead = found
        return _table(key[0], [r for t in back for r in t.rows if r[0] < at] + [r for t in ahead for r in t.rows])

    return _grouped(det, run)


RETRACTED = "video string, frame bigint, tid bigint, det bigint, stage int, reason string"


def retractions(det: DataFrame, count: int, limits: Limits | None = None) -> DataFrame:
    """video, frame, tid, det, stage, reason: the rows that track_population() wrote and took back."""
    limits = limits or Limits()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _both_ways(pdf, count, limits)
        rows = [r for tracks in (found or (0, [], []))[1:] for t in tracks for r in t.erased]
        out = pd.DataFrame(rows, columns=["frame", "tid", "det", "stage", "reason"])
        out.insert(0, "video", key[0])
        return out

    return _grouped(det, run, RETRACTED)


def edge_margin(body: float, speed: float, edge_hits: int, width: float, height: float) -> float:
    """How far from the border births need few hits only."""
    return min(0.5 * body + speed * edge_hits, 0.15 * min(width, height))


def track_variable(det: DataFrame, limits: Limits | None = None, width: float | None = None, height: float | None = None, margin: float = 0.0, edge_hits: int = 2, inner_hits: int = 10, inner_age: int | None = None) -> DataFrame:
    """The same for any number of animals. Without width and height a detection that nothing claims begins a track at once; with them it needs edge_hits consecutive frames next to the border and inner_hits elsewhere, and its rows begin with the first hit. A candidate ends with its first miss; a track ends max_age frames after its last box if that is next to the border, else inner_age."""
    policy = Policy(limits or Limits(), width, height, margin, edge_hits, inner_hits, inner_age)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = Changing(policy)
        for frame in frames_of(pdf, list(range(int(pdf["frame"].min()), int(pdf["frame"].max()) + 1))):
            m.step(*frame)
        return _table(key[0], m.release(None))

    return _grouped(det, run)


@dataclass
class Policy:
    """When tracks begin and end, see track_variable()."""

    limits: Limits
    width: float | None = None
    height: float | None = None
    margin: float = 0.0
    edge_hits: int = 2
    inner_hits: int = 10
    inner_age: int | None = None

    def __post_init__(self):
        self.bounded = self.width is not None and self.height is not None
        if self.bounded and self.inner_hits <= self.edge_hits:
            raise ValueError("births inside need more hits than those at the border")
        self.inner = max(30, self.limits.max_age) if self.inner_age is None else self.inner_age
        self.asleep = Limits(**{**vars(self.limits), "max_age": max(self.limits.max_age, self.inner)}) if self.bounded else self.limits

    def near_edge(self, box: np.ndarray) -> bool:
        return min(box[0], self.width - box[0], box[1], self.height - box[1]) <= self.margin

    def needed(self, t: Track) -> int:
        return 1 if not self.bounded else self.edge_hits if self.near_edge(t.born) else self.inner_hits

    def age(self, t: Track) -> int:
        return self.inner if self.bounded and not self.near_edge(t.seen) else self.limits.max_age


class Changing:
    """Any number of animals, followed frame by frame."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.open: list[Track] = []
        self.done: list[Track] = []
        self.number = 0

    @property
    def memory(self) -> int:
        return max(self.policy.limits.turn_run, 3) + 1

    def step(self, frame: int, det: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        policy = self.policy
        over = lambda t: t.firm and t.miss >= policy.age(t)
        self.done += [t for t in self.open if over(t)]
        self.open = [t for t in self.open if not over(t)]
        for t in self.open:
            t.predict()
        free = set(range(len(det)))
        if len(det) and 0 < policy.limits.nms_iou < 1:
            near = overlaps(det, det, np.tri(len(det), k=-1, dtype=bool)) > policy.limits.nms_iou
            for j in np.flatnonzero(near.any(1)).tolist():
                if any(i in free for i in np.flatnonzero(near[j]).tolist()):
                    free.discard(j)
        for firm in (True, False):
            group = [t for t in self.open if t.firm == firm]
            found = claims(group, det, free, policy.asleep)
            for k, t in enumerate(group):
                if k in found:
                    t.take(frame, int(ids[found[k][0]]), found[k][1], det[found[k][0]])
                else:
                    t.miss += 1
        self.open = [t for t in self.open if t.firm or not t.miss]
        for j in sorted(free):
            t = Track(-1, det[j], policy.asleep, firm=False, last=frame)
            t.born = det[j]
            t.note(frame, int(ids[j]), 0, det[j], det[j][4] % 360.0)
            self.open.append(t)
        for t in self.open:
            if not t.firm and t.hits >= policy.needed(t):
                t.firm, t.tid, self.number = True, self.number, self.number + 1
                for r in t.rows:
                    r[1] = t.tid

    def release(self, frame: int | None) -> list[list]:
        """The final rows up to that frame (none: all) of animals that are sure, given once. Candidates keep theirs."""
        out = [r for t in self.done for r in t.release(None)]
        self.done = []
        return out + [r for t in self.open if t.firm for r in t.release(frame)]


def static_windows(tracks: DataFrame, key: list[str], window: int, presence: float = 0.98, iou: float = 0.8, displacement: float = 0.2) -> DataFrame:
    """key, frame of the rows in a window of so many frames in which a track hardly moves: it has begun before, has ceil(presence * window) rows at least, its centre spans at most displacement * median length, and the median overlap with the window's middle row is at least iou.

    A track that is absent for longer than the allowed misses begins anew. A
    window holds at most `window` rows, in a bounded array.
    """
    need = int(np.ceil(presence * window))
    absent = max(1, window - need + 1)
    along = Window.partitionBy(*key).orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(along) > absent).cast("int"), F.lit(1))
    rows = tracks.select(*key, "frame", *VALUES[:4]).withColumn("_n", new).withColumn("_part", F.sum("_n").over(along))
    whole = Window.partitionBy(*key, "_part")
    part = whole.orderBy("frame")
    held = part.rangeBetween(-(window - 1), 0)
    rows = rows.withColumn("_first", F.min("frame").over(whole)).withColumn("_in", F.collect_list(F.struct(*VALUES[:4])).over(held))
    median = lambda a: (F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    span = lambda c: F.array_max(F.col("_in")[c]) - F.array_min(F.col("_in")[c])
    middle = F.element_at("_in", F.floor(F.size("_in") / 2).cast("int") + 1)

    def shared(x):
        side = lambda c, s: F.greatest(F.least(x[c] + x[s] / 2, F.col("_mid")[c] + F.col("_mid")[s] / 2) - F.greatest(x[c] - x[s] / 2, F.col("_mid")[c] - F.col("_mid")[s] / 2), F.lit(0.0))
        both = side("cx", "w") * side("cy", "h")
        return F.coalesce(F.try_divide(both, x["w"] * x["h"] + F.col("_mid")["w"] * F.col("_mid")["h"] - both), F.lit(0.0))

    rows = rows.where((F.size("_in") >= need) & (F.col("frame") - F.col("_first") >= window - 1)).withColumn("_mid", middle)
    rows = rows.withColumn("_long", F.transform("_in", lambda x: F.greatest(x["w"], x["h"]))).withColumn("_iou", F.transform("_in", shared))
    still = rows.where((F.hypot(span("cx"), span("cy")) <= displacement * median(F.col("_long"))) & (median(F.col("_iou")) >= iou))
    ends = still.select(*key, F.explode(F.sequence(F.col("frame") - (window - 1), F.col("frame"))).alias("frame")).distinct()
    return tracks.select(*key, "frame").join(ends, [*key, "frame"], "left_semi")
