"""Greedy overlap tracking with expiry, over a table or a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread


SCHEMA = "video string, frame bigint, det bigint, tid bigint"
_STATE = "last bigint, next bigint, tid array<bigint>, frame array<bigint>, box array<double>"


class Tracks:
    """Open tracks of one video: id, last frame, last box (cx, cy, w, h)."""

    def __init__(self, match_iou: float, max_gap: int):
        self.match_iou, self.max_gap = match_iou, max_gap
        self.next, self.last = 0, -1
        self.tid, self.frame, self.box = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4))

    def step(self, frame: int, boxes: np.ndarray) -> np.ndarray:
        """Ids of the frame's boxes: pairs claim each other by falling overlap, others begin tracks. Frames have to come in order."""
        if frame <= self.last:
            raise ValueError(f"frame {frame} comes after {self.last}")
        self.last = frame
        alive = frame - self.frame <= self.max_gap
        self.tid, self.frame, self.box = self.tid[alive], self.frame[alive], self.box[alive]
        a, b = self.box[:, None, :], boxes[None, :, :]
        side = lambda c, s: np.clip(np.minimum(a[..., c] + a[..., s] / 2, b[..., c] + b[..., s] / 2) - np.maximum(a[..., c] - a[..., s] / 2, b[..., c] - b[..., s] / 2), 0, None)
        both = side(0, 2) * side(1, 3)
        union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both
        iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        out = np.full(len(boxes), -1, np.int64)
        taken = np.zeros(len(self.tid), bool)
        rows, cols = np.nonzero(iou >= self.match_iou)
        for k in np.argsort(-iou[rows, cols], kind="stable"):
            i, j = rows[k], cols[k]
            if not taken[i] and out[j] < 0:
                taken[i], out[j] = True, self.tid[i]
                self.frame[i], self.box[i] = frame, boxes[j]
        new = np.flatnonzero(out < 0)
        out[new] = self.next + np.arange(len(new))
        self.next += len(new)
        self.tid, self.frame = np.concatenate((self.tid, out[new])), np.concatenate((self.frame, np.full(len(new), frame)))
        self.box = np.concatenate((self.box, boxes[new]))
        return out


def _follow(tracks: Tracks, video: str, pdf: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for frame, own in pdf.sort_values(["frame", "det"]).groupby("frame", sort=True):
        ids = tracks.step(int(frame), own[["cx", "cy", "w", "h"]].to_numpy(float))
        parts.append(pd.DataFrame({"video": video, "frame": int(frame), "det": own["det"].to_numpy(), "tid": ids}))
    return pd.concat(parts) if parts else pd.DataFrame({"video": [], "frame": [], "det": [], "tid": []})


def track(det: DataFrame, match_iou: float = 0.3, max_gap: int = 3) -> DataFrame:
    """det: video, frame, det, cx, cy, w, h. One group per video, as its order matters."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _follow(Tracks(match_iou, max_gap), key[0], pdf)

    return spread(det.select("video", "frame", "det", "cx", "cy", "w", "h"), "video").groupBy("video").applyInPandas(run, SCHEMA)


def track_stream(det: DataFrame, match_iou: float = 0.3, max_gap: int = 3) -> DataFrame:
    """The same for a stream whose micro-batches hold whole frames of a video, in order; the state is the video's open tracks."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracks = Tracks(match_iou, max_gap)
        if state.exists:
            tracks.last, tracks.next, tid, frame, box = state.get
            tracks.tid, tracks.frame, tracks.box = np.array(tid, np.int64), np.array(frame, np.int64), np.array(box, float).reshape(-1, 4)
        out = _follow(tracks, key[0], pd.concat(list(parts)))
        state.update((int(tracks.last), int(tracks.next), tracks.tid.tolist(), tracks.frame.tolist(), tracks.box.ravel().tolist()))
        yield out

    return det.select("video", "frame", "det", "cx", "cy", "w", "h").groupBy("video").applyInPandasWithState(run, SCHEMA, _STATE, "append", "NoTimeout")
