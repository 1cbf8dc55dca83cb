"""Decides by appearance whether animals changed places while they touched, and relabels their tracks.

A video is one group: each relabelling changes the contacts that come after
it. A group holds one video's tracks and fragments; videos are spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


from .episodes import follow
from .matching import min_cost, shared_areas

BOX = ["cx", "cy", "w", "h", "heading"]
ROWS = "video string, tid bigint, frame bigint, resolved bigint, history int"
LOG = "video string, start_frame bigint, end_frame bigint, roster string, decision string, reason string, seam bigint"
#: Codes of the history of a row.
ABSTAINED, SWAPPED, CONFIRMED = 22, 23, 26


@dataclass
class Rules:
    """swap_ratio: of the unchanged cost, below which a change is believed; limit: farthest appearance that counts as the same; longest: frames of an episode, 0 for any; roster: of how many an episode may be to be judged whole; rebuilds: relabellings after which episodes are made anew, those after them are done too, but the episodes stay; closed_only: for populations that vary, change only what is seen throughout."""

    swap_ratio: float = 0.5
    limit: float = 5.0
    longest: int = 0
    roster: int = 3
    rebuilds: int = 20
    closed_only: bool = False


def _contacts(t: pd.DataFrame) -> pd.DataFrame:
    """frame, a, b, iou of the boxes that share an area."""
    two = t.merge(t, on="frame", suffixes=("_a", "_b"))
    two = two[two["id_a"] < two["id_b"]]
    a, b = (two[[f"{c}_{k}" for c in BOX]].to_numpy(float) for k in "ab")
    both = shared_areas(a, b) if len(two) else np.zeros(0)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both
    out = pd.DataFrame({"frame": two["frame"], "a": two["id_a"], "b": two["id_b"], "iou": np.divide(both, union, out=np.zeros_like(both), where=union > 0)})
    return out[out["iou"] > 1e-9]


def _bridges(t: pd.DataFrame, c: pd.DataFrame) -> dict[int, set[int]]:
    touched = set(zip(c["frame"], c["a"])) | set(zip(c["frame"], c["b"]))
    out: dict[int, set[int]] = {}
    for i, own in t.groupby("id"):
        f = np.sort(own["frame"].to_numpy())
        for x, y in zip(f, f[1:]):
            if y > x + 1 and (x, i) in touched and (y, i) in touched:
                for k in range(int(x) + 1, int(y)):
                    out.setdefault(k, set()).add(int(i))
    return out


def _far(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.array([[np.sqrt(((x - y) ** 2).sum()) for y in b] for x in a])


def decide(roster: list[int], start: int, frags: pd.DataFrame, rules: Rules) -> tuple[str, str, dict[int, int]]:
    """decision, reason, mapping (id after the episode -> id that it should have). frags: id, start_frame, end_frame, centroid."""
    pre, post, old = [], [], []
    for i in roster:
        own = frags[frags["id"] == i]
        before, after = own[own["end_frame"] < start], own[own["start_frame"] > start]
        if not len(before):
            return "abstain", "no_fragment_before", {}
        if not len(after):
            return "abstain", "no_fragment_after", {}
        pre.append(before.loc[before["end_frame"].idxmax(), "centroid"])
        post.append(after.loc[after["start_frame"].idxmin(), "centroid"])
        old.append([c for c in before["centroid"] if c is not None])
    if any(c is None for c in pre):
        return "abstain", "no_centroid_before", {}
    if any(c is None for c in post):
        return "abstain", "no_centroid_after", {}
    cost = _far(pre, post)
    best = [j for _, j in min_cost(cost, np.ones_like(cost, bool))]
    same, least = float(np.trace(cost)), float(cost[np.arange(len(best)), best].sum())
    change = lambda p: {roster[j]: roster[i] for i, j in enumerate(p) if i != j}
    if best == list(range(len(roster))):
        return ("identity", "", {}) if np.diag(cost).max() < rules.limit else ("abstain", "gate_abs_dist", {})
    if least <= rules.swap_ratio * same and cost[np.arange(len(best)), best].max() < rules.limit:
        return "swap", "", change(best)
    reason = "gate_cost_ratio" if least > rules.swap_ratio * same else "gate_abs_dist"
    prototype = [np.median(np.stack(c), axis=0) for c in old]
    there, here = _far(post, prototype), _far(pre, prototype)
    n = np.arange(len(roster))
    match = lambda c: [j for _, j in min_cost(c, np.ones_like(c, bool))]
    if match(here) == n.tolist() and match(there) != n.tolist():
        to = match(there)
        if there[n, to].sum() <= rules.swap_ratio * np.trace(there):
            return "swap", "prototypes", {roster[i]: roster[j] for i, j in enumerate(to) if i != j}
    if len(roster) == 2:
        for p, name in (([0, 1], "identity"), ([1, 0], "swap")):
            near = there[n, p]
            if near.max() < rules.limit and all(near[i] < there[i, 1 - p[i]] and near[i] < there[1 - i, p[i]] for i in n):
                return name, "one_sided", change(p) if name == "swap" else {}
    return "abstain", reason, {}


def _seam(c: pd.DataFrame, ids: list[int], start: int, end: int) -> int:
    """The earliest of the ids' frames of most overlap with the episode's others, or the middle."""
    found = []
    inside = c[c["frame"].between(start, end) & c["a"].isin(ids) & c["b"].isin(ids)]
    for i in ids:
        own = inside[(inside["a"] == i) | (inside["b"] == i)].sort_values(["iou", "frame"], ascending=[False, True])
        found.append(int(own["frame"].iloc[0]) if len(own) else (start + end) // 2)
    return min(found)


def _closed(t: pd.DataFrame, roster: list[int], start: int, end: int) -> bool:
    """Everyone is seen in each frame from start - 1 to end + 1, and no track begins or ends therein."""
    span = t[t["frame"].between(start - 1, end + 1)]
    whole = all((span["id"] == i).sum() == end - start + 3 for i in roster)
    ends = t.groupby("id")["frame"].agg(["min", "max"])
    inside = ends["min"].between(start - 1, end + 1) | ends["max"].between(start - 1, end + 1)
    return bool(whole and not inside.any())


def _pieces(t: pd.DataFrame, c: pd.DataFrame, start: int, end: int, roster: tuple[int, ...], most: int) -> tuple[list[tuple[int, ...]], str]:
    """Rosters of at most `most` into which a large contact is taken apart, and why there are none: around each id that was filled in or came back within it, those that overlap it most at any time."""
    inside = t[t["frame"].between(start, end) & t["id"].isin(roster)]
    met = c[c["frame"].between(start, end) & c["a"].isin(roster) & c["b"].isin(roster)]
    near = pd.concat([met.rename(columns={"a": "id", "b": "other"}), met.rename(columns={"b": "id", "a": "other"})]).groupby(["id", "other"])["iou"].max().reset_index()
    found, triggers = set(), 0
    for i in sorted(roster):
        own = inside[inside["id"] == i].sort_values("frame")
        back = (own["frame"] > start) & (own["frame"].diff() != 1)
        if not (own["filled"] | back).any():
            continue
        triggers += 1
        others = near[near["id"] == i].sort_values(["iou", "other"], ascending=[False, True])["other"].tolist()[: most - 1]
        if others:
            found.add(tuple(sorted([i, *map(int, others)])))
    return sorted(found), "" if found else "no_candidate" if triggers else "no_trigger"


class _Video:
    """Tracks and fragments of one video while it is being resolved."""

    def __init__(self, tracks: pd.DataFrame, frags: pd.DataFrame, rules: Rules):
        self.t = tracks.assign(id=tracks["tid"], history=0).reset_index(drop=True)
        if "filled" not in self.t:
            self.t["filled"] = False
        self.g = frags.assign(id=frags["tid"]).reset_index(drop=True)
        self.rules, self.log, self.changes = rules, [], 0

    def episodes(self) -> list[tuple[int, int, tuple[int, ...]]]:
        self.c = _contacts(self.t)
        pairs = {int(f): list(zip(p["a"].tolist(), p["b"].tolist())) for f, p in self.c.groupby("frame")}
        return sorted(follow(pairs, _bridges(self.t, self.c), self.rules.longest), key=lambda e: (e[0], e[2]))

    def note(self, start: int, end: int, roster: tuple[int, ...], what: str, why: str, seam: int | None = None) -> None:
        self.log.append((start, end, ",".join(map(str, roster)), what, why, seam))
        inside = self.t["frame"].between(start, end) & self.t["id"].isin(roster)
        self.t.loc[inside, "history"] = {"swap": SWAPPED, "identity": CONFIRMED}.get(what, ABSTAINED)

    def judge(self, start: int, end: int, roster: tuple[int, ...]) -> int | None:
        """Decides and, for a change of places, relabels; the seam of that."""
        what, why, mapping = decide(list(roster), start, self.g, self.rules)
        if what == "swap" and self.rules.closed_only and not _closed(self.t, list(roster), start, end):
            what, why, mapping = "abstain", "not_closed", {}
        seam = _seam(self.c, sorted(mapping), start, end) if mapping else None
        self.note(start, end, roster, what, why, seam)
        if seam is not None:
            for rows, late in ((self.t, self.t["frame"] >= seam), (self.g, self.g["start_frame"] >= seam)):
                if rows is self.t:
                    rows.loc[late & rows["id"].isin(mapping), "history"] = SWAPPED
                rows.loc[late, "id"] = rows.loc[late, "id"].map(lambda i: mapping.get(i, i))
            self.changes += 1
            if self.changes > self.rules.rebuilds:
                self.c = _contacts(self.t)  # the seams of later episodes look at the ids of now
        return seam


def resolve_video(tracks: pd.DataFrame, frags: pd.DataFrame, rules: Rules) -> tuple[pd.DataFrame, list[tuple]]:
    """tracks with resolved and history, and start, end, roster, decision, reason, seam of each episode that was judged.

    Episodes are taken by start and roster. Those of more ids than rules.roster
    are judged in pieces. After a change they are made anew and begin at the
    first, and none is judged twice; after rules.rebuilds changes the list stays
    and every later change is still made.
    """
    v = _Video(tracks, frags, rules)
    judged: set[tuple] = set()
    again = True
    while again:
        again = False
        for start, end, roster in v.episodes():
            if (start, end, roster) in judged:
                continue
            judged.add((start, end, roster))
            parts = [roster]
            if len(roster) > rules.roster:
                parts, why = _pieces(v.t, v.c, start, end, roster, rules.roster)
                if not parts:
                    v.note(start, end, roster, "abstain", why)
            for part in parts:
                if part != roster:
                    if (start, end, part) in judged:
                        continue
                    judged.add((start, end, part))
                seam = v.judge(start, end, part)
                if seam is not None and v.changes <= rules.rebuilds:
                    for k in [j for j in judged if j[1] >= seam and j[0] > start]:
                        judged.discard(k)
                    if part != roster:
                        judged.discard((start, end, roster))  # its other pieces are still to be judged
                    again = True
                    break
            if again:
                break
    return v.t, v.log


def _run(tracks: DataFrame, frags: DataFrame, rules: Rules | None, schema: str, shape) -> DataFrame:
    rules = rules or Rules()
    good = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in BOX)
    filled = F.coalesce(F.col("filled"), F.lit(False)) if "filled" in tracks.columns else F.lit(False)
    t = tracks.select("video", "tid", "frame", *BOX, filled.alias("filled")).where(f"{good} AND w > 0 AND h > 0 AND tid IS NOT NULL AND frame IS NOT NULL")
    g = frags.select("video", "tid", "start_frame", "end_frame", F.col("centroid").cast("array<double>").alias("centroid"))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.assign(centroid=[None if c is None or np.isnan(np.asarray(c, float)).any() else np.asarray(c, float) for c in b["centroid"]])
        return shape(key[0], *resolve_video(a, b, rules))

    return spread(t, "video").groupBy("video").cogroup(spread(g, "video").groupBy("video")).applyInPandas(run, schema)


def resolve(tracks: DataFrame, frags: DataFrame, rules: Rules | None = None) -> DataFrame:
    """video, tid, frame, resolved (the id it should have), history (0: in no contact). tracks: video, tid, frame, box and, if there is one, filled (made up where the animal wasn't seen); frags: video, tid, start_frame, end_frame, centroid."""

    def shape(video: str, t: pd.DataFrame, log: list) -> pd.DataFrame:
        return t.assign(video=video, resolved=t["id"])[["video", "tid", "frame", "resolved", "history"]]

    return _run(tracks, frags, rules, ROWS, shape)


def decisions(tracks: DataFrame, frags: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The log of resolve: one row per episode that was judged."""

    def shape(video: str, t: pd.DataFrame, log: list) -> pd.DataFrame:
        out = pd.DataFrame(log, columns=["start_frame", "end_frame", "roster", "decision", "reason", "seam"])
        out["seam"] = out["seam"].astype("Int64")
        out.insert(0, "video", video)
        return out

    return _run(tracks, frags, rules, LOG, shape)
