"""Each gate of a gap, on tracks made by hand."""

import math

import numpy as np
import pytest

from trajectorium.operators import headings

SCHEMA = "tid bigint, frame bigint, cx double, cy double, w double, h double, axis double, heading double, risky boolean"


def track(tid, frames, x=lambda f: 2.0 * f, axis=lambda f: 90.0, heading=lambda f: 90.0, risky=()):
    return [(tid, f, float(x(f)), 5.0, 20.0, 8.0, axis(f), heading(f), f in risky) for f in frames]


SOME = [*range(8), 11, 12]


@pytest.fixture(scope="module")
def found(spark):
    rows = track(1, SOME)
    rows += track(2, [*range(8), 20, 21])  # too long
    rows += track(3, SOME, risky={7}) + track(4, SOME, risky={11})
    rows += track(5, SOME, x=lambda f: 2.0 * f if f < 10 else 200.0 + f)  # leaps
    rows += track(6, SOME, heading=lambda f: 90.0 if f < 10 else 270.0)  # turns round
    rows += track(7, SOME, heading=lambda f: None)
    rows += track(8, SOME, x=lambda f: 0.0 if f < 7 else 6.0 if f == 7 else 8.0)  # about where it was, not where it was going
    rows += track(9, SOME, axis=lambda f: 90.0, heading=lambda f: 60.0)  # its heading is off its axis
    rows += track(10, range(5)) + [(11, 3, 1.0, 1.0, 4.0, 2.0, 0.0, 0.0, False), (12, 1, None, 1.0, 4.0, 2.0, 0.0, 0.0, False)]
    rows += track(13, SOME, heading=lambda f: 88.0 if f < 10 else None)
    df = spark.createDataFrame(rows, SCHEMA)
    assert headings.gap_fills(df.limit(0)).count() == 0
    return {r["tid"]: r for r in headings.gap_fills(df, axis_error=20.0).collect()}


def test_actions(found):
    said = {k: r["action"] for k, r in found.items()}
    assert said == {1: headings.FILLED, 2: headings.TOO_LONG, 3: headings.RISKY, 4: headings.RISKY, 5: headings.NO_OVERLAP, 6: headings.TURNED, 7: headings.FILLED, 8: headings.FILLED, 9: headings.OFF_AXIS, 13: headings.FILLED}
    assert all((r["before"], r["after"]) == (7, 11) for k, r in found.items() if k != 2)
    assert found[1]["branch"] == "prediction" and found[8]["branch"] in ("prediction", "previous") and found[5]["branch"] is None
    assert found[6]["turn"] == pytest.approx(180, abs=1) and found[1]["iou"] > 0.9 and found[5]["iou"] == 0


def test_boxes_lie_on_the_chord(found):
    assert [(b["frame"], round(b["cx"], 6), round(b["w"], 6), round(b["h"], 6), b["heading"]) for b in found[1]["boxes"]] == [(f, 2.0 * f, 20.0, 8.0, 90.0) for f in (8, 9, 10)]
    assert all(b["heading"] is None for b in found[7]["boxes"]) and len(found[7]["boxes"]) == 3
    assert all(b["heading"] == 90.0 for b in found[13]["boxes"])
    assert not found[2]["boxes"] and not found[9]["boxes"]


def test_a_box_between_two():
    a, b = np.array([0.0, 0, 20, 8, 90]), np.array([10.0, 0, 20, 8, 270])
    # the same box turned round is the same box
    assert headings.between(a, b, 0.5)[:4] == pytest.approx([5, 0, 20, 8]) and headings.between(a, b, 0.5)[4] % 180 == pytest.approx(90)
    mid = headings.between(np.array([0.0, 0, 20, 8, 80]), np.array([0.0, 0, 20, 8, 100]), 0.5)
    assert mid[4] % 180 == pytest.approx(90) and mid[2] == pytest.approx(20 * math.cos(math.radians(10)))
    assert headings.on_long_axis(90, 40, 45) is None and headings.on_long_axis(90, 240, 45) == 270


def test_a_tracks_gaps_are_compared_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(headings, "shared_areas", lambda a, b, f=headings.shared_areas: calls.append(len(a)) or f(a, b))
    frames = np.array([0, 1, 3, 4, 7, 8, 30, 31, 33])
    box = np.array([(2.0 * f, 5.0, 20.0, 8.0, 90.0) for f in frames])
    risky = np.zeros(len(frames), bool)
    risky[-1] = True
    found = headings.gaps_of(frames, box, np.full(len(frames), 90.0), risky, {"age": 10, "iou": 0.5, "turn": 45.0, "axis": 45.0})
    assert [x[:3] for x in found] == [(1, 3, headings.FILLED), (4, 7, headings.FILLED), (8, 30, headings.TOO_LONG), (31, 33, headings.RISKY)]
    assert [[b[0] for b in x[-1]] for x in found] == [[2], [5, 6], [], []] and calls == [4]
    assert all(np.allclose(b[1:3], (2 * b[0], 5)) for x in found for b in x[-1])
