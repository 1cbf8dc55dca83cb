"""Hand-made videos for the staged tracker and the static windows."""

import itertools

import numpy as np
import pytest

from trajectorium.functions.kalman import Filter
from trajectorium.operators import matching
from trajectorium.session import ship
from trajectorium.streaming import staged

COLUMNS = "video string, frame bigint, det bigint, score double, cx double, cy double, w double, h double, heading double"


def video(spark, rows):
    ship(spark)
    return spark.createDataFrame([("v", int(f), int(d), float(s), *map(float, box)) for f, d, s, box in rows], COLUMNS)


def crossing(gap=()):
    rows = []
    for f in range(20):
        if f not in gap:
            rows.append((f, 2 * f, 0.9, (10 + 5 * f, 100, 20, 8, 90)))
            rows.append((f, 2 * f + 1, 0.8, (105 - 5 * f, 112, 20, 8, 270)))
    return rows


@pytest.mark.parametrize("gap", [(), (9, 10)])
def test_population_keeps_crossing_animals_apart(spark, gap):
    out = staged.track_population(video(spark, crossing(gap)), 2).collect()
    assert len(out) == 2 * (20 - len(gap))
    assert all(x.det % 2 == x.tid for x in out)
    assert {x.heading for x in out if x.tid == 0 and x.stage == 1} == {90.0}


def test_start_frame_lies_inside_and_both_passes_meet(spark):
    rows = [(f, d, 0.9 if f >= 7 else 0.3, box) for f, d, _, box in crossing()]
    out = staged.track_population(video(spark, rows), 2).collect()
    assert {(x.frame, x.det % 2) for x in out} == {(f, t) for f in range(20) for t in (0, 1)}
    assert len({(x.tid, x.det % 2) for x in out}) == 2
    assert {x.frame for x in out if x.stage == 0} == {7}


def test_one_flipped_heading_is_mended_and_a_lasting_turn_is_believed(spark):
    one = [(f, f, 0.9, (50, 50, 20, 8, 270 if f == 5 else 90)) for f in range(10)]
    out = {x.frame: x for x in staged.track_population(video(spark, one), 1).collect()}
    assert len(out) == 10 and out[5].heading in (None, 90.0)
    turned = [(f, f, 0.9, (50, 50, 20, 8, 270 if f >= 5 else 90)) for f in range(12)]
    out = {x.frame: x for x in staged.track_population(video(spark, turned), 1).collect()}
    assert [out[f].heading for f in range(12)] == [90.0] * 5 + [270.0] * 7


def test_no_frame_with_enough_detections_and_bad_rows(spark):
    assert staged.track_population(video(spark, [(0, 0, 0.9, (1, 1, 4, 2, 0))]), 2).count() == 0
    rows = [(0, 0, 0.9, (1, 1, 4, 2, 0)), (1, 1, 0.9, (1, 1, 0, 2, 0)), (2, 2, 0.9, (1, 1, float("nan"), 2, 0))]
    assert staged.track_population(video(spark, rows), 1).count() == 1
    assert staged.track_variable(video(spark, [])).count() == 0


def test_births_need_fewer_hits_at_the_border_and_rows_begin_with_the_first(spark):
    inside = [(f, f, 0.9, (50, 50, 10, 4, 0)) for f in range(9)]
    border = [(f, 100 + f, 0.9, (3, 50, 10, 4, 0)) for f in (0, 1)]
    far = [(f, 200 + f, 0.9, (50, 90, 10, 4, 0)) for f in range(10)]
    out = staged.track_variable(video(spark, inside + border + far), width=100.0, height=100.0, margin=5.0).collect()
    assert sorted(x.det for x in out) == [100, 101, *range(200, 210)]
    assert len(staged.track_variable(video(spark, inside + border + far)).collect()) == 21


def test_a_track_ends_at_its_age(spark):
    rows = lambda again: [(f, f, 0.9, (50, 50, 10, 4, 0)) for f in (0, 1, again)]
    ids = lambda again: len({x.tid for x in staged.track_variable(video(spark, rows(again)), staged.Limits(max_age=3)).collect()})
    assert ids(4) == 1
    assert ids(5) == 2


def test_duplicates_and_costs():
    rng = np.random.default_rng(1)
    a = np.column_stack([rng.uniform(0, 60, (5, 2)), rng.uniform(15, 25, 5), rng.uniform(5, 10, 5), rng.uniform(0, 360, 5)])
    b = a[rng.permutation(5)] + rng.normal(0, 1, (5, 5))
    limits = staged.Limits(strong_iou=0.3, strong_turn=60)
    pairs = staged.by_overlap([(a, a[:, 4])], np.zeros(5), b, True, True, limits)
    iou = staged.overlaps(a, b)
    turn = staged.apart(a[:, 4][:, None], b[:, 4][None, :])
    cost = np.where((iou >= 0.3) & (turn <= 60), ((1 - iou) / 0.7) ** 2 + (turn / 60) ** 2, 1e12)
    best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert np.isclose(sum(cost[i, j] for i, j in pairs) + 1e12 * (5 - len(pairs)), best)
    found, free = {0: (0, 2), 1: (1, 1)}, set()
    staged.part_duplicates(found, np.array([[0, 0, 10, 4, 0.0], [0.1, 0, 10, 4, 0]]), np.array([0.9, 0.1]), limits, free)
    assert found == {1: (1, 1)} and free == {0}


def brute_static(rows, window, presence, iou, displacement):
    need = int(np.ceil(presence * window))
    absent = max(1, window - need + 1)
    parts, out = [[rows[0]]], set()
    for x in rows[1:]:
        if x[0] - parts[-1][-1][0] > absent:
            parts.append([])
        parts[-1].append(x)
    for p in parts:
        for f, *_ in p:
            w = [x for x in p if f - window < x[0] <= f]
            if len(w) < need or f - p[0][0] < window - 1:
                continue
            b = np.array([x[1:] for x in w], float)
            m = b[len(b) // 2]
            side = lambda c, s: np.clip(np.minimum(b[:, c] + b[:, s] / 2, m[c] + m[s] / 2) - np.maximum(b[:, c] - b[:, s] / 2, m[c] - m[s] / 2), 0, None)  # noqa: B023, E731
            both = side(0, 2) * side(1, 3)
            share = both / (b[:, 2] * b[:, 3] + m[2] * m[3] - both)
            if np.hypot(np.ptp(b[:, 0]), np.ptp(b[:, 1])) <= displacement * np.median(b[:, 2:].max(1)) and np.median(share) >= iou:
                out |= {x[0] for x in w}
    return out


def test_static_windows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for seed in range(3):
        frames = np.flatnonzero(rng.random(60) < 0.85)
        still = (frames // 15) % 2 == 0
        rows = [(int(f), 50 + rng.normal(0, 0.3 if s else 6), 50 + rng.normal(0, 0.3 if s else 6), 20.0, 8.0) for f, s in zip(frames, still)]
        t = spark.createDataFrame([(seed, *x, 0.0) for x in rows], "tid bigint, frame bigint, cx double, cy double, w double, h double, heading double")
        got = {x.frame for x in staged.static_windows(t, ["tid"], 8, 0.7, 0.7, 0.2).collect()}
        assert got == brute_static(rows, 8, 0.7, 0.7, 0.2) and got


def moving(at):
    return [(f, f, 0.9, (x, 50, 20, 8, 90)) for f, x in enumerate(at) if x is not None]


def tracked(spark, at):
    df = video(spark, moving(at))
    return {x.frame: x for x in staged.track_population(df, 1).collect()}, [(x.frame, x.det, x.stage, x.reason) for x in staged.retractions(df, 1).collect()]


def test_a_leap_before_a_miss_is_taken_back(spark):
    out, gone = tracked(spark, [50] * 6 + [73, None, 50, 50])
    assert gone == [(6, 6, staged.BY_SPEED, staged.BEFORE_MISS)]
    assert sorted(out) == [0, 1, 2, 3, 4, 5, 8, 9] and out[8].stage in (1, 3)
    # the track went on from the box before the leap: the place of its filters is there
    assert out[8].heading == 90.0


def test_an_excursion_between_two_leaps_is_taken_back(spark):
    out, gone = tracked(spark, [50] * 6 + [73, 50, 50, 50])
    assert gone == [(6, 6, staged.BY_SPEED, staged.EXCURSION)] and sorted(out) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert out[7].stage == staged.BY_SPEED


def test_true_fast_motion_stays(spark):
    out, gone = tracked(spark, [50] * 6 + [73, 96, 119, 142])
    assert not gone and sorted(out) == list(range(10)) and out[6].stage == staged.BY_SPEED
    # a leap away that is missed afterwards stays if what it came from was a leap itself
    out, gone = tracked(spark, [50] * 6 + [73, 120, None, 120])
    assert all(reason == staged.EXCURSION or frame != 7 for frame, _, _, reason in gone)


def test_a_run_of_reversed_headings_must_agree():
    """Headings that are far from the old one, but also from each other, begin the run anew."""
    t = staged.Track(0, np.array([50.0, 50, 9, 8, 90]), staged.Limits())
    for f, a in enumerate([270, 200, 270, 265, 270]):
        t.predict()
        t.take(f, f, 2, np.array([50.0, 50, 9, 8, a]))
    assert [r[-1] for r in t.rows[2:]] == [270, 265, 270] and np.isnan([r[-1] for r in t.rows[:2]]).all() and t.heading == 270
    t = staged.Track(0, np.array([50.0, 50, 9, 8, 90]), staged.Limits())
    for f, a in enumerate([270, 100, 270, 270]):
        t.predict()
        t.take(f, f, 2, np.array([50.0, 50, 9, 8, a]))
    assert np.isnan([r[-1] for r in t.rows]).all() and t.heading == 90


def test_nothing_is_taken_back_from_nothing(spark):
    assert staged.retractions(video(spark, []), 1).count() == 0
    assert staged.retractions(video(spark, [(0, 0, 0.9, (1, 1, 4, 2, 0))]), 2).count() == 0


def test_boxes_are_measured_once_for_all_stages(monkeypatch):
    calls = []
    monkeypatch.setattr(staged, "shared_areas", lambda a, b, f=staged.shared_areas: calls.append(len(a)) or f(a, b))
    limits = staged.Limits()
    tracks = [staged.Track(k, np.array([30.0 * k, 50, 20, 8, 90]), limits) for k in range(3)]
    for t in tracks:
        t.predict()
    det = np.array([[0.0, 50, 20, 8, 90], [30, 52, 20, 8, 200], [66, 50, 20, 8, 0]])
    free = {0, 1, 2}
    found = staged.claims(tracks, det, free, limits, steps=10)
    assert {k: j for k, (j, _) in found.items()} == {0: 0, 1: 1, 2: 2} and not free
    assert len({stage for _, stage in found.values()}) > 1 and len(calls) == 1


def test_filter_equals_its_matrices():
    rng = np.random.default_rng(3)
    for dt in (1.0, -1.0):
        drift = (0.01, 0.02, 0.05, 0.07)
        f = Filter((1.0, 2.0), noise=0.1, drift=drift, dt=dt)
        x, p, step = np.array([1.0, 2, 0, 0]), np.eye(4) * 10, np.eye(4)
        step[0, 2] = step[1, 3] = dt
        for seen in rng.normal(size=(30, 2)):
            x, p = step @ x, step @ p @ step.T + np.diag(drift)
            assert np.allclose(f.predict(), x[:2])
            gain = np.linalg.solve(p[:2, :2] + np.eye(2) * 0.1, p[:2]).T
            x, p = x + gain @ (seen - x[:2]), p - gain @ p[:2]
            assert np.allclose(f.update(seen), x[:2]) and np.allclose(f.x, x)


def test_few_entries_are_assigned_as_many_are(monkeypatch):
    rng = np.random.default_rng(4)
    for t in range(300):
        shape = rng.integers(1, 8, 2)
        cost, valid = rng.integers(0, 3 if t % 2 else 1000, shape).astype(float), rng.random(shape) < rng.random()
        few = matching.min_cost(cost, valid)
        with monkeypatch.context() as m:
            m.setattr(matching, "FEW", 0)
            assert few == matching.min_cost(cost, valid)
