import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from trajectorium.functions import polygons
from trajectorium.functions.kalman import Filter
from trajectorium.operators import headings, identity, matching


def test_signs_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        axes = rng.integers(0, 18, rng.integers(1, 6)) * 10.0
        left, right = (rng.choice([None, float(rng.integers(0, 36) * 10)]) for _ in range(2))

        def cost(turns):
            o = [(a + 180 * t) % 360 for a, t in zip(axes, turns)]
            ends = ([left] if left is not None else []) + o + ([right] if right is not None else [])
            return sum(headings.apart(a, b) for a, b in zip(ends, ends[1:]))

        got = headings.signs(list(axes), left, right)
        options = [t for t in itertools.product((0, 1), repeat=len(axes)) if left is not None or right is not None or t[0] == 0]
        assert math.isclose(cost(got), min(map(cost, options)), abs_tol=1e-9)


def test_filter_follows_a_straight_line():
    f = Filter(np.array([0.0, 0.0]))
    for k in range(1, 40):
        f.predict()
        f.update(np.array([2.0 * k, -k]))
    assert np.allclose(f.predict(), [80, -40], atol=0.1)


def test_gaps_are_predicted_up_to_their_age(spark):
    rows = [(1, k, 2.0 * k, float(k)) for k in (*range(20), 22, 23, 40)]
    got = headings.predicted_gaps(spark.createDataFrame(rows, "tid long, frame long, cx double, cy double"), 5).collect()
    assert sorted(x.frame for x in got) == [20, 21]
    assert all(abs(x.cx - 2 * x.frame) < 0.5 for x in got)


def box(cx, cy, w, h, heading):
    ux, uy = math.sin(math.radians(heading)), -math.cos(math.radians(heading))
    return [(cx + a * ux * w / 2 - b * uy * h / 2, cy + a * uy * w / 2 + b * ux * h / 2) for a, b in [(1, 1), (1, -1), (-1, -1), (-1, 1)]]


def test_oriented_overlap(spark):
    cases = [
        (box(0, 0, 4, 2, 0), box(0, 0, 4, 2, 0), 8.0),  # the same
        (box(0, 0, 4, 2, 30), box(0, 0, 4, 2, 30), 8.0),
        (box(0, 0, 4, 2, 0), box(0, 0, 4, 2, 90), 4.0),  # a cross
        (box(0, 0, 4, 4, 0), box(4, 0, 4, 4, 0), 0.0),  # an edge in common
        (box(0, 0, 4, 4, 0), box(2, 0, 4, 4, 0), 8.0),  # half, with edges on one line
        (box(0, 0, 4, 4, 0), box(0, 0, 2, 2, 45), 4.0),  # one inside
        (box(0, 0, 2, 2, 0), box(0, 0, 2, 2, 45), 8 * (math.sqrt(2) - 1)),  # an octagon
        (box(0, 0, 2, 2, 0), box(9, 9, 2, 2, 10), 0.0),
        (box(0, 0, 2, 0, 0), box(0, 0, 2, 2, 10), 0.0),  # no area
    ]
    points = "array<struct<x:double,y:double>>"
    rows = [(k, a, b) for k, (a, b, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, f"k int, a {points}, b {points}").select("k", polygons.overlap(F.col("a"), F.col("b")).alias("shared")).collect()
    for x in got:
        assert math.isclose(x.shared, cases[x.k][2], abs_tol=1e-6), x.k


def test_slots_go_to_the_lowest_and_come_back(spark):
    rows = [("v", 0, 7), ("v", 0, 9), ("v", 1, 9), ("v", 2, 7), ("v", 2, 9), ("v", 3, 9), ("v", 3, 11), ("v", 4, 7), ("v", 4, 9)]
    got = {(x.frame, x.tid): x.slot for x in identity.slots(spark.createDataFrame(rows, "v string, frame long, tid long"), "v").collect()}
    assert got == {(0, 7): 0, (0, 9): 1, (1, 9): 1, (2, 7): 0, (2, 9): 1, (3, 9): 1, (3, 11): 0, (4, 7): 0, (4, 9): 1}


def test_roster_of_two(spark):
    rows = [(1.0, 9.0, 9.0, 1.0), (9.0, 1.0, 1.0, 9.0), (6.0, 7.0, 7.0, 6.0), (3.0, 3.0, 3.0, 3.0), (None, 1.0, 1.0, 1.0)]
    got = identity.two_roster_decision(spark.createDataFrame(rows, "c11 double, c12 double, c21 double, c22 double")).collect()
    assert [x.decision for x in got] == ["identity", "swap", "abstain", "identity", "abstain"]


def test_silhouette_of_two_groups(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [10.0, 0.0]), (4, 2, [5.0, 5.0])]
    got = {x.i: x.s for x in identity.silhouette(spark.createDataFrame(rows, "i long, l long, v array<double>"), "i", "l", "v", 3).collect()}
    b = math.hypot(5, 5)
    assert math.isclose(got[1], (b - 1) / b) and got[3] == 0 and got[4] == 0
    one = identity.silhouette(spark.createDataFrame(rows[:2], "i long, l long, v array<double>"), "i", "l", "v", 3).collect()
    assert [x.s for x in one] == [None, None]


def test_both_overlaps_agree(spark):
    rng = np.random.default_rng(5)
    a = np.column_stack([rng.uniform(0, 20, (300, 2)), rng.uniform(2, 20, (300, 2)), rng.integers(0, 72, 300) * 5.0])
    b = np.column_stack([rng.uniform(0, 20, (300, 2)), rng.uniform(2, 20, (300, 2)), rng.integers(0, 72, 300) * 5.0])
    b[:20] = a[:20]
    points = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(k, box(*a[k].tolist()), box(*b[k].tolist())) for k in range(300)], f"k int, a {points}, b {points}")
    native = {x.k: x.s for x in df.select("k", polygons.overlap(F.col("a"), F.col("b")).alias("s")).collect()}
    got = matching.shared_areas(a, b)
    assert np.allclose(got, [native[k] for k in range(300)], atol=1e-6) and (got > 0).sum() > 50
    assert np.allclose(got[:20], a[:20, 2] * a[:20, 3])


def test_distances_of_close_and_far_vectors():
    """Failed before: there was no product of matrices, each row met all others by differences. Copies are 0 apart, close pairs keep their digits."""
    rng = np.random.default_rng(3)
    u = rng.normal(size=(50, 64)) + 100
    v = np.concatenate([u[:20], u[20:40] + 1e-9 * rng.normal(size=(20, 64)), rng.normal(size=(60, 64)), np.full((1, 64), 1e200), np.full((1, 64), np.inf)])
    with np.errstate(over="ignore"):
        exact = np.sqrt(((u[:, None] - v) ** 2).sum(2))
    found = identity.distances(u, v)
    assert (np.diag(found)[:20] == 0).all()
    assert np.allclose(found, exact, rtol=1e-11, atol=0)
