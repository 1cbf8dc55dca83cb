"""Two animals that touch, with and without changing places."""

import numpy as np
import pandas as pd
import pytest

from trajectorium.operators import resolver
from trajectorium.session import ship

A, B = [0.0, 0.0], [20.0, 0.0]


def tracks(frames=range(20)):
    rows = []
    for f in frames:
        apart = abs(f - 10) * 6 - 6
        rows += [("v", 1, f, 100.0 - max(apart, 2), 50.0, 12.0, 6.0, 90.0), ("v", 2, f, 100.0 + max(apart, 2), 50.0, 12.0, 6.0, 90.0)]
    return pd.DataFrame(rows, columns=["video", "tid", "frame", *resolver.BOX])


def frags(after):
    rows = [("v", 1, 0, 5, A), ("v", 2, 0, 5, B), *[("v", i, 14, 18, c) for i, c in after]]
    return pd.DataFrame(rows, columns=["video", "tid", "start_frame", "end_frame", "centroid"])


def judge(after, rules=None, t=None):
    g = frags(after)
    g["centroid"] = [None if c is None else np.array(c) for c in g["centroid"]]
    return resolver.resolve_video(tracks() if t is None else t, g, rules or resolver.Rules())


def test_a_change_of_places_is_undone_from_the_seam_on():
    t, log = judge([(1, B), (2, A)])
    assert log[0][3] == "swap"
    seam = log[0][5]
    assert log[0][0] <= seam <= log[0][1]
    assert ((t["id"] != t["tid"]) == (t["frame"] >= seam)).all()
    assert sorted(t.loc[t["frame"] == 19, "id"]) == [1, 2]
    assert all(x[3] != "swap" for x in log[1:])


def test_unchanged_places_and_lacking_evidence():
    t, log = judge([(1, A), (2, B)])
    assert (t["id"] == t["tid"]).all() and [x[3] for x in log] == ["identity"]
    assert set(t.loc[t["frame"] == 10, "history"]) == {resolver.CONFIRMED} and set(t.loc[t["frame"] == 0, "history"]) == {0}
    for after, why in (([(1, A)], "no_fragment_after"), ([(1, A), (2, None)], "no_centroid_after"), ([(1, [90.0, 0]), (2, [110.0, 0])], "gate_abs_dist")):
        t, log = judge(after)
        assert [(x[3], x[4]) for x in log] == [("abstain", why)] and (t["id"] == t["tid"]).all()


def test_a_guarded_change_needs_everyone_in_sight():
    rules = resolver.Rules(closed_only=True)
    assert judge([(1, B), (2, A)], rules)[1][0][3] == "swap"
    t = tracks()
    t = t[~((t["tid"] == 2) & (t["frame"] == 10))]
    assert judge([(1, B), (2, A)], rules, t)[1][0][4] == "not_closed"


@pytest.mark.parametrize("after", [[(1, B), (2, A)], [(1, A), (2, B)]])
def test_tables(spark, after):
    ship(spark)
    t = spark.createDataFrame(tracks())
    g = spark.createDataFrame([tuple(x) for x in frags(after).itertuples(index=False)], "video string, tid bigint, start_frame bigint, end_frame bigint, centroid array<double>")
    out = resolver.resolve(t, g).collect()
    assert len(out) == 40 and any(x.resolved != x.tid for x in out) == (after[0][1] == B)
    log = resolver.decisions(t, g).collect()
    assert log[0].decision == ("swap" if after[0][1] == B else "identity")
    assert resolver.decisions(t.limit(0), g.limit(0)).count() == 0
    assert resolver.resolve(t, g.limit(0)).count() == 40


def crowd(gap=(), filled=()):
    """Five in a row that touch their neighbours from frame 6 to 12; who is in gap is missing at frame 9."""
    rows = []
    for f in range(20):
        step = 10.0 if 6 <= f <= 12 else 60.0
        rows += [("v", i, f, 100.0 + step * i, 50.0, 14.0 - 0.5 * i, 6.0, 90.0, i in filled and f == 9) for i in range(1, 6) if not (i in gap and f == 9)]
    return pd.DataFrame(rows, columns=["video", "tid", "frame", *resolver.BOX, "filled"])


def crowd_frags(order):
    at = {i: [20.0 * i, 0.0] for i in range(1, 6)}
    rows = [("v", i, 0, 5, at[i]) for i in at] + [("v", i, 14, 18, at[j]) for i, j in zip(at, order)]
    g = pd.DataFrame(rows, columns=["video", "tid", "start_frame", "end_frame", "centroid"])
    g["centroid"] = [np.array(c) for c in g["centroid"]]
    return g


def test_large_contacts_are_judged_in_pieces():
    rules = resolver.Rules()
    t, log = resolver.resolve_video(crowd(), crowd_frags([1, 2, 3, 4, 5]), rules)
    assert [(x[2], x[3], x[4]) for x in log] == [("1,2,3,4,5", "abstain", "no_trigger")] and (t["id"] == t["tid"]).all()
    # 4 touches 3 and 5; it was made up at frame 9, and 4 and 5 changed places
    t, log = resolver.resolve_video(crowd(filled={4}), crowd_frags([1, 2, 3, 5, 4]), rules)
    assert ("3,4,5", "swap") in [(x[2], x[3]) for x in log]
    last = t[t["frame"] == 19].set_index("tid")["id"]
    assert last.to_dict() == {1: 1, 2: 2, 3: 3, 4: 5, 5: 4}
    # whoever comes back is a centre too
    _, log = resolver.resolve_video(crowd(gap={2}), crowd_frags([1, 2, 3, 4, 5]), rules)
    assert ("1,2,3", "identity") in [(x[2], x[3]) for x in log]
    _, log = resolver.resolve_video(crowd(filled={4}), crowd_frags([1, 2, 3, 5, 4]), resolver.Rules(roster=5))
    assert [(x[2], x[3]) for x in log][0] == ("1,2,3,4,5", "swap")


@pytest.mark.parametrize("rebuilds", [20, 3, 0])
def test_all_of_twentyfive_changes_are_made(rebuilds):
    """Two that meet again and again and change places each time."""
    rows, marks = [], []
    for k in range(25):
        for f in range(20):
            apart = max(abs(f - 10) * 6 - 6, 2)
            rows += [("v", 1, 20 * k + f, 100.0 - apart, 50.0, 12.0, 6.0, 90.0), ("v", 2, 20 * k + f, 100.0 + apart, 50.0, 12.0, 6.0, 90.0)]
    for k in range(26):
        at = (A, B) if k % 2 == 0 else (B, A)
        lo, hi = (0, 5) if k == 0 else (20 * k - 6, 20 * k - 2) if k == 25 else (20 * k - 6, 20 * k + 5)
        marks += [("v", 1, lo, hi, np.array(at[0])), ("v", 2, lo, hi, np.array(at[1]))]
    t = pd.DataFrame(rows, columns=["video", "tid", "frame", *resolver.BOX])
    g = pd.DataFrame(marks, columns=["video", "tid", "start_frame", "end_frame", "centroid"])
    got, log = resolver.resolve_video(t, g, resolver.Rules(rebuilds=rebuilds))
    swaps = [x for x in log if x[3] == "swap"]
    assert len(swaps) == 25 and {x[0] // 20 for x in swaps} == set(range(25))
    # looks are what is followed: after each contact the ids stand where the looks are
    for k in range(25):
        row = got[(got["frame"] == 20 * k + 19) & (got["tid"] == 1)].iloc[0]
        assert row["id"] == (1 if k % 2 else 2)
