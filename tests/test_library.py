import itertools
import random

import numpy as np
import pytest

from trajectorium.functions import codes, fitting
from trajectorium.operators import identity, matching, reshape, sampling
from trajectorium.sources import config, tables


def test_codes(spark):
    rows = {r["code"]: r for r in codes.described(spark.createDataFrame([(k,) for k in (0, 1, 2, 5, 26, 35, None)], "code bigint")).collect()}
    assert (rows[0]["short"], rows[26]["short"], rows[35]["place"], rows[5]["label"], rows[None]["label"]) == ("S0", "C3-EMBED-IDENTITY", len(codes.CODES) - 1, None, None)
    assert [rows[k]["refined"] for k in (0, 1, 2, 26)] == [False, False, True, True]


def test_in_runs_equals_all_pairs(spark):
    rng = random.Random(3)
    runs = []
    for key in ("a", "b", None):
        at = 0
        for k in range(12):
            start = at + rng.randint(0, 3)
            at = start + rng.randint(1, 5)
            runs.append((key, start, at - 1, k))
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(-2, 60), k) for k in range(200)]
    found = matching.in_runs(spark.createDataFrame(rows, "tid string, frame int, n int"), spark.createDataFrame(runs, "tid string, start_frame int, end_frame int, island int"), ["tid"])
    assert sorted(map(tuple, found.select("n", "run_id").collect())) == sorted((n, i) for t, f, n in rows for u, s, e, i in runs if t is not None and t == u and s <= f <= e)
    both = spark.createDataFrame([("a", 0, 9, 0), ("a", 5, 6, 1)], "tid string, start_frame int, end_frame int, island int")
    one = spark.createDataFrame([("a", 8)], "tid string, frame int")
    assert [r["run_id"] for r in matching.in_runs(one, both, ["tid"]).collect()] == [0]
    with pytest.raises(Exception, match="two runs"):
        matching.in_runs(spark.createDataFrame([("a", 5)], "tid string, frame int"), both, ["tid"]).collect()


def test_last_before_equals_all_pairs(spark):
    rng = random.Random(5)
    frags = [(k, rng.choice(["x", "y", None]), rng.randint(0, 30)) for k in range(60)]
    left = [(k, rng.choice(["x", "y", "z", None]), rng.randint(0, 35)) for k in range(60)] + [(7, "x", 9)] * 2
    found = matching.last_before(spark.createDataFrame(left, "n int, obj string, at int"), spark.createDataFrame(frags, "frag_id int, obj string, end_frame int"), "obj", "at")
    want = [(n, o, a, max(((e, f) for f, p, e in frags if o is not None and p == o and e < a), default=(None, None))[1]) for n, o, a in left]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_reachable_split_equals_all_subsets():
    rng = random.Random(7)
    for _ in range(60):
        groups = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        sizes = {s: groups.count(s) for s in groups}
        sums = {sum(c) for k in range(len(groups) + 1) for c in itertools.combinations(groups, k)}
        target = rng.randint(0, sum(groups) + 3)
        total = lambda t: sum(s * n for s, n in t.items())
        taken = sampling.reachable_split(sizes, target)
        assert total(taken) == min(sums, key=lambda x: (abs(x - target), -x)) and all(0 <= taken[s] <= sizes[s] for s in sizes)
        low = rng.randint(0, sum(groups))
        high = low + rng.randint(0, 4)
        inside = sorted(x for x in sums if low <= x <= high)
        if inside:
            assert total(sampling.reachable_split(sizes, target, low, high)) == (target if target in inside else inside[0])
        else:
            with pytest.raises(ValueError):
                sampling.reachable_split(sizes, target, low, high)


def test_connected_assignment_equals_all_orders():
    rng = np.random.default_rng(1)
    for _ in range(80):
        n, m = rng.integers(1, 6, 2).tolist()
        cost, valid = rng.uniform(0, 10, (n, m)), rng.random((n, m)) < 0.4
        found = matching.min_cost(cost, valid)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found) and all(valid[i, j] for i, j in found)
        best = (0, 0.0)
        for p in itertools.permutations(range(max(n, m)), n):
            pairs = [(i, j) for i, j in enumerate(p) if j < m and valid[i, j]]
            best = min(best, (-len(pairs), sum(cost[i, j] for i, j in pairs)))
        assert len(found) == -best[0] and abs(sum(cost[i, j] for i, j in found) - best[1]) < 1e-9


def test_fitted_boxes(spark):
    rng = np.random.default_rng(2)
    clouds = [rng.standard_normal((30, 2)) @ np.diag([5, 1]) @ np.linalg.qr(rng.standard_normal((2, 2)))[0] + 3 for _ in range(6)]
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    rows = [(0, k, [{"x": float(x), "y": float(y)} for x, y in c]) for k, c in enumerate([*clouds, square])]
    df = spark.createDataFrame(rows, "frame int, blob_index int, points array<struct<x:double,y:double>>")
    found = {r["blob_index"]: r for r in fitting.fitted(df).collect()}
    for k, c in enumerate(clouds):
        values, vectors = np.linalg.eigh(np.cov(c.T, bias=True))
        axis = vectors[:, -1] * (1 if vectors[0, -1] >= 0 else -1)
        along, across = (c - c.mean(0)) @ axis, (c - c.mean(0)) @ np.array([-axis[1], axis[0]])
        centre = c.mean(0) + axis * (along.max() + along.min()) / 2 + np.array([-axis[1], axis[0]]) * (across.max() + across.min()) / 2
        assert np.allclose([found[k][v] for v in ("cx", "cy", "w", "h", "angle")], [*centre, np.ptp(along), np.ptp(across), np.degrees(np.arctan2(axis[1], axis[0]))])
    assert np.allclose([found[6][v] for v in ("cx", "cy", "w", "h")], [1, 1, 2, 2])
    least = {r["blob_index"]: r for r in fitting.fitted(df, mode="min_area").collect()}
    for k, c in enumerate(clouds):
        areas = [np.prod(np.ptp(c @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), axis=0)) for a in np.linspace(0, np.pi / 2, 5000)]
        assert least[k]["w"] * least[k]["h"] <= min(areas) + 1e-9 and least[k]["w"] * least[k]["h"] >= min(areas) * 0.995
    with pytest.raises(Exception, match="three points"):
        fitting.fitted(spark.createDataFrame([(0, 0, [{"x": 1.0, "y": 2.0}])], df.schema)).collect()


def test_roster_decisions_equal_all_orders(spark):
    rng = np.random.default_rng(4)
    rows, want = [(900, 1, [[1.0]]), (901, 4, np.ones((4, 4)).tolist()), (902, 2, [[1.0, None], [2.0, 3.0]])], {900: "roster_invalid", 901: "roster_invalid", 902: "centroid_missing"}
    for k in range(120):
        n = int(rng.integers(2, 4))
        c = np.round(rng.uniform(0, 12, (n, n)) * rng.choice([0.2, 1.0], (n, n)), 2)
        rows.append((k, n, c.tolist()))
        orders = sorted((sum(c[i, j] for i, j in enumerate(p)), x, p) for x, p in enumerate(itertools.permutations(range(n))))
        (best, at, p), identity_cost = orders[0], float(np.trace(c))
        if at:
            want[k] = "swap" if best <= 0.5 * min(identity_cost, orders[1][0]) else "gate_cost_ratio"
        else:
            want[k] = "identity" if max(c[i, i] for i in range(n)) < 5 else "gate_abs_dist"
    found = identity.roster_decision(spark.createDataFrame(rows, "key int, n int, cost array<array<double>>")).collect()
    assert {r["key"]: r["decision"] for r in found} == want and set(want.values()) == {"roster_invalid", "centroid_missing", "swap", "gate_cost_ratio", "identity", "gate_abs_dist"}
    assert all(sorted(r["mapping"]) == list(range(len(r["mapping"]))) and (r["decision"] == "swap") == (r["mapping"] != sorted(r["mapping"])) for r in found)


def test_settings():
    assert config.checkpoints("3, best,,3,last") == ["epoch3", "best", "last"] and config.checkpoints(2.0) == ["epoch2"] and config.checkpoints([1, "2"]) == ["epoch1", "epoch2"]
    assert config.rates("0.1, 0.01,0.1") == [0.1, 0.01] and config.rates([1.0], most=1.0) == [1.0]
    for bad in (lambda: config.checkpoints(0), lambda: config.checkpoints(True), lambda: config.checkpoints(""), lambda: config.checkpoints(1.5), lambda: config.rates("0"), lambda: config.rates(2, most=1.0), lambda: config.rates(None)):
        with pytest.raises(ValueError):
            bad()
    found = config.resolved({"SESSION_PATH": "/s", "VIDEO": "a\\b.mp4", "OTHER": "/x", "DIRS": ["c", "/d"], "EMPTY": ""}, ["VIDEO", "OTHER", "EMPTY"], ["DIRS"])
    assert found == {"SESSION_PATH": "/s", "VIDEO": "/s/a/b.mp4", "OTHER": "/x", "DIRS": ["/s/c", "/d"], "EMPTY": ""}


def test_headed_pose_without_individuals(spark, tmp_path):
    (tmp_path / "p.csv").write_text("scorer,,,s,s,s\nbodyparts,,,nose,nose,nose\ncoords,,,x,y,likelihood\nlabeled-data,v,img7.png,1,2,0.5\nlabeled-data,v,img9.png,,4,0.6\n")
    found = tables.read_headed_pose(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in found] == [(0, None, "nose", 1.0, 2.0, 0.5), (1, None, "nose", None, 4.0, 0.6)]


def test_corner_table_and_dense(spark):
    rows = [(0, 0, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0), (7.0, 8.0)], 90.0), (2, 1, [(0.0, 0.0)] * 4, 10.0)]
    df = spark.createDataFrame(rows, "frame long, tid long, corners array<struct<x:double,y:double>>, heading double")
    wide = {r["position"]: r for r in reshape.corner_table(df, [0, 1]).collect()}
    assert (wide[0]["x20"], wide[0]["y30"], wide[0]["c0"], wide[0]["x01"], wide[2]["c1"]) == (5.0, 8.0, 90.0, None, 10.0)
    assert sorted(map(tuple, reshape.dense(df.select("tid", "frame"), by=["tid"]).collect())) == [(0, 0), (1, 0), (1, 1), (1, 2)]
