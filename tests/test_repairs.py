"""Flip repair and result rescue on hand-made cases."""

import numpy as np

from trajectorium.operators import headings, matching
from trajectorium.session import ship
from trajectorium.operators import episodes


def test_short_runs_turn_and_anchors_stay():
    f = np.arange(12)
    h = np.full(12, 90.0)
    h[5:7] = 270.0
    assert headings.repaired(f, h, 5).tolist() == [90.0] * 12
    assert headings.repaired(f, h, 2).tolist() == h.tolist()  # the run is an anchor itself
    h[5:7] = 180.0  # 90 degrees away: ambiguous
    assert headings.repaired(f, h, 5).tolist() == h.tolist()
    gap = np.array([0, 1, 2, 3, 4, 8, 9])
    h = np.array([90.0] * 5 + [270.0] * 2)
    assert headings.repaired(gap, h, 5).tolist() == h.tolist()
    two = np.array([90.0] * 5 + [270.0, 90.0, 270.0])
    assert headings.repaired(np.arange(8), two, 5).tolist() == [90.0] * 8
    assert headings.repaired(np.zeros(0, int), np.zeros(0), 5).tolist() == []


def test_repair_of_a_table(spark):
    ship(spark)
    t = spark.createDataFrame([(1, f, 270.0 if f == 6 else 90.0) for f in range(12)] + [(2, 0, None)], "tid bigint, frame bigint, heading double")
    out = headings.repair_flips(t).collect()
    assert len(out) == 12 and {x.heading for x in out} == {90.0} and [x.frame for x in out if x.turned] == [6]


def test_rescue_names_the_first_rule_that_fails(spark):
    ship(spark)
    cols = "frame bigint, event_id bigint, cx double, cy double, w double, h double, heading double"
    blobs = [(0, 1, 50.0, 50.0, 20.0, 8.0, 0.0), (0, 2, 150.0, 50.0, 20.0, 8.0, 0.0), (0, 3, 250.0, 50.0, 20.0, 8.0, 0.0), (0, 4, 350.0, 50.0, 10.0, 10.0, 0.0), (1, 5, 50.0, 50.0, 20.0, 8.0, 0.0), (0, 6, 450.0, 50.0, 20.0, 8.0, 0.0), (0, 7, 550.0, 50.0, 20.0, 8.0, 0.0)]
    results = [(0, 1, 50.5, 50.0, 20.0, 8.0, 180.0), (0, 3, 250.0, 50.0, 20.0, 8.0, 90.0), (0, 4, 350.0, 50.0, 10.0, 10.0, 0.0), (0, 6, 450.0, 50.0, 40.0, 12.0, 0.0), (0, 7, 550.0, 50.0, 20.0, 8.0, 0.0), (0, 8, 551.0, 50.0, 20.0, 8.0, 0.0)]
    out = {x.event_id: x.reason for x in matching.rescued(spark.createDataFrame(blobs, cols), spark.createDataFrame(results, cols), 60.0).collect()}
    assert out == {1: "rescued", 2: "no_matching_obb", 3: "insufficient_blob_coverage", 4: "axis_ambiguous", 5: "no_result_frame", 6: "obb_size_mismatch", 7: "multiple_result_obbs"}


def test_seams_prefer_filled_frames_then_overlap_then_the_middle(spark):
    cell = "episode bigint, tid bigint, frame bigint, filled boolean, iou double"
    rows = [(1, 1, 3, False, 0.9), (1, 1, 4, True, 0.2), (1, 1, 5, True, 0.2), (1, 2, 5, False, 0.3), (2, 1, 2, False, 0.0), (2, 2, 9, True, None), (3, 1, 1, False, 0.0), (3, 2, 9, False, 0.4)]
    out = {x.episode: x.seam for x in episodes.seams(spark.createDataFrame(rows, cell), ["episode"]).collect()}
    assert out == {1: 4, 2: 5, 3: 5}
