import pandas as pd
import pytest

from trajectorium.operators import matching
from trajectorium.session import ship
from trajectorium.sources import tables
from trajectorium.streaming import tracker


def test_result_round_trip(spark, tmp_path):
    rows = [(0, 0, 1.0, 2.0, 4.0, 2.0, 370.0), (0, 1, 5.0, 6.0, 4.0, 2.0, 0.0), (2, 1, 7.0, 8.0, 4.0, 2.0, 90.0)]
    df = spark.createDataFrame(rows, "frame bigint, tid bigint, cx double, cy double, w double, h double, heading double")
    tables.write_result(df, str(tmp_path / "out"), [0, 1])
    assert tables.sniff(spark, str(tmp_path / "out")) == "result"
    got = sorted(tuple(r[c] for c in ("frame", "tid", "cx", "cy", "w", "h", "heading")) for r in tables.read(spark, str(tmp_path / "out")).collect())
    assert got == [(0, 0, 1.0, 2.0, 4.0, 2.0, 10.0), *rows[1:]]


def test_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame,cx0,cy0,w0,h0\n0,1,1,2,1\n0,1,1,2,1\n1.5,1,1,2,1\n3,x,1,2,1\n4,1,1,0,1\n")
    with pytest.raises(ValueError):
        tables.read_result(spark, str(tmp_path / "a.csv"))
    assert tables.read_result(spark, str(tmp_path / "a.csv"), strict=False).count() == 2


def test_pose(spark, tmp_path):
    (tmp_path / "p.csv").write_text("track,frame_idx,nose.x,nose.y\ntrack_3,7,1.5,bad\n")
    assert [tuple(r) for r in tables.read(spark, str(tmp_path / "p.csv")).collect()] == [(7, 3, "nose", 1.5, None)]


def test_min_cost_is_least():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in matching.min_cost(c, np.ones((n, m), bool)))
        k = c if n <= m else c.T
        assert abs(got - min(sum(k[i, p[i]] for i in range(len(k))) for p in itertools.permutations(range(k.shape[1]), len(k)))) < 1e-9


def test_tracker_batch_equals_stream(spark, tmp_path):
    ship(spark)
    rows = [("v", f, d, 10.0 * d + f * 0.5, 5.0, 8.0, 8.0) for f in range(6) for d in range(3)]
    pdf = pd.DataFrame(rows, columns=["video", "frame", "det", "cx", "cy", "w", "h"])
    schema = "video string, frame bigint, det bigint, cx double, cy double, w double, h double"
    batch = sorted(map(tuple, tracker.track(spark.createDataFrame(pdf, schema)).collect()))
    assert {(d, t) for _, _, d, t in batch} == {(0, 0), (1, 1), (2, 2)}
    for k in (0, 1):
        spark.createDataFrame(pdf[pdf["frame"] // 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = tracker.track_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch
