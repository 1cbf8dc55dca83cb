"""Streams against tables: the same rows in micro-batches of any size, with a restart between them."""

import datetime
import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajectorium.operators import matching
from trajectorium.session import ship
from trajectorium.streaming import live, staged

SCHEMA = "video string, frame bigint, det bigint, score double, cx double, cy double, w double, h double, heading double, ts timestamp, key string"
BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def rows():
    """Three videos of a few animals that wander, vanish, leap and turn."""
    rng = random.Random(8)
    out = []
    for v in range(3):
        at = [(60.0 * k, 40.0 * k, rng.choice([0.0, 90.0, 180.0])) for k in range(3)]
        for f in range(70):
            for k, (x, y, a) in enumerate(at):
                at[k] = (x + rng.uniform(-2, 3), y + rng.uniform(-2, 2), a)
                if rng.random() < 0.08 or (v == 1 and 30 <= f < 38 and k == 1):
                    continue
                leap = 24.0 if rng.random() < 0.05 else 0.0
                turned = 180.0 if rng.random() < 0.08 else 0.0
                out.append((f"v{v}", f, 1000 * v + 3 * f + k, 0.9 - 0.1 * k, x + leap, y, 20.0, 8.0, (a + turned) % 360, BEGIN + datetime.timedelta(seconds=f), f"v{v}-{k}"))
    return out


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)
    return spark.createDataFrame(rows(), SCHEMA)


def streamed(spark, tmp_path, table, make, cuts):
    """make over the stream of the frames up to each cut, a query of its own for each, from one checkpoint; at the end a late key lets the watermark pass."""
    last = 0
    for k, cut in enumerate([*cuts, 10_000]):
        part = table.where((F.col("frame") >= last) & (F.col("frame") < cut))
        if cut == 10_000:
            end = spark.createDataFrame([("end", f, 10**6 + f, 0.9, 1.0, 1.0, 2.0, 1.0, 0.0, BEGIN + datetime.timedelta(days=1 + f), "end") for f in range(2)], SCHEMA)
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            end.where("frame = 0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run(spark, tmp_path, table, make)
            end.where("frame = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        else:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path, table, make)
        last = cut
    found = spark.read.parquet(f"{tmp_path}/out")
    return found.where(F.col(found.columns[0]) != "end")


def run(spark, tmp_path, table, make):
    source = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def shape(df):
    return sorted((r["video"], r["frame"], r["tid"], r["det"], r["stage"], None if r["heading"] is None or r["heading"] != r["heading"] else round(r["heading"], 6)) for r in df.collect())


@pytest.mark.parametrize("cuts", [[], [1, 2, 33, 34, 60]])
def test_population(spark, tmp_path, table, cuts):
    found = streamed(spark, tmp_path, table, lambda s: live.population_stream(s, 3), cuts)
    wanted = []
    for v, pdf in table.drop("ts").toPandas().groupby("video"):
        nth = [f for f, own in pdf.groupby("frame") if live.Begins(3, 0.5)(own.sort_values("score", ascending=False))]
        tracks = staged.one_pass(pdf, list(range(min(nth), int(pdf["frame"].max()) + 1)), 3, staged.Limits())
        wanted += [(v, r[0], r[1], int(r[2]), r[3], None if r[-1] != r[-1] else round(float(r[-1]), 6)) for t in tracks for r in t.rows]
    assert shape(found) == sorted(wanted) and len(wanted) > 400


def test_variable(spark, tmp_path, table):
    limits = staged.Limits(max_age=4)
    policy = staged.Policy(limits, 400.0, 300.0, 20.0, 2, 4)
    found = streamed(spark, tmp_path, table, lambda s: live.variable_stream(s, policy), [5, 6, 40])
    wanted = staged.track_variable(table, limits, 400.0, 300.0, 20.0, 2, 4)
    assert shape(found) == shape(wanted) and wanted.count() > 300


def test_static_windows(spark, tmp_path, table):
    found = streamed(spark, tmp_path, table, lambda s: live.static_stream(s, 6, 0.6, 0.1, 0.6), [3, 20, 21])
    wanted = staged.static_windows(table, ["key"], 6, 0.6, 0.1, 0.6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() > 50


def test_links(spark, tmp_path, table):
    found = streamed(spark, tmp_path, table, live.links_stream, [3, 20, 21])
    wanted = matching.temporal_edges(table.select((F.substring("video", 2, 1).cast("long") * 1000 + F.col("frame")).alias("frame"), F.col("det").alias("event_id"), "cx", "cy", "w", "h"))
    key = lambda r: (r["parent"], r["child"], round(r["overlap"], 6))
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.collect())) and wanted.count() > 300


def test_stream_query_equals_the_table(spark):
    from trajectorium import catalog

    sf = "/root/testdata/sf0.001"
    found, wanted = (sorted(map(tuple, catalog.queries()[q](spark, sf).select("tid", "frame").collect())) for q in ("t06_static_stream", "w19_static_windows"))
    assert found == wanted and found


def test_still_takes_a_call_at_once(monkeypatch):
    """Two messages to the state and no timer a call (failed before), and plain numbers decide as arrays do."""

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    rng = np.random.default_rng(5)
    for window in (2, 5, 6):
        frames = np.flatnonzero(rng.random(300) < 0.9)
        box = np.column_stack([rng.normal(50, 0.5, (len(frames), 2)).round(1), rng.integers(0, 6, (len(frames), 2))])
        box[rng.random(len(frames)) < 0.02, 0] = np.nan
        rows = pd.DataFrame(dict(zip(("key", "frame", *live.staged.VALUES[:4]), ("k", frames, *box.T)))).assign(ts=pd.Timestamp("2024-01-01"))
        given = []
        for few in (0, 32):
            monkeypatch.setattr(live, "_FEW", few)
            follower = live.Follower(lambda: live.Still(window, 0.7, 0.3, 0.4), ["key", "frame"], timedelta(minutes=1))  # noqa: B023
            follower.held, follower.handle = State(), None
            found = [f for k in range(0, len(rows), 60) for t in follower.handleInputRows(("k",), iter([rows.iloc[k : k + 60].sample(frac=1, random_state=1)]), None) for f in t["frame"]]
            assert follower.held.calls == 2 * -(-len(rows) // 60)
            given.append(found)
        machine = live.Still(window, 0.7, 0.3, 0.4)
        for f, own in rows.groupby("frame"):
            machine.step(int(f), own)
        assert given[0] == given[1] == [f for (f,) in machine.final()] and given[0]
