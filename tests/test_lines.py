"""Numbers of rows in any number of splits."""

import pytest

from trajectorium.sources import lines, tables


@pytest.fixture(params=["100000000", "150"])
def split(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if request.param == "150" else before[1])
    yield request.param != "100000000"
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path, split):
    made = []
    for k, n in enumerate((300, 1, 0, 250)):
        own = [f"{k},{i}" for i in range(n)]
        (tmp_path / f"part-{k}.csv").write_text("".join(x + "\n" for x in ["a,b", *own]))
        made += own
    found = lines.numbered(spark, str(tmp_path), 1)
    assert [r["value"] for r in found.orderBy("row").collect()] == made
    assert sorted(r["row"] for r in found.collect()) == list(range(len(made)))
    assert (found.select("file", "split").distinct().count() > 10) == split
    assert lines.numbered(spark, str(tmp_path), 2, every=False).count() == len(made) + 4 - 2
    assert lines.top(spark, str(tmp_path), 2) == ["a,b", "0,0"]


def test_centroids_and_poses_in_splits(spark, tmp_path, split):
    body = [f"{i * 0.5},{i},,{i}" for i in range(200)]
    (tmp_path / "c.csv").write_text("\n".join(["x0,y0,x1,y1", *body]) + "\n")
    found = tables.read_centroids(spark, str(tmp_path / "c.csv")).orderBy("frame").collect()
    assert [(r["frame"], r["tid"], r["x"], r["y"]) for r in found] == [(i, 0, i * 0.5, float(i)) for i in range(200)]
    head = ["scorer,,,s,s,s", "bodyparts,,,nose,nose,nose", "coords,,,x,y,likelihood"]
    (tmp_path / "p.csv").write_text("\n".join([*head, *(f"labeled-data,v,img{i}.png,{i},{i + 1},0.5" for i in range(200))]) + "\n")
    found = tables.read_headed_pose(spark, str(tmp_path / "p.csv")).orderBy("frame").collect()
    assert [(r["frame"], r["point"], r["x"], r["y"]) for r in found] == [(i, "nose", float(i), i + 1.0) for i in range(200)]


def test_a_row_out_of_order_is_an_error(spark, tmp_path, split):
    good = [f"{2 * i},v{i}" for i in range(300)]
    path = str(tmp_path / "a.csv")

    def written(rows):
        (tmp_path / "a.csv").write_text("\n".join(["position,name", *rows]) + "\n")
        return lines.ordered(spark, path, "position")

    assert [tuple(r) for r in written(good).orderBy("row").collect()] == [(i, str(2 * i), f"v{i}") for i in range(300)]
    for rows in ([*good[:100], "5,late", *good[100:]], [*good[:50], good[49], *good[50:]], [*good[:30], "x,none", *good[30:]]):
        with pytest.raises(Exception, match="position"):
            written(rows).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("frame,n\n")
    assert lines.numbered(spark, str(tmp_path / "a.csv"), 1).count() == 0
    assert lines.ordered(spark, str(tmp_path / "b.csv"), "frame").count() == 0
