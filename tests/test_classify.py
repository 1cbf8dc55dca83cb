import math

from trajectorium.operators import classify

SCHEMA = "blob_index int, pickle_outlier boolean, mask_only boolean, restored boolean, exclusion string, obb_count int, aspect double, area double, bbox_area double, w double, h double, major double"


def blobs(spark, *rows):
    return spark.createDataFrame([(k, *r, 10.0 + k, 20.0, 5.0, 4.0, None) for k, r in enumerate(rows)], SCHEMA)


def test_reasons_in_order(spark):
    rows = [(True, True, True, "manual", 3, 1.0), (False, None, None, None, 1, 1.1), (None, None, None, "other", 2, None), (False, False, False, "result_multiple", 0, float("nan")), (False, False, True, None, None, 1.09)]
    df = blobs(spark, *rows)
    said = lambda **o: [r["reasons"] for r in classify.stage_one(df, **o).orderBy("blob_index").collect()]
    assert said(guided=True) == [[classify.OUTLIER, classify.FRAGMENT, classify.RESTORED, "segmentation_manual", classify.LOW_ASPECT], [], [classify.MULTIPLE], [classify.MULTIPLE], [classify.RESTORED, classify.LOW_ASPECT]]
    assert said()[2:4] == [[], []]
    one = classify.bounds(df).first()
    assert (one["area_lo"], one["area_hi"], one["obb_major_axis_lo"]) == (11.0, 14.0, 0.0)
    none = classify.bounds(df.limit(0)).first()
    assert none["w_lo"] == -math.inf and none["w_hi"] == math.inf
    found = {r["metric"]: r["value"] for r in classify.summary(classify.stage_one(df, guided=True)).collect()}
    assert found["blobs"] == 5 and found["erased"] == 4 and found[classify.LOW_ASPECT] == 2 and found["area_hi"] == 14
    assert len(classify.COLUMNS) == len(set(classify.COLUMNS)) == 53
