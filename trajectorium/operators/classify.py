"""The first classification of blobs: why one is erased, bounds of those that aren't, and the table of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are listed.
OUTLIER, FRAGMENT, RESTORED, MULTIPLE, LOW_ASPECT = "pickle_outlier", "segmentation_fragment", "segmentation_source_restored", "segmentation_result_multiple", "low_obb_aspect"
#: Exclusions of a segmentation guided by a result that erase a blob under their own name.
EXCLUSIONS = ["manual", "synthetic", "result_multiple"]
#: Names of the eight direction classes.
DIRECTIONS = ["upper", "upper_right", "right", "lower_right", "lower", "lower_left", "left", "upper_left"]
#: What has bounds, by the name of its columns in the table.
BOUNDED = {"area": "area", "bbox": "bbox_area", "w": "w", "h": "h", "obb_major_axis": "major"}
#: The table's columns, in order.
COLUMNS = (
    "frame blob_index rect_x rect_y rect_w rect_h center_x center_y area bbox_area pickle_outlier area_outlier bbox_area_outlier width_outlier height_outlier "
    "obb_major_axis_len obb_major_axis_outlier obb_aspect_ratio min_obb_aspect_ratio low_obb_aspect_outlier individual_distance_px jump_threshold_px init_max_dist_px "
    "traj_max_dist_px direction_min_total_disp_threshold_px jump_distance_px jump_outlier erase_stage1 erase_stage1_reasons traj_id erase_pre_direction "
    "erase_pre_direction_reasons class_id direction_name direction_dx direction_dy axis_length head_angle_deg erase_final erase_final_reasons direction_failure_reasons "
    "area_lo area_hi bbox_lo bbox_hi w_lo w_hi h_lo h_hi obb_major_axis_lo obb_major_axis_hi jump_lo jump_hi"
).split()


def reasons(least_aspect: float, guided: bool) -> Column:
    """The reasons of a blob's row (see stage_one) as an array, in order; none: an empty one."""
    exclusion, on = F.coalesce("exclusion", F.lit("")), F.lit(guided)
    by_name = on & exclusion.isin(EXCLUSIONS)
    several = on & ~exclusion.isin(EXCLUSIONS) & (F.coalesce("obb_count", F.lit(0)) > 1)
    aspect = F.col("aspect").isNotNull() & ~F.isnan("aspect") & (F.col("aspect") < least_aspect)
    each = [
        F.when(F.col("pickle_outlier"), OUTLIER), F.when(F.col("mask_only"), FRAGMENT), F.when(F.col("restored"), RESTORED),
        F.when(by_name, F.concat(F.lit("segmentation_"), exclusion)).when(several, MULTIPLE), F.when(aspect, LOW_ASPECT),
    ]
    return F.array_compact(F.array(*each))


def stage_one(blobs: DataFrame, least_aspect: float = 1.1, guided: bool = False) -> DataFrame:
    """blobs with reasons (array), erased (there is one) and low_aspect. blobs: pickle_outlier, mask_only, restored (null: no), exclusion, obb_count, aspect; guided: a result's boxes led the segmentation, so exclusions count."""
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("pickle_outlier", "mask_only", "restored")}
    rows = blobs.withColumns(flags).withColumn("reasons", reasons(least_aspect, guided))
    return rows.withColumns({"erased": F.size("reasons") > 0, "low_aspect": F.array_contains("reasons", LOW_ASPECT)})


def bounds(blobs: DataFrame) -> DataFrame:
    """One row: <name>_lo and <name>_hi of BOUNDED, the least and most over blobs that are neither outliers of the segmentation nor fragments; infinite where there is none."""
    some = blobs.where(~F.coalesce("pickle_outlier", F.lit(False)) & ~F.coalesce("mask_only", F.lit(False)))
    inf = float("inf")
    end = lambda f, c, k, none: F.coalesce(f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(none)).alias(k)
    return some.agg(*[x for k, c in BOUNDED.items() for x in (end(F.min, c, f"{k}_lo", -inf), end(F.max, c, f"{k}_hi", inf))])


def summary(blobs: DataFrame) -> DataFrame:
    """metric, value: blobs, those erased, those with each reason, and the bounds. blobs: see stage_one, which has been applied."""
    names = [OUTLIER, FRAGMENT, RESTORED, *(f"segmentation_{e}" for e in EXCLUSIONS), LOW_ASPECT]
    counts = blobs.agg(F.count("*").alias("blobs"), F.count_if("erased").alias("erased"), *[F.count_if(F.array_contains("reasons", n)).alias(n) for n in dict.fromkeys(names)])
    both = counts.crossJoin(bounds(blobs))  # two rows of one each
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in both.columns])).alias("m")).select("m.*")


def table(blobs: DataFrame, distance: float, ratios: dict[str, float], least_aspect: float = 1.1) -> DataFrame:
    """COLUMNS, one row for each blob; flags are 0 or 1, reasons joined by a bar, an id that lacks is -1.

    blobs: frame, blob_index, x, y, w, h, cx, cy, area, bbox_area, major, aspect and
    what stage_one gives; later stages' columns where they are there: jump,
    jump_outlier, traj_id, pre_reasons, final_reasons, failures (arrays), class_id, dx,
    dy, axis_length. distance: of an individual from frame to frame; ratios: jump,
    init, traj and disp, as parts of it. The bounds are one row, joined to all.
    """
    have = set(blobs.columns)
    own = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(own(c, "int"), F.lit(0))
    why = lambda c: F.coalesce(F.col(c) if c in have else F.col("reasons"), F.array().cast("array<string>"))
    failures = F.coalesce(F.col("failures"), F.array().cast("array<string>")) if "failures" in have else F.array().cast("array<string>")
    angle = F.pmod(F.degrees(F.atan2(own("dx", "double"), -own("dy", "double"))), F.lit(360.0))
    names = F.array(*[F.lit(n) for n in DIRECTIONS])
    joined = lambda a: F.array_join(a, "|")
    erased = lambda a: (F.size(a) > 0).cast("int")
    scaled = lambda k: F.lit(float(distance * ratios[k]))
    value = {
        "frame": F.col("frame"), "blob_index": F.col("blob_index"), "rect_x": F.col("x"), "rect_y": F.col("y"), "rect_w": F.col("w"), "rect_h": F.col("h"), "center_x": F.col("cx"), "center_y": F.col("cy"), "area": F.col("area"), "bbox_area": F.col("bbox_area"),
        "pickle_outlier": flag("pickle_outlier"), **{f"{c}_outlier": F.lit(0) for c in ("area", "bbox_area", "width", "height", "obb_major_axis")}, "obb_major_axis_len": own("major", "double"),
        "obb_aspect_ratio": own("aspect", "double"), "min_obb_aspect_ratio": F.lit(float(least_aspect)), "low_obb_aspect_outlier": flag("low_aspect"),
        "individual_distance_px": F.lit(float(distance)), "jump_threshold_px": scaled("jump"), "init_max_dist_px": scaled("init"), "traj_max_dist_px": scaled("traj"), "direction_min_total_disp_threshold_px": scaled("disp"),
        "jump_distance_px": own("jump", "double"), "jump_outlier": flag("jump_outlier"), "erase_stage1": erased(F.col("reasons")), "erase_stage1_reasons": joined(F.col("reasons")), "traj_id": F.coalesce(own("traj_id", "bigint"), F.lit(-1)),
        "erase_pre_direction": erased(why("pre_reasons")), "erase_pre_direction_reasons": joined(why("pre_reasons")), "class_id": F.coalesce(own("class_id", "int"), F.lit(-1)), "direction_name": F.coalesce(F.get(names, own("class_id", "int")), F.lit("")),
        "direction_dx": own("dx", "double"), "direction_dy": own("dy", "double"), "axis_length": own("axis_length", "double"), "head_angle_deg": angle,
        "erase_final": erased(why("final_reasons")), "erase_final_reasons": joined(why("final_reasons")), "direction_failure_reasons": joined(failures), "jump_lo": F.lit(0.0), "jump_hi": scaled("jump"),
    }
    whole = blobs.crossJoin(F.broadcast(bounds(blobs)))  # one row
    return whole.select(*[value.get(c, F.col(c)).alias(c) for c in COLUMNS])
