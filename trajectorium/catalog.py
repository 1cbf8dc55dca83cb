"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import angles, boxes
from .operators import matching, reshape, sampling, sequences, statistics
from .plans.views import DET_SQL, FRAG_SQL, OBS_SQL, STRUNG_SQL, det, frag, indexed, obs, strung
from .registry import ORACLES, PAIRS_SQL, QUERIES, Query, query, r, r_half
from .session import ship
from .streaming import tracker

# filters and projections


@query("p01_confidence_filter", f"WITH {DET_SQL} SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, event_id) - 1 AS BIGINT) det_index, event_id, score FROM det WHERE score >= 0.5")
def p01(s, d):
    return indexed(det(s, d).where("NOT isnan(score) AND score >= 0.5")).select("frame", "det_index", "event_id", "score")


@query("p02_detection_scan", f"WITH {DET_SQL} SELECT f.range AS frame, count(x.event_id) AS n FROM range(10, 61) f LEFT JOIN (SELECT * FROM det WHERE frame BETWEEN 10 AND 60 AND score >= 0.9) x ON x.frame = f.range GROUP BY 1")
def p02(s, d):
    rows = det(s, d).where("frame BETWEEN 10 AND 60 AND score >= 0.9").groupBy("frame").agg(F.count("*").alias("n"))
    return s.range(10, 61).withColumnRenamed("id", "frame").join(rows, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))


@query("p05_iqr_bounds", f"WITH {DET_SQL}, q AS (SELECT quantile_cont(cx, 0.25) a, quantile_cont(cx, 0.75) b FROM det) SELECT round(a - 1.5*(b-a), 4) lo, round(b + 1.5*(b-a), 4) hi FROM q")
def p05(s, d):
    return statistics.iqr_bounds(det(s, d), "cx").select(r("lo").alias("lo"), r("hi").alias("hi"))


@query("p08_erase_reasons", f"WITH {DET_SQL} SELECT event_id, concat_ws('|', CASE WHEN score < 0.2 THEN 'low_score' END, CASE WHEN w / h < 2.5 THEN 'low_aspect' END, CASE WHEN cx > 90 THEN 'far' END) reasons FROM det WHERE score < 0.2 OR w / h < 2.5 OR cx > 90")
def p08(s, d):
    why = F.array(F.when(F.col("score") < 0.2, F.lit("low_score")), F.when(F.col("w") / F.col("h") < 2.5, F.lit("low_aspect")), F.when(F.col("cx") > 90, F.lit("far")))
    reasons = F.filter(why, lambda x: x.isNotNull())
    return det(s, d).select("event_id", F.array_join(reasons, "|").alias("reasons"), F.size(reasons).alias("_n")).where("_n > 0").drop("_n")


@query("p14_box_validity", f"WITH {DET_SQL} SELECT event_id, round(w * h, 4) area, true AS ok FROM det")
def p14(s, d):
    p = boxes.corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "heading")])
    return det(s, d).withColumn("p", p).select("event_id", r(F.abs(boxes.signed_area(F.col("p")))).alias("area"), boxes.valid(F.col("p")).alias("ok"))


@query("p15_even_sample", f"WITH {DET_SQL}, f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT frame FROM det)), t AS (SELECT CAST(floor((2*k*(n-1) + 10) / 20) AS BIGINT) i FROM range(0, 11) x(k), (SELECT max(n) n FROM f)) SELECT DISTINCT frame FROM f JOIN t USING (i)")
def p15(s, d):
    return sampling.evenly(det(s, d).select("frame").distinct(), "frame", 11)


# joins


@query("j02_full_outer_dense", f"WITH {OBS_SQL}, a AS (SELECT tid // 2 AS pair, * FROM obs WHERE tid % 2 = 0), b AS (SELECT tid // 2 AS pair, * FROM obs WHERE tid % 2 = 1), g AS (SELECT tid // 2 AS pair, unnest(range(0, max(frame) + 1)) AS frame FROM obs GROUP BY 1) SELECT pair, g.frame, a.cx, b.heading FROM g LEFT JOIN a USING (pair, frame) LEFT JOIN b USING (pair, frame)")
def j02(s, d):
    """Boxes of the first, headings of the second of every two tracks."""
    o = obs(s, d).withColumn("pair", F.expr("tid div 2"))
    both = reshape.full_outer(o.where("tid % 2 = 0").select("pair", "frame", "cx"), o.where("tid % 2 = 1").select("pair", "frame", "heading"), ["pair", "frame"])
    return reshape.dense(both, by=["pair"])


@query("j04_range_join", f"WITH {OBS_SQL}, i AS (SELECT tid, frame, frame - row_number() OVER (PARTITION BY tid ORDER BY frame) g FROM obs), q AS (SELECT tid, min(frame) s, max(frame) e, count(*) n FROM i GROUP BY tid, g) SELECT obs.tid, obs.frame, CAST(q.n AS BIGINT) run_frames FROM obs JOIN q ON q.tid = obs.tid AND obs.frame BETWEEN q.s AND q.e")
def j04(s, d):
    o = obs(s, d).select("tid", "frame")
    found = sequences.runs(o, ["tid"])
    return matching.in_runs(o, found, ["tid"]).join(found.select("tid", F.col("island").alias("run_id"), F.col("n").alias("run_frames")), ["tid", "run_id"]).select("tid", "frame", "run_frames")


@query("j05_anti_join", f"WITH {DET_SQL} SELECT event_id, frame FROM det WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = det.event_id AND o.o_totalprice > 200000)")
def j05(s, d):
    gone = s.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("event_id"))
    return det(s, d).select("event_id", "frame").join(gone, "event_id", "left_anti")


@query("j07_overlapping_pairs", PAIRS_SQL + " SELECT frame, a_event_id, b_event_id, round(inter / (total - inter), 4) iou FROM p")
def j07(s, d):
    return matching.crowd_pairs(det(s, d), r)


@query("j09_isolated_boxes", PAIRS_SQL + " SELECT event_id, frame FROM det WHERE event_id NOT IN (SELECT a_event_id FROM p UNION ALL SELECT b_event_id FROM p)")
def j09(s, d):
    return matching.isolated(det(s, d)).select("event_id", "frame")


@query("j12_consecutive_assignment")
def j12(s, d):
    ship(s)
    return matching.consecutive_matches(det(s, d), 20.0)


@query("j16_mutual_nearest", f"WITH {DET_SQL}, p AS (SELECT a.frame, a.event_id a, b.event_id b, sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) d FROM det a JOIN det b ON b.frame = a.frame + 1 AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) <= 225), q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) ra, row_number() OVER (PARTITION BY b ORDER BY d, a) rb FROM p) SELECT frame, a, b, round(d, 4) d FROM q WHERE ra = 1 AND rb = 1")
def j16(s, d):
    return matching.nearest_mutual(det(s, d), 15.0).withColumn("d", r("d"))


@query("j19_as_of_before", f"WITH {FRAG_SQL} SELECT a.frag_id, max_by(b.frag_id, b.end_frame * 100000 + b.frag_id) before_frag FROM frag a LEFT JOIN frag b ON a.obj_id = b.obj_id AND b.end_frame < a.start_frame GROUP BY 1")
def j19(s, d):
    f = frag(s, d)
    return matching.last_before(f.select("frag_id", "obj_id", F.col("start_frame").alias("at")), f, "obj_id", "at").select("frag_id", "before_frag")


@query("j20_best_match", PAIRS_SQL + ", q AS (SELECT a_event_id e, b_event_id o, inter/(total-inter) iou FROM p UNION ALL SELECT b_event_id, a_event_id, inter/(total-inter) FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY iou DESC, o) rn FROM q) SELECT event_id, o AS other, round(iou, 4) iou FROM det LEFT JOIN z ON z.e = det.event_id AND z.rn = 1")
def j20(s, d):
    return matching.best_match(det(s, d)).withColumn("iou", r("iou"))


# aggregations


@query("a01_modal_count", f"WITH {DET_SQL}, c AS (SELECT frame, count(DISTINCT tid) n FROM det GROUP BY 1) SELECT n AS n_individuals FROM (SELECT n, count(*) c FROM c GROUP BY 1 ORDER BY c DESC, n LIMIT 1)")
def a01(s, d):
    return statistics.modal_count(det(s, d), "frame", "tid")


@query("a03_trimmed_mean", f"WITH {DET_SQL}, q AS (SELECT quantile_cont(cx, 0.25) a, quantile_cont(cx, 0.75) b FROM det) SELECT round(coalesce(avg(CASE WHEN cx BETWEEN a - 1.5*(b-a) AND b + 1.5*(b-a) THEN cx END), avg(cx)), 4) trimmed_mean FROM det, q")
def a03(s, d):
    return statistics.trimmed_mean(det(s, d), "cx").select(r("trimmed_mean").alias("trimmed_mean"))


@query("a04_frame_union_boxes", f"WITH {DET_SQL} SELECT frame, round(min(cx - w/2), 4) x1, round(min(cy - h/2), 4) y1, round(max(cx + w/2), 4) x2, round(max(cy + h/2), 4) y2, greatest(max(cx + w/2) - min(cx - w/2), max(cy + h/2) - min(cy - h/2)) <= 120 AS fits FROM det GROUP BY 1")
def a04(s, d):
    x1, x2, y1, y2 = F.min(F.expr("cx - w/2")), F.max(F.expr("cx + w/2")), F.min(F.expr("cy - h/2")), F.max(F.expr("cy + h/2"))
    return det(s, d).groupBy("frame").agg(r(x1).alias("x1"), r(y1).alias("y1"), r(x2).alias("x2"), r(y2).alias("y2"), (F.greatest(x2 - x1, y2 - y1) <= 120).alias("fits"))


@query("a06_retention_curve", f"WITH {DET_SQL}, k AS (SELECT t.threshold, avg(CASE WHEN score >= t.threshold THEN 1.0 ELSE 0.0 END) kept FROM det, (VALUES (0.01E0), (0.02E0), (0.05E0), (0.1E0), (0.3E0)) t(threshold) GROUP BY 1) SELECT threshold, round(kept, 4) kept, threshold = coalesce((SELECT max(threshold) FROM k WHERE kept >= 0.95), 0.01E0) chosen FROM k")
def a06(s, d):
    return statistics.retention(det(s, d), "score", [0.01, 0.02, 0.05, 0.1, 0.3]).withColumn("kept", r("kept"))


@query("a08_run_delete_policy", f"WITH {DET_SQL} SELECT tid, CAST(count(*) FILTER (score < 0.4) AS BIGINT) flagged, count(*) total, count(*) FILTER (score < 0.4) * 5 >= count(*) * 2 AS expand FROM det GROUP BY 1")
def a08(s, d):
    return statistics.delete_ratio(det(s, d), "tid", F.col("score") < 0.4, 2, 5)


@query("a10_centroids", f"WITH {FRAG_SQL} SELECT obj_id, CAST(i AS BIGINT) AS position, round(avg(CAST(centroid[CAST(i AS INT) + 1] AS DOUBLE)), 4) AS value FROM frag, range(0, 64) t(i) GROUP BY 1, 2")
def a10(s, d):
    return statistics.centroids(frag(s, d), "obj_id", "centroid").select("obj_id", F.col("position").cast("long").alias("position"), r("value").alias("value"))


@query("a11_median_vectors", f"WITH {FRAG_SQL} SELECT obj_id, CAST(i AS BIGINT) AS position, round(quantile_cont(CAST(centroid[CAST(i AS INT) + 1] AS DOUBLE), 0.5), 4) AS value FROM frag, range(0, 64) t(i) GROUP BY 1, 2")
def a11(s, d):
    return statistics.centroids(frag(s, d), "obj_id", "centroid", median=True).select("obj_id", F.col("position").cast("long").alias("position"), r("value").alias("value"))


@query("a14_peak_occupancy", f"WITH {DET_SQL} SELECT max(n) peak FROM (SELECT frame, count(DISTINCT tid) n FROM det GROUP BY 1)")
def a14(s, d):
    return det(s, d).groupBy("frame").agg(F.countDistinct("tid").alias("n")).agg(F.max("n").alias("peak"))


@query("a18_largest_remainder", f"WITH {DET_SQL}, b AS (SELECT heading, count(*) n FROM det GROUP BY 1), f AS (SELECT *, CAST(floor(n * 1000 / sum(n) OVER ()) AS BIGINT) fl, (n * 1000) - CAST(floor(n * 1000 / sum(n) OVER ()) AS BIGINT) * sum(n) OVER () rest FROM b), g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, heading) rk, 1000 - sum(fl) OVER () spare FROM f) SELECT heading, n, CAST(least(fl + CASE WHEN rk <= spare THEN 1 ELSE 0 END, n) AS BIGINT) allocated FROM g")
def a18(s, d):
    return statistics.apportion(det(s, d).groupBy("heading").agg(F.count("*").alias("n")), "heading", "n", 1000)


# along tracks


@query("w02_jump_flags", f"WITH {OBS_SQL} SELECT tid, frame, coalesce(frame = lag(frame) OVER w + 1 AND sqrt((cx - lag(cx) OVER w)*(cx - lag(cx) OVER w) + (cy - lag(cy) OVER w)*(cy - lag(cy) OVER w)) > 60, false) jump FROM obs WINDOW w AS (PARTITION BY tid ORDER BY frame)")
def w02(s, d):
    return sequences.jumps(obs(s, d), ["tid"], 60.0).select("tid", "frame", "jump")


_RUNS = f"WITH {OBS_SQL}, b AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY tid ORDER BY frame) <= 2 THEN 0 ELSE 1 END nw FROM obs), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY tid ORDER BY frame) AS BIGINT) island FROM b)"


@query("w03_gaps_and_islands", _RUNS + " SELECT tid, island, min(frame) start_frame, max(frame) end_frame, count(*) n FROM i GROUP BY 1, 2")
def w03(s, d):
    return sequences.runs(obs(s, d).select("tid", "frame"), ["tid"], max_gap=2)


@query("w04_short_runs", _RUNS + " SELECT tid, frame, count(*) OVER (PARTITION BY tid, island) <= 2 erased FROM i")
def w04(s, d):
    return sequences.short_runs(obs(s, d).select("tid", "frame"), ["tid"], 2, max_gap=2).select("tid", "frame", "erased")


@query("w07_sign_continuity", f"WITH {OBS_SQL}, f AS (SELECT tid, frame, heading, CASE WHEN abs(((heading - lag(heading) OVER w + 540) % 360) - 180) > 90 THEN 1 ELSE 0 END fl FROM obs WINDOW w AS (PARTITION BY tid ORDER BY frame)) SELECT tid, frame, (heading + 180 * (sum(fl) OVER (PARTITION BY tid ORDER BY frame) % 2)) % 360 turned FROM f")
def w07(s, d):
    return sequences.sign_continuity(obs(s, d), ["tid"]).select("tid", "frame", "turned")


@query("w09_missing_frames", f"WITH {OBS_SQL}, e AS (SELECT tid, min(frame) a, max(frame) b FROM obs GROUP BY 1) SELECT e.tid, CAST(g.range AS BIGINT) frame FROM e, range(0, 100000) g WHERE g.range BETWEEN e.a AND e.b AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.tid = e.tid AND o.frame = g.range)")
def w09(s, d):
    return sequences.missing(obs(s, d).select("tid", "frame"), ["tid"])


@query("w10_linear_interpolation", f"WITH {OBS_SQL}, n AS (SELECT tid, frame, cx, heading, lead(frame) OVER w nf, lead(cx) OVER w nc, lead(heading) OVER w nh FROM obs WINDOW w AS (PARTITION BY tid ORDER BY frame)) SELECT tid, frame, round(cx, 4) cx, round(heading, 4) heading FROM n UNION ALL SELECT tid, CAST(g.range AS BIGINT), round(cx + CAST(g.range - frame AS DOUBLE) / (nf - frame) * (nc - cx), 4), round((heading + CAST(g.range - frame AS DOUBLE) / (nf - frame) * (((nh - heading + 540) % 360) - 180) + 360) % 360, 4) FROM n, range(0, 100000) g WHERE g.range > frame AND g.range < nf")
def w10(s, d):
    out = sequences.filled(obs(s, d).select("tid", "frame", "cx", "heading"), ["tid"], ["cx"], ["heading"])
    return out.select("tid", "frame", r_half("cx").alias("cx"), r_half("heading").alias("heading"))


@query("w13_position_spikes", f"WITH {OBS_SQL}, n AS (SELECT tid, frame, cx, cy, lag(frame) OVER w pf, lag(cx) OVER w px, lag(cy) OVER w py, lead(frame) OVER w nf, lead(cx) OVER w nx, lead(cy) OVER w ny FROM obs WINDOW w AS (PARTITION BY tid ORDER BY frame)) SELECT tid, frame, round((px+nx)/2, 4) mx, round((py+ny)/2, 4) my FROM n WHERE pf = frame - 1 AND nf = frame + 1 AND (cx-px)*(nx-cx) + (cy-py)*(ny-cy) < 0 AND sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py))/2 < greatest(sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)), sqrt((nx-cx)*(nx-cx)+(ny-cy)*(ny-cy)))")
def w13(s, d):
    return sequences.spikes(obs(s, d), ["tid"]).select("tid", "frame", r("mx").alias("mx"), r("my").alias("my"))


@query("w14_run_winners", f"WITH {OBS_SQL}, i AS (SELECT tid, frame, score, frame - row_number() OVER (PARTITION BY tid ORDER BY frame) g FROM obs), z AS (SELECT *, row_number() OVER (PARTITION BY tid, g ORDER BY score DESC, frame) rn FROM i) SELECT tid, frame, score FROM z WHERE rn = 1")
def w14(s, d):
    return sequences.run_winners(obs(s, d).select("tid", "frame", "score"), ["tid"], "score").select("tid", "frame", "score")


@query("w20_identity_bridging", f"WITH {OBS_SQL}, v AS (SELECT tid, frame, CASE WHEN score >= 0.3 THEN CAST(heading >= 180 AS INT) END v FROM obs), n AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY tid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) a, first_value(v IGNORE NULLS) OVER (PARTITION BY tid ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) b FROM v) SELECT tid, frame, coalesce(v, CASE WHEN a = b THEN a END) bridged FROM n")
def w20(s, d):
    v = F.when(F.col("score") >= 0.3, (F.col("heading") >= 180).cast("int"))
    return sequences.bridged(obs(s, d).select("tid", "frame", v.alias("v")), ["tid"], "v").select("tid", "frame", "bridged")


# order, top-k, reshaping


@query("o02_start_frame", f"WITH {DET_SQL}, n AS (SELECT frame, score FROM det WHERE det_index = 4) SELECT coalesce((SELECT min(frame) FROM n WHERE score >= 0.5), (SELECT frame FROM n ORDER BY score DESC, frame LIMIT 1)) start_frame")
def o02(s, d):
    n = indexed(det(s, d)).where("det_index = 4")
    return n.agg(F.coalesce(F.min(F.when(F.col("score") >= 0.5, F.col("frame"))), F.max_by("frame", F.struct("score", -F.col("frame")))).alias("start_frame"))


@query("o03_greedy_nms")
def o03(s, d):
    ship(s)
    return matching.suppressed(det(s, d), 0.3)


@query("o06_top_per_frame", f"WITH {DET_SQL} SELECT frame, event_id, score FROM det WHERE det_index < 8")
def o06(s, d):
    return sampling.top_per_group(det(s, d), "frame", "score", 8, "event_id").select("frame", "event_id", "score")


@query("u07_long_to_wide", f"WITH {STRUNG_SQL} SELECT frame, " + ", ".join(f"max(CASE WHEN tid = {k} THEN {c} END) {c}{k}" for k in range(4) for c in ("cx", "cy")) + " FROM strung GROUP BY 1")
def u07(s, d):
    return reshape.to_wide(strung(s, d), [0, 1, 2, 3], ["cx", "cy"])


@query("u09_id_swap", f"WITH {OBS_SQL} SELECT event_id, frame, CAST(CASE WHEN frame >= 20 AND frame < 90 AND tid = 1 THEN 2 WHEN frame >= 20 AND frame < 90 AND tid = 2 THEN 1 ELSE tid END AS BIGINT) tid FROM obs")
def u09(s, d):
    return obs(s, d).select("event_id", "frame", reshape.swapped(1, 2, F.col("tid"), F.col("frame"), 20, 90).cast("long").alias("tid"))


@query("u10_permutation_relabel", f"WITH {OBS_SQL} SELECT event_id, frame, CAST(CASE WHEN frame BETWEEN 5 AND 50 THEN CASE tid WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE tid END ELSE tid END AS BIGINT) tid FROM obs")
def u10(s, d):
    return reshape.relabelled(obs(s, d).select("event_id", "frame", "tid"), {1: 2, 2: 3, 3: 1}, 5, 50)


@query("u12_front_rear", f"WITH {DET_SQL} SELECT event_id, round(cx + sin(radians(heading))*w/2, 4) front_x, round(cy - cos(radians(heading))*w/2, 4) front_y, round(cx - sin(radians(heading))*w/2, 4) rear_x, round(cy + cos(radians(heading))*w/2, 4) rear_y FROM det")
def u12(s, d):
    out = reshape.front_rear(det(s, d))
    return out.select("event_id", *[r(c).alias(c) for c in ("front_x", "front_y", "rear_x", "rear_y")])


# scalar functions


@query("f01_angles", f"WITH {DET_SQL}, n AS (SELECT *, score * 720 - 360 a FROM det) SELECT event_id, round((a + 720) % 360, 4) wrapped, round(abs(((a - heading + 1260) % 360) - 180), 4) apart, round(least((a - heading + 1080) % 180, 180 - (a - heading + 1080) % 180), 4) axis, CAST(floor(((heading + 22.5) % 360) / 45) AS BIGINT) klass FROM n")
def f01(s, d):
    a = F.col("score") * 720 - 360
    h = F.col("heading")
    klass = F.floor(F.pmod(h + 22.5, F.lit(360.0)) / 45.0).cast("long")
    return det(s, d).select("event_id", r(angles.wrap(a)).alias("wrapped"), r(angles.distance(a, h)).alias("apart"), r(angles.axis_distance(a, h)).alias("axis"), klass.alias("klass"))


@query("f09_shoelace_bounds", f"WITH {DET_SQL} SELECT event_id, round(cx - (abs(sin(radians(heading)))*w + abs(cos(radians(heading)))*h)/2, 4) x1, round(cy - (abs(cos(radians(heading)))*w + abs(sin(radians(heading)))*h)/2, 4) y1 FROM det")
def f09(s, d):
    p = boxes.corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "heading")])
    return det(s, d).withColumn("p", p).withColumn("b", boxes.bounds(F.col("p"))).select("event_id", r("b.x1").alias("x1"), r("b.y1").alias("y1"))


@query("f30_safe_names", "SELECT event_id, trim(regexp_replace(regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') safe FROM events")
def f30(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", "event_type", "props"), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return e.select("event_id", F.btrim(text, F.lit("_")).alias("safe"))


# splits and trackers


@query("r01_group_split", f"WITH {DET_SQL} SELECT event_id, frame, CASE WHEN ('0x' || substr(sha256('seed/' || frame), 1, 13))::BIGINT / 4503599627370496.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM det")
def r01(s, d):
    return sampling.split_by_group(det(s, d).select("frame", "event_id"), "frame", 0.2, "seed")


@query("r05_even_jobs", f"WITH {DET_SQL}, f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT frame FROM det)) SELECT frame, CAST((i+1)*1000//n - i*1000//n AS BIGINT) jobs FROM f")
def r05(s, d):
    return sampling.even_jobs(det(s, d).select("frame").distinct(), "frame", 1000)


@query("t11_greedy_tracker")
def t11(s, d):
    ship(s)
    rows = det(s, d).select(F.expr("string(tid div 16)").alias("video"), "frame", F.col("event_id").alias("det"), *matching.BOX)
    return tracker.track(rows)


from . import catalog_graph, catalog_more, catalog_stages  # noqa: E402, F401  (they register their queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
