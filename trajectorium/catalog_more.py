"""More registered queries: predicates, joins, summaries, sequences, sets, geometry, text and identity operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import angles, boxes, polygons
from .operators import crowds, headings, identity, matching, reshape, sampling, sequences, statistics
from .plans.views import DET_SQL, FRAG_SQL, OBS_SQL, STRUNG_SQL, det, frag, indexed, obs, strung
from .registry import PAIRS_SQL, query, r, r_half
from .session import ship

BOX = ("cx", "cy", "w", "h", "heading")
#: Names of the eight compass classes, clockwise from up.
DIRECTIONS = ["up", "up_right", "right", "down_right", "down", "down_left", "left", "up_left"]
_NAMES = "['" + "','".join(DIRECTIONS) + "']"
#: Half the axis-aligned extent of a det row's oriented box.
_EX, _EY = "(abs(sin(radians(heading)))*w + abs(cos(radians(heading)))*h)/2", "(abs(cos(radians(heading)))*w + abs(sin(radians(heading)))*h)/2"


def corners():
    return boxes.corners(*[F.col(c) for c in BOX])


def sql_corner(k: int, d: str = "") -> tuple[str, str]:
    """x and y of the k-th corner in SQL; d: a prefix of the columns."""
    a, b = [(1, 1), (1, -1), (-1, -1), (-1, 1)][k]
    ux, uy = f"sin(radians({d}heading))", f"(-cos(radians({d}heading)))"
    return f"({d}cx + {a}*{ux}*{d}w/2 - {b}*{uy}*{d}h/2)", f"({d}cy + {a}*{uy}*{d}w/2 + {b}*{ux}*{d}h/2)"


# predicates


@query("p03_bounds_and_names", f"WITH {DET_SQL} SELECT event_id, round(cx - {_EX}, 4) x1, round(cy - {_EY}, 4) y1, round(cx + {_EX}, 4) x2, round(cy + {_EY}, 4) y2, ({_NAMES})[CAST(floor(((heading + 22.5) % 360) / 45) AS INT) + 1] AS direction FROM det")
def p03(s, d):
    k = F.floor(F.pmod(F.col("heading") + 22.5, F.lit(360.0)) / 45.0).cast("int")
    rows = det(s, d).withColumn("b", boxes.bounds(corners()))
    return rows.select("event_id", *[r(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.get(F.array(*[F.lit(x) for x in DIRECTIONS]), k).alias("direction"))


_AREA = "q AS (SELECT quantile_cont(w*h, 0.25) a, quantile_cont(w*h, 0.5) m, quantile_cont(w*h, 0.75) b FROM det), b AS (SELECT least(m, a - 0.2*(b-a)) lo, greatest(m, b + 0.2*(b-a)) hi FROM q)"


@query("p06_area_bounds", f"WITH {DET_SQL}, {_AREA} SELECT round(lo, 4) lo, round(hi, 4) hi FROM b")
def p06(s, d):
    return statistics.median_bounds(det(s, d).withColumn("area", F.expr("w*h")), "area", 0.2, 0.2).select(r("lo").alias("lo"), r("hi").alias("hi"))


@query("p07_outlier_flags", f"WITH {DET_SQL}, {_AREA} SELECT event_id, w*h NOT BETWEEN lo AND hi AS area_out, w/h < 2.01 AS too_round, (w*h NOT BETWEEN lo AND hi) OR w/h < 2.01 AS is_outlier FROM det, b")
def p07(s, d):
    rows = det(s, d).withColumn("area", F.expr("w*h"))
    b = F.broadcast(statistics.median_bounds(rows, "area", 0.2, 0.2))  # one row
    return rows.join(b).select("event_id", F.expr("area NOT BETWEEN lo AND hi").alias("area_out"), F.expr("w/h < 2.01").alias("too_round")).withColumn("is_outlier", F.expr("area_out OR too_round"))


@query("p09_low_aspect", f"WITH {DET_SQL} SELECT event_id, frame FROM det WHERE w/h < 1.87")
def p09(s, d):
    """The aspect is missing from a third of the rows, and taken from the polygon there."""
    p = corners()
    side = lambda i, j: F.hypot(p[i]["x"] - p[j]["x"], p[i]["y"] - p[j]["y"])
    sides = (side(0, 1), side(1, 2))
    aspect = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("w") / F.col("h")), F.greatest(*sides) / F.least(*sides))
    return det(s, d).where(aspect < 1.87).select("event_id", "frame")


_ISLANDS = f"WITH {OBS_SQL}, b AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY tid ORDER BY frame) <= 2 THEN 0 ELSE 1 END nw FROM obs), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY tid ORDER BY frame) AS BIGINT) island FROM b)"


@query("p10_long_runs", _ISLANDS + " SELECT tid, island, min(frame) start_frame, max(frame) end_frame, count(*) n FROM i GROUP BY 1, 2 HAVING count(*) > 3")
def p10(s, d):
    return sequences.runs(obs(s, d).select("tid", "frame"), ["tid"], max_gap=2).where("n > 3")


@query("p11_active", f"WITH {FRAG_SQL} SELECT frag_id, frag_id % 4 <> 0 AND start_frame <= 1000 AND (frag_id % 5 = 0 OR 1000 <= end_frame) active FROM frag")
def p11(s, d):
    """A rule without an end has a negative one."""
    f = frag(s, d).withColumn("end_frame", F.when(F.col("frag_id") % 5 == 0, -1).otherwise(F.col("end_frame")))
    on = (F.col("frag_id") % 4 != 0) & (F.col("start_frame") <= 1000) & ((F.col("end_frame") < 0) | (F.col("end_frame") >= 1000))
    return f.select("frag_id", on.alias("active"))


@query("p12_trusted", f"WITH {DET_SQL} SELECT event_id, event_id % 6 IN (0, 1) trusted FROM det")
def p12(s, d):
    return det(s, d).select("event_id", (F.col("event_id") % 6).isin(0, 1).alias("trusted"))


#: Codes of filled rows.
FILLS = [20, 21, 30, 31, 34]


@query("p13_fill_trigger", f"WITH {DET_SQL} SELECT event_id FROM det WHERE event_id % 25 IN {tuple(FILLS)} OR event_id % 40 IN {tuple(FILLS)} OR (event_id * 7) % 40 IN {tuple(FILLS)}")
def p13(s, d):
    e = F.col("event_id")
    rows = det(s, d).select("event_id", (e % 25).alias("code"), F.array(e % 40, (e * 7) % 40).alias("history"))
    return rows.where(F.col("code").isin(FILLS) | F.exists("history", lambda h: h.isin(FILLS))).select("event_id")


@query("p16_whole_runs", _ISLANDS + ", v AS (SELECT tid, frame, island, bool_and(event_id % 6 <> 5) OVER (PARTITION BY tid, island) ok FROM i) SELECT tid, frame, island FROM v WHERE ok")
def p16(s, d):
    rows = sequences.islands(obs(s, d).select("tid", "frame", "event_id"), ["tid"], max_gap=2)
    return rows.withColumn("ok", F.bool_and(F.col("event_id") % 6 != 5).over(Window.partitionBy("tid", "island"))).where("ok").select("tid", "frame", "island")


# joins


@query("j01_last_of_duplicates", f"WITH {DET_SQL}, l AS (SELECT tid, frame, max_by(score, event_id) last FROM det GROUP BY 1, 2) SELECT event_id, last AS score FROM det LEFT JOIN l USING (tid, frame)")
def j01(s, d):
    rows = det(s, d)
    return matching.lookup_last(rows.select("event_id", "tid", "frame"), rows, ["tid", "frame"], "score", "event_id").select("event_id", "score")


@query("j03_full_outer", f"WITH {OBS_SQL}, a AS (SELECT tid // 2 AS pair, * FROM obs WHERE tid % 2 = 0), b AS (SELECT tid // 2 AS pair, * FROM obs WHERE tid % 2 = 1) SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.frame, b.frame) AS position, a.score, b.heading FROM a FULL JOIN b ON a.pair = b.pair AND a.frame = b.frame")
def j03(s, d):
    o = obs(s, d).withColumnRenamed("frame", "position").withColumn("pair", F.expr("tid div 2"))
    return reshape.full_outer(o.where("tid % 2 = 0").select("pair", "position", "score"), o.where("tid % 2 = 1").select("pair", "position", "heading"), ["pair", "position"])


_REASONS = "a AS (SELECT frame, CASE WHEN min(score) < 0.02 THEN 'faint' END x, CASE WHEN count(*) > 60 THEN 'crowded' END y, CASE WHEN max(cx) > 99.5 THEN 'far' END z FROM det GROUP BY 1), u AS (SELECT frame, concat_ws('|', x, y, z) reasons FROM a WHERE x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL)"


def _reasons(s, d):
    by = det(s, d).groupBy("frame").agg(F.min("score").alias("lo"), F.count("*").alias("n"), F.max("cx").alias("far"))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    one = by.select("frame", some(F.when(F.col("lo") < 0.02, F.lit("faint")), F.when(F.col("n") > 60, F.lit("crowded"))).alias("reasons")).where(F.size("reasons") > 0)
    two = by.select("frame", some(F.when(F.col("n") > 60, F.lit("crowded")), F.when(F.col("far") > 99.5, F.lit("far"))).alias("reasons")).where(F.size("reasons") > 0)
    return reshape.merged_reasons(one, two, "frame")


@query("u04_merged_reasons", f"WITH {DET_SQL}, {_REASONS} SELECT frame, reasons FROM u")
def u04(s, d):
    return _reasons(s, d).select("frame", F.array_join("reasons", "|").alias("reasons"))


@query("j06_semi_join_reasons", f"WITH {DET_SQL}, {_REASONS} SELECT event_id, reasons FROM det JOIN u USING (frame)")
def j06(s, d):
    return det(s, d).select("event_id", "frame").join(_reasons(s, d), "frame").select("event_id", F.array_join("reasons", "|").alias("reasons"))


def _edges(side: str) -> str:
    """Edges of side's corners moved by a's centre, with the inside on the left."""
    c = [sql_corner(k, f"{side}_") for k in range(4)]
    ring = [(f"{x} - a_cx", f"{y} - a_cy") for x, y in c][::-1]  # the corners run the other way
    parts = [f"SELECT frame, a_id, b_id, {k} AS k, {ring[k][0]} AS x, {ring[k][1]} AS y, ({ring[(k + 1) % 4][0]}) - ({ring[k][0]}) AS dx, ({ring[(k + 1) % 4][1]}) - ({ring[k][1]}) AS dy FROM c" for k in range(4)]
    return " UNION ALL ".join(parts)


def _clipped(own: str, other: str) -> str:
    den, num = "(q.dx*e.dy - q.dy*e.dx)", "(q.dx*(e.y - q.y) - q.dy*(e.x - q.x))"
    lo = f"CASE WHEN abs{den} <= 1E-9 THEN CASE WHEN {num} < 0 THEN 2 ELSE 0 END WHEN {den} > 0 THEN greatest(0, -{num}/{den}) ELSE 0 END"
    hi = f"CASE WHEN abs{den} > 1E-9 AND {den} < 0 THEN least(1, -{num}/{den}) ELSE 1 END"
    return f"SELECT a_id, b_id, greatest(min({hi}) - max({lo}), 0) * any_value(e.x*e.dy - e.y*e.dx) part FROM {own} e JOIN {other} q USING (frame, a_id, b_id) GROUP BY a_id, b_id, e.k"


@query(
    "j08_oriented_iou",
    f"""WITH {DET_SQL}, c AS (SELECT a.frame, a.event_id a_id, b.event_id b_id, {", ".join(f"{k}.{x} AS {k}_{x}" for k in "ab" for x in BOX)} FROM det a JOIN det b ON a.frame = b.frame AND a.event_id < b.event_id AND abs(a.cx - b.cx) <= 56 AND abs(a.cy - b.cy) <= 56),
ea AS ({_edges("a")}), eb AS ({_edges("b")}), parts AS ({_clipped("ea", "eb")} UNION ALL {_clipped("eb", "ea")}), s AS (SELECT a_id, b_id, sum(part)/2 shared FROM parts GROUP BY 1, 2)
SELECT c.frame, a_id a_event_id, b_id b_event_id, round(shared / (a_w*a_h + b_w*b_h - shared), 4) iou FROM s JOIN c USING (a_id, b_id) WHERE shared / (a_w*a_h + b_w*b_h - shared) > 1E-9""",
)
def j08(s, d):
    ship(s)
    return matching.oriented_pairs(det(s, d), 56.0).withColumn("iou", r("iou"))


@query("j17_radius_best", f"WITH {DET_SQL}, p AS (SELECT a.event_id, b.event_id o, round(sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy))/12 + 1 - least(a.w/b.w, b.w/a.w), 6) c FROM det a JOIN det b ON b.frame = a.frame AND a.event_id <> b.event_id AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) <= 144 WHERE least(a.w/b.w, b.w/a.w) >= 0.6), z AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c, o) rn FROM p) SELECT event_id, o AS other, c AS cost FROM z WHERE rn = 1")
def j17(s, d):
    return matching.radius_best(det(s, d), 12.0, 0.6)


@query("j18_chebyshev_evidence", f"WITH {DET_SQL} SELECT a.event_id, bit_or(CAST(1 << CAST(b.tid % 4 AS INT) AS BIGINT)) evidence FROM det a JOIN det b ON a.frame = b.frame AND a.tid % 2 = 0 AND b.tid % 2 = 1 AND abs(a.cx - b.cx) <= 9 AND abs(a.cy - b.cy) <= 9 GROUP BY 1")
def j18(s, d):
    rows = det(s, d).select("frame", "event_id", "tid", "cx", "cy")
    pairs = matching.near_pairs(rows.where("tid % 2 = 0"), rows.where("tid % 2 = 1"), 9.0)
    return pairs.groupBy(F.col("a_event_id").alias("event_id")).agg(F.bit_or(F.expr("shiftleft(1L, int(b_tid % 4))")).alias("evidence"))


@query("j21_centre_owner", f"WITH {DET_SQL}, p AS (SELECT b.event_id, a.event_id o, round((b.cx-a.cx)*(b.cx-a.cx) + (b.cy-a.cy)*(b.cy-a.cy), 6) dd FROM det a JOIN det b ON a.frame = b.frame AND a.event_id <> b.event_id WHERE abs((b.cx-a.cx)*sin(radians(a.heading)) - (b.cy-a.cy)*cos(radians(a.heading))) <= a.w/2 AND abs((b.cy-a.cy)*sin(radians(a.heading)) + (b.cx-a.cx)*cos(radians(a.heading))) <= a.h/2), z AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dd, o) rn FROM p) SELECT event_id, o AS owner FROM z WHERE rn = 1")
def j21(s, d):
    return matching.centre_owner(det(s, d), 28.0)


@query("j23_temporal_edges", f"WITH {DET_SQL} SELECT a.frame, a.event_id AS parent, b.event_id AS child, round((least(a.cx+a.w/2, b.cx+b.w/2) - greatest(a.cx-a.w/2, b.cx-b.w/2)) * (least(a.cy+a.h/2, b.cy+b.h/2) - greatest(a.cy-a.h/2, b.cy-b.h/2)), 4) overlap FROM det a JOIN det b ON b.frame = a.frame + 1 AND abs(a.cx-b.cx) < (a.w+b.w)/2 AND abs(a.cy-b.cy) < (a.h+b.h)/2")
def j23(s, d):
    return matching.crowd_edges(det(s, d), r)


@query("j24_contact_groups", f"{PAIRS_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT a_event_id x, b_event_id y FROM p UNION SELECT b_event_id, a_event_id FROM p), c AS (SELECT x, x AS y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT det.frame, c.x AS event_id, min(c.y) component_id FROM c JOIN det ON det.event_id = c.x GROUP BY 1, 2")
def j24(s, d):
    ship(s)
    return identity.contact_groups(crowds.spanning(det(s, d)))


_MEANS = "m AS (SELECT obj_id, frag_id % 2 half, list(v ORDER BY i) c FROM (SELECT obj_id, frag_id % 2 frag_id, i, avg(CAST(centroid[CAST(i AS INT)] AS DOUBLE)) v FROM frag, range(1, 65) t(i) GROUP BY 1, 2, 3) z GROUP BY 1, 2)"


@query("j26_roster_of_two", f"WITH {FRAG_SQL}, {_MEANS}, k AS (SELECT a0.obj_id a, b0.obj_id b, list_distance(a0.c, a1.c) c11, list_distance(a0.c, b1.c) c12, list_distance(b0.c, a1.c) c21, list_distance(b0.c, b1.c) c22 FROM m a0 JOIN m b0 ON a0.half = 0 AND b0.half = 0 AND b0.obj_id = a0.obj_id + 1 JOIN m a1 ON a1.half = 1 AND a1.obj_id = a0.obj_id JOIN m b1 ON b1.half = 1 AND b1.obj_id = b0.obj_id) SELECT a, b, round(c11 + c22, 4) same_cost, round(c12 + c21, 4) swap_cost, CASE WHEN c12 + c21 <= 0.5*(c11 + c22) THEN 'swap' WHEN c11 + c22 <= c12 + c21 AND greatest(c11, c22) < 5 THEN 'identity' ELSE 'abstain' END decision FROM k")
def j26(s, d):
    f = frag(s, d).select("obj_id", (F.col("frag_id") % 2).alias("half"), "centroid")
    each = f.select("obj_id", "half", F.posexplode("centroid").alias("i", "v")).groupBy("obj_id", "half", "i").agg(F.avg("v").alias("v"))
    means = each.groupBy("obj_id", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))
    per = means.groupBy("obj_id").agg(F.max_by("c", F.when(F.col("half") == 0, 1)).alias("pre"), F.max_by("c", F.when(F.col("half") == 1, 1)).alias("post"))
    b = per.select(F.col("obj_id").alias("b"), F.col("pre").alias("pre2"), F.col("post").alias("post2"))
    pairs = per.withColumnRenamed("obj_id", "a").withColumn("b", F.col("a") + 1).join(b, "b").where("pre IS NOT NULL AND post IS NOT NULL AND pre2 IS NOT NULL AND post2 IS NOT NULL")
    costs = pairs.select("a", "b", *[identity.euclid(F.col(x), F.col(y)).alias(n) for n, x, y in (("c11", "pre", "post"), ("c12", "pre", "post2"), ("c21", "pre2", "post"), ("c22", "pre2", "post2"))])
    return identity.two_roster_decision(costs).select("a", "b", F.round(F.expr("c11 + c22"), 4).alias("same_cost"), F.round(F.expr("c12 + c21"), 4).alias("swap_cost"), "decision")


# summaries


@query("a02_summary", f"WITH {DET_SQL} SELECT round(min(cx), 4) lo, round(max(cx), 4) hi, round(quantile_cont(cx, 0.25), 4) q1, round(quantile_cont(cx, 0.5), 4) median, round(quantile_cont(cx, 0.75), 4) q3, round(avg(cx), 4) mean, (SELECT event_id FROM det ORDER BY cx, event_id LIMIT 1) lo_id, (SELECT event_id FROM det ORDER BY cx DESC, event_id DESC LIMIT 1) hi_id FROM det")
def a02(s, d):
    return statistics.summary(det(s, d), "cx", "event_id").select(*[r(c).alias(c) for c in ("lo", "hi", "q1", "median", "q3", "mean")], "lo_id", "hi_id")


_STEPS = f"WITH {OBS_SQL}, l AS (SELECT frame - lag(frame) OVER w step, sqrt((cx-lag(cx) OVER w)*(cx-lag(cx) OVER w) + (cy-lag(cy) OVER w)*(cy-lag(cy) OVER w)) / w ratio FROM obs WINDOW w AS (PARTITION BY tid ORDER BY frame))"


@query("a05_displacement_p90", _STEPS + " SELECT round(quantile_cont(ratio, 0.9), 4) p90, round(greatest(0.05, least(2.0, 1 / quantile_cont(ratio, 0.9))), 2) AS seconds FROM l WHERE step = 1")
def a05(s, d):
    w = Window.partitionBy("tid").orderBy("frame")
    lag = lambda c: F.lag(c).over(w)
    rows = obs(s, d).select((F.col("frame") - lag("frame")).alias("step"), (F.hypot(F.col("cx") - lag("cx"), F.col("cy") - lag("cy")) / F.col("w")).alias("ratio")).where("step = 1")
    p = rows.agg(F.percentile("ratio", F.lit(0.9)).alias("p90"))
    return p.select(r("p90").alias("p90"), F.bround(F.greatest(F.lit(0.05), F.least(F.lit(2.0), 1 / F.col("p90"))), 2).alias("seconds"))


@query("a07_run_flags", _ISLANDS + " SELECT tid, island, count(*) n, CAST(count(*) FILTER (score < 0.4) AS BIGINT) flagged, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (score < 0.4), '') ids FROM i GROUP BY 1, 2")
def a07(s, d):
    low = F.when(F.col("score") < 0.4, F.col("event_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_set(low)), lambda x: x.cast("string")), ",")
    return sequences.islands(obs(s, d).select("tid", "frame", "event_id", "score"), ["tid"], max_gap=2).groupBy("tid", "island").agg(F.count("*").alias("n"), F.count(low).alias("flagged"), ids.alias("ids"))


@query("a09_reason_histogram", f"WITH {DET_SQL} SELECT reason, count(*) n FROM (SELECT unnest([CASE WHEN score < 0.2 THEN 'low_score' END, CASE WHEN w / h < 2.5 THEN 'low_aspect' END, CASE WHEN cx > 90 THEN 'far' END]) reason FROM det) z WHERE reason IS NOT NULL GROUP BY 1")
def a09(s, d):
    why = F.array(F.when(F.col("score") < 0.2, F.lit("low_score")), F.when(F.col("w") / F.col("h") < 2.5, F.lit("low_aspect")), F.when(F.col("cx") > 90, F.lit("far")))
    return det(s, d).select(F.explode(why).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("a12_silhouette", f"WITH {FRAG_SQL}, v AS (SELECT frag_id, obj_id, CAST(centroid AS DOUBLE[]) c FROM frag WHERE centroid IS NOT NULL AND obj_id IS NOT NULL), m AS (SELECT a.frag_id, a.obj_id, b.obj_id o, avg(list_distance(a.c, b.c)) d FROM v a JOIN v b ON a.frag_id <> b.frag_id GROUP BY 1, 2, 3), z AS (SELECT frag_id, max(CASE WHEN obj_id = o THEN d END) a, min(CASE WHEN obj_id <> o THEN d END) b FROM m GROUP BY 1) SELECT frag_id, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 4) s FROM z")
def a12(s, d):
    ship(s)
    return identity.silhouette(frag(s, d).where("centroid IS NOT NULL AND obj_id IS NOT NULL"), "frag_id", "obj_id", "centroid").select("frag_id", r("s").alias("s"))


@query("a15_closest_contact", PAIRS_SQL + ", q AS (SELECT frame, a_event_id e, round(inter/(total-inter), 4) iou FROM p UNION ALL SELECT frame, b_event_id, round(inter/(total-inter), 4) FROM p), z AS (SELECT tid, q.frame, iou, row_number() OVER (PARTITION BY tid ORDER BY iou DESC, q.frame) rn FROM q JOIN det ON det.event_id = q.e) SELECT tid, frame, iou FROM z WHERE rn = 1")
def a15(s, d):
    best = matching.top_matches(det(s, d), digits=4, carry="tid bigint").groupBy("tid").agg(F.max(F.struct("iou", -F.col("frame"))).alias("b"))
    return best.select("tid", (-F.col("b")["col2"]).alias("frame"), "b.iou")


@query("a16_dominant_code", f"WITH {DET_SQL}, c AS (SELECT tid, event_id % 6 code, count(*) n FROM det GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, code) rn FROM c) SELECT tid, code FROM z WHERE rn = 1")
def a16(s, d):
    c = det(s, d).groupBy("tid", (F.col("event_id") % 6).alias("code")).agg(F.count("*").alias("n"))
    return c.groupBy("tid").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))


@query("a17_count_percentile", f"WITH {DET_SQL} SELECT round(quantile_cont(n, 0.95), 4) p95 FROM (SELECT frame, count(*) n FROM det WHERE frame % 3 = 0 GROUP BY 1) z")
def a17(s, d):
    """The stride over frames is the operator's own."""
    return det(s, d).where("frame % 3 = 0").groupBy("frame").agg(F.count("*").alias("n")).agg(r(F.percentile("n", F.lit(0.95))).alias("p95"))


@query("a20_continuation", f"WITH {OBS_SQL}, x AS (SELECT CASE WHEN lead(frame) OVER (PARTITION BY tid ORDER BY frame) = frame + 1 THEN 1.0 ELSE 0.0 END c FROM obs) SELECT round(avg(c), 4) rate, CAST(sum(c) AS BIGINT) pairs, sum(c) >= 100 AND avg(c) >= 0.2 reliable FROM x")
def a20(s, d):
    goes_on = F.lead("frame").over(Window.partitionBy("tid").orderBy("frame")) == F.col("frame") + 1
    x = obs(s, d).select("tid", "frame").select(F.when(goes_on, 1.0).otherwise(0.0).alias("c"))
    return x.agg(r(F.avg("c")).alias("rate"), F.sum("c").cast("long").alias("pairs"), ((F.sum("c") >= 100) & (F.avg("c") >= 0.2)).alias("reliable"))


@query("a22_split_counts", f"WITH {DET_SQL} SELECT CAST(floor(heading / 45) AS BIGINT) bucket, count(*) FILTER (frame % 5 <> 0) train, count(*) FILTER (frame % 5 = 0) val FROM det GROUP BY 1")
def a22(s, d):
    val = F.col("frame") % 5 == 0
    return det(s, d).groupBy(F.floor(F.col("heading") / 45).cast("long").alias("bucket")).agg(F.count(F.when(~val, 1)).alias("train"), F.count(F.when(val, 1)).alias("val"))


# along tracks


@query("w01_index_in_frame", f"WITH {DET_SQL} SELECT event_id, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS i FROM det")
def w01(s, d):
    return det(s, d).select("event_id", (F.row_number().over(Window.partitionBy("frame").orderBy("event_id")) - 1).cast("long").alias("i"))


@query("w05_keyed_islands", f"WITH {DET_SQL}, x AS (SELECT tid, event_id % 2 code, frame, count(*) c FROM det GROUP BY 1, 2, 3), b AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY tid, code ORDER BY frame) <= 1 THEN 0 ELSE 1 END nw FROM x), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY tid, code ORDER BY frame) AS BIGINT) island FROM b) SELECT tid, code, island, min(frame) start_frame, max(frame) end_frame, CAST(sum(c) AS BIGINT) n FROM i GROUP BY 1, 2, 3")
def w05(s, d):
    return sequences.runs(det(s, d).select("tid", (F.col("event_id") % 2).alias("code"), "frame"), ["tid", "code"])


@query("w06_missing_severity", f"WITH {OBS_SQL}, v AS (SELECT tid, frame, CASE WHEN score >= 0.5 THEN score END v FROM obs), k AS (SELECT *, count(v) OVER (PARTITION BY tid ORDER BY frame) k FROM v) SELECT tid, frame, CASE WHEN v IS NULL THEN CAST(count(*) FILTER (v IS NULL) OVER (PARTITION BY tid, k) AS BIGINT) ELSE 0 END severity FROM k")
def w06(s, d):
    o = obs(s, d).select("tid", "frame", F.when(F.col("score") >= 0.5, F.col("score")).alias("v"))
    return sequences.null_runs(o, ["tid"], "v").select("tid", "frame", "severity")


@query("w08_stable_islands", PAIRS_SQL + ", o AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY tid, frame ORDER BY event_id) rn FROM det d) z WHERE rn = 1 AND event_id NOT IN (SELECT a_event_id FROM p UNION ALL SELECT b_event_id FROM p)), b AS (SELECT *, CASE WHEN frame - lag(frame) OVER v = 1 AND abs(((heading - lag(heading) OVER v + 540) % 360) - 180) < 90 THEN 0 ELSE 1 END nw FROM o WINDOW v AS (PARTITION BY tid ORDER BY frame)), i AS (SELECT *, sum(nw) OVER (PARTITION BY tid ORDER BY frame) island FROM b) SELECT tid, min(frame) start_frame, max(frame) end_frame, count(*) n FROM i GROUP BY tid, island HAVING count(*) >= 2")
def w08(s, d):
    """What overlaps no detection of its frame overlaps no first one either."""
    return sequences.stable_islands(obs(s, d).join(matching.isolated(det(s, d)).select("event_id"), "event_id", "left_semi"), ["tid"], 90.0, 2)


@query("w11_filled_edges", f"WITH {OBS_SQL}, v AS (SELECT tid, frame, CASE WHEN score >= 0.3 THEN cx END cx, CASE WHEN score >= 0.3 THEN frame END kf FROM obs), g AS (SELECT *, last_value(cx IGNORE NULLS) OVER a pc, last_value(kf IGNORE NULLS) OVER a pf, first_value(cx IGNORE NULLS) OVER b nc, first_value(kf IGNORE NULLS) OVER b nf FROM (SELECT * FROM v UNION ALL SELECT e.tid, CAST(t.range AS BIGINT), NULL, NULL FROM (SELECT tid, min(frame) lo, max(frame) hi FROM v GROUP BY 1) e, range(0, 100000) t WHERE t.range BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM v WHERE v.tid = e.tid AND v.frame = t.range)) y WINDOW a AS (PARTITION BY tid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY tid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT tid, frame, round(CASE WHEN cx IS NOT NULL THEN cx WHEN pf IS NULL THEN nc WHEN nf IS NULL THEN pc ELSE pc + (frame - pf)*(nc - pc)/(nf - pf) END, 4) cx FROM g")
def w11(s, d):
    o = obs(s, d).select("tid", "frame", F.when(F.col("score") >= 0.3, F.col("cx")).alias("cx"))
    return sequences.filled(o, ["tid"], ["cx"], edges=True).select("tid", "frame", r_half("cx").alias("cx"))


@query("w12_circular_middle", f"WITH {OBS_SQL}, n AS (SELECT tid, frame, heading a, lead(heading) OVER (PARTITION BY tid ORDER BY frame) b FROM obs) SELECT tid, frame, round((a + 0.5*(((b - a + 540) % 360) - 180) + 720) % 360, 4) middle FROM n WHERE b IS NOT NULL")
def w12(s, d):
    n = obs(s, d).select("tid", "frame", F.col("heading").alias("a"), F.lead("heading").over(Window.partitionBy("tid").orderBy("frame")).alias("b"))
    return n.where("b IS NOT NULL").select("tid", "frame", r(angles.interpolate(F.col("a"), F.col("b"), F.lit(0.5))).alias("middle"))


@query("w16_overlap_gap_partner", f"WITH {OBS_SQL}, p AS (SELECT a.frame, a.tid, b.tid o, (least(a.cx+a.w/2, b.cx+b.w/2) - greatest(a.cx-a.w/2, b.cx-b.w/2)) * (least(a.cy+a.h/2, b.cy+b.h/2) - greatest(a.cy-a.h/2, b.cy-b.h/2)) i, a.w*a.h + b.w*b.h t FROM obs a JOIN obs b ON a.frame = b.frame AND a.tid <> b.tid AND abs(a.cx-b.cx) < (a.w+b.w)/2 AND abs(a.cy-b.cy) < (a.h+b.h)/2), g AS (SELECT * FROM (SELECT tid, frame AS bf, lead(frame) OVER (PARTITION BY tid ORDER BY frame) af FROM obs) z WHERE af - bf BETWEEN 2 AND 10), c AS (SELECT g.tid, bf, af, x.o, round(x.i/(x.t-x.i) + y.i/(y.t-y.i), 6) s, greatest(x.i/(x.t-x.i), y.i/(y.t-y.i)) m FROM g JOIN p x ON x.tid = g.tid AND x.frame = bf JOIN p y ON y.tid = g.tid AND y.frame = af AND y.o = x.o), z AS (SELECT *, row_number() OVER (PARTITION BY tid, bf ORDER BY s DESC, o) rn FROM c WHERE m >= 0.05) SELECT tid, bf AS before, af AS after, o AS partner, s AS score FROM z WHERE rn = 1")
def w16(s, d):
    best = matching.gap_partners(obs(s, d), sequences.gaps(obs(s, d), ["tid"], 10), 10, 0.05)
    return best.select("tid", "before", "after", "partner", "score")


@query("w18_heading_signs")
def w18(s, d):
    ship(s)
    known = F.col("score") >= 0.4
    o = obs(s, d).select("tid", "frame", F.when(known, F.col("heading")).alias("heading"), (F.col("heading") % 180).alias("axis"))
    return headings.resolve_signs(o)


@query("w15_predicted_gaps")
def w15(s, d):
    ship(s)
    return headings.predicted_gaps(obs(s, d), 5)


@query("t02_broken_order", f"WITH {OBS_SQL}, l AS (SELECT tid, frame, lag(frame) OVER (PARTITION BY tid ORDER BY frame) before FROM obs) SELECT tid, frame, before FROM l WHERE frame <> before + 1")
def t02(s, d):
    return sequences.broken_order(obs(s, d).select("tid", "frame"), ["tid"])


@query("t08_slots")
def t08(s, d):
    ship(s)
    return identity.slots(obs(s, d).select(F.expr("tid div 16").alias("video"), "frame", "tid"), "video")


# order


@query("o01_total_order", f"WITH {DET_SQL} SELECT event_id, row_number() OVER (PARTITION BY tid ORDER BY score DESC, frame, event_id) AS place FROM det")
def o01(s, d):
    w = Window.partitionBy("tid").orderBy(F.desc("score"), "frame", "event_id")
    return det(s, d).select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("o05_top_partners", PAIRS_SQL + ", q AS (SELECT a_event_id event_id, b_event_id other, round(inter/(total-inter), 6) iou FROM p UNION ALL SELECT b_event_id, a_event_id, round(inter/(total-inter), 6) FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY iou DESC, other) AS place FROM q) SELECT event_id, other, place FROM z WHERE place <= 2")
def o05(s, d):
    return matching.top_matches(det(s, d), 2, digits=6).select("event_id", "other", "place")


@query("o07_natural_key", f"WITH {DET_SQL} SELECT event_id, array_to_string(list_transform(regexp_extract_all('Cam' || tid || '_' || frame, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE lower(x) END), '') AS sort_key FROM det")
def o07(s, d):
    name = F.concat(F.lit("Cam"), F.col("tid").cast("string"), F.lit("_"), F.col("frame").cast("string"))
    return det(s, d).select("event_id", reshape.natural_key(name).alias("sort_key"))


# sets and shapes


@query("u01_two_passes", f"WITH {DET_SQL} SELECT event_id, 'backward' AS pass FROM det WHERE frame < 70 UNION ALL SELECT event_id, 'forward' FROM det WHERE frame >= 70")
def u01(s, d):
    rows = det(s, d).select("event_id", "frame")
    return rows.where("frame < 70").withColumn("pass", F.lit("backward")).unionByName(rows.where("frame >= 70").withColumn("pass", F.lit("forward"))).drop("frame")


@query("u03_frame_union", f"WITH {OBS_SQL}, f AS (SELECT DISTINCT tid // 2 AS pair, frame FROM obs), g AS (SELECT pair, unnest(range(0, max(frame) + 1)) AS frame FROM f GROUP BY 1) SELECT g.pair, g.frame, f.frame IS NOT NULL present FROM g LEFT JOIN f ON f.pair = g.pair AND f.frame = g.frame")
def u03(s, d):
    o = obs(s, d).withColumn("pair", F.expr("tid div 2"))
    both = o.where("tid % 2 = 0").select("pair", "frame").union(o.where("tid % 2 = 1").select("pair", "frame")).distinct()
    return reshape.dense(both.withColumn("present", F.lit(True)), by=["pair"]).select("pair", "frame", F.coalesce("present", F.lit(False)).alias("present"))


@query("u05_frame_sets", f"WITH {OBS_SQL}, a AS (SELECT tid // 2 AS pair, frame FROM obs WHERE tid % 2 = 0), b AS (SELECT tid // 2 AS pair, frame FROM obs WHERE tid % 2 = 1) SELECT pair, frame, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x UNION ALL SELECT pair, frame, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y")
def u05(s, d):
    o = obs(s, d).select(F.expr("tid div 2").alias("pair"), "frame", (F.col("tid") % 2).alias("k"))
    return reshape.frame_sets(*[o.where(F.col("k") == k).drop("k") for k in (0, 1)])


@query("u06_keep_last_dense", f"WITH {DET_SQL}, l AS (SELECT tid, frame, max(event_id) event_id FROM det GROUP BY 1, 2), g AS (SELECT tid, unnest(range(0, max(frame) + 1)) AS frame FROM l GROUP BY 1) SELECT g.tid, g.frame, l.event_id FROM g LEFT JOIN l ON l.tid = g.tid AND l.frame = g.frame")
def u06(s, d):
    return reshape.dense(reshape.keep_last(det(s, d).select("tid", "frame", "event_id"), ["tid", "frame"], "event_id"), by=["tid"])


@query("u08_wide_to_long", f"WITH {STRUNG_SQL} SELECT frame, tid, cx, cy FROM strung")
def u08(s, d):
    return reshape.to_long(reshape.to_wide(strung(s, d), [0, 1, 2, 3], ["cx", "cy"]), ["cx", "cy"])


@query("u11_swap_safety", f"WITH {OBS_SQL}, o AS (SELECT tid, frame FROM obs WHERE frame BETWEEN 10 AND 20), t AS (SELECT DISTINCT tid FROM obs), p AS (SELECT x.tid a, y.tid b FROM t x JOIN t y ON y.tid = x.tid + 1), e AS (SELECT a, b, frame FROM p JOIN o ON o.tid IN (a, b) GROUP BY 1, 2, 3 HAVING count(*) = 1), n AS (SELECT a, b, count(*) c FROM e GROUP BY 1, 2) SELECT a, b, coalesce(c, 0) differing, c IS NULL AS safe FROM p LEFT JOIN n USING (a, b)")
def u11(s, d):
    o = obs(s, d).select("tid", "frame")
    ids = o.select("tid").distinct()
    pairs = ids.select(F.col("tid").alias("a"), (F.col("tid") + 1).alias("b")).join(ids.select(F.col("tid").alias("b")), "b", "left_semi")
    return identity.swap_safety(o, pairs.select("a", "b"), 10, 20)


@query("u13_pose_slots", f"WITH {OBS_SQL}, z AS (SELECT *, dense_rank() OVER (ORDER BY tid) - 1 AS slot FROM obs) SELECT frame, max(CASE WHEN slot = 0 THEN cx END) x0, max(CASE WHEN slot = 1 THEN cx END) x1, max(CASE WHEN slot = 2 THEN cx END) x2 FROM z WHERE slot < 3 GROUP BY 1")
def u13(s, d):
    """The lowest ids become slots; only the distinct ids are ranked in one task."""
    o = obs(s, d).select("tid", "frame", F.col("cx").alias("x"))
    slots = o.select("tid").distinct().orderBy("tid").limit(3).withColumn("slot", F.row_number().over(Window.orderBy("tid")) - 1)
    return reshape.to_wide(o.join(F.broadcast(slots), "tid"), [0, 1, 2], ["x"], ident="slot")


# geometry


@query("f02_class_or_degrees", f"WITH {DET_SQL}, v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 8 AS DOUBLE) ELSE heading - 90 END a FROM det) SELECT event_id, round(CASE WHEN abs(a - round(a)) <= 1E-6 AND round(a) BETWEEN 0 AND 7 THEN round(a)*45 ELSE (a + 360) % 360 END, 4) AS degrees FROM v")
def f02(s, d):
    a = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 8).cast("double")).otherwise(F.col("heading") - 90)
    return det(s, d).select("event_id", r(angles.class_or_degrees(a)).alias("degrees"))


@query("f03_unit_vectors", f"WITH {DET_SQL} SELECT event_id, round(sin(radians(heading)), 4) x, round(-cos(radians(heading)), 4) y, CASE WHEN abs(cx - 50) + abs(cy - 500) > 1E-3 THEN round((degrees(atan2(cx - 50, 500 - cy)) + 360) % 360, 4) END bearing FROM det")
def f03(s, d):
    far = F.abs(F.col("cx") - 50) + F.abs(F.col("cy") - 500) > 1e-3
    return det(s, d).select("event_id", r(angles.unit_x(F.col("heading"))).alias("x"), r(angles.unit_y(F.col("heading"))).alias("y"), F.when(far, r(angles.from_vector(F.col("cx") - 50, F.col("cy") - 500))).alias("bearing"))


@query("f06_class_distance", f"WITH {DET_SQL} SELECT event_id, least(abs(event_id % 8 - tid % 8), 8 - abs(event_id % 8 - tid % 8)) steps, 45 * least(abs(event_id % 8 - tid % 8), 8 - abs(event_id % 8 - tid % 8)) AS apart FROM det")
def f06(s, d):
    steps = angles.class_distance(F.col("event_id") % 8, F.col("tid") % 8)
    return det(s, d).select("event_id", steps.alias("steps"), (steps * 45).alias("apart"))


@query("f12_unwrapped", f"WITH {DET_SQL} SELECT event_id, round(heading - round_even((heading - (score*2000 - 1000.3)) / 360, 0)*360, 4) AS near FROM det")
def f12(s, d):
    return det(s, d).select("event_id", r(angles.near(F.col("heading"), F.col("score") * 2000 - 1000.3, 360.0)).alias("near"))


@query("f13_long_side_first", f"WITH {DET_SQL} SELECT event_id, greatest(w, h*3) AS long_side, least(w, h*3) AS short_side, CASE WHEN w >= h*3 THEN heading ELSE (heading + 90) % 360 END AS axis FROM det")
def f13(s, d):
    return boxes.long_side_first(det(s, d).withColumn("h", F.col("h") * 3)).select("event_id", F.col("w").alias("long_side"), F.col("h").alias("short_side"), F.col("heading").alias("axis"))


@query("f15_corner_codec", f"WITH {DET_SQL} SELECT event_id, " + ", ".join(f"round({sql_corner(k)[i]}, 4) AS {c}{k}" for i, c in enumerate("xy") for k in range(4)) + " FROM det")
def f15(s, d):
    return det(s, d).withColumn("p", corners()).select("event_id", *[r(F.col("p")[k][c]).alias(f"{c}{k}") for c in "xy" for k in range(4)])


@query("f16_area_and_centroid", f"WITH {DET_SQL} SELECT event_id, round(w*h, 4) area, round(cx, 4) x, round(cy, 4) y FROM det")
def f16(s, d):
    rows = det(s, d).withColumn("p", corners()).withColumn("c", polygons.centroid(F.col("p")))
    return rows.select("event_id", r(F.abs(polygons.area(F.col("p")))).alias("area"), r("c.x").alias("x"), r("c.y").alias("y"))


@query("f17_axis_length", f"WITH {DET_SQL} SELECT event_id, round(abs(sin(radians(heading - 30)) * sin(radians(heading)) + cos(radians(heading - 30)) * cos(radians(heading)))*w + 0.5*h, 4) AS length FROM det")
def f17(s, d):
    """30 degrees off the heading."""
    return det(s, d).select("event_id", r(polygons.extent(corners(), F.col("heading") - 30)).alias("length"))


@query("f18_edge_zone", f"WITH {DET_SQL} SELECT event_id, least(cx - least(w/2, 10), 100 - cx - least(w/2, 10)) <= 6 OR least(cy - least(w/2, 10), 1000 - cy - least(w/2, 10)) <= 6 AS at_edge FROM det")
def f18(s, d):
    """In a picture of 100 by 1000, with half extents of at most 10 and a margin of 6."""
    return det(s, d).select("event_id", boxes.at_edge(F.col("cx"), F.col("cy"), F.col("w") / 2, 100.0, 1000.0, 10.0, 6.0).alias("at_edge"))


@query("f19_right_angle", f"WITH {DET_SQL} SELECT event_id, 1000 - cy AS x, cx AS y, (heading + 90) % 360 AS heading, (event_id % 8 + 2) % 8 AS klass FROM det")
def f19(s, d):
    """A picture 1000 high, turned by 90 degrees clockwise."""
    return det(s, d).select("event_id", (1000 - F.col("cy")).alias("x"), F.col("cx").alias("y"), angles.wrap(F.col("heading") + 90).alias("heading"), ((F.col("event_id") % 8 + 2) % 8).alias("klass"))


@query("f10_canonical_corners", f"WITH {DET_SQL}, c AS (" + " UNION ALL ".join(f"SELECT event_id, {k} AS k, {sql_corner(k)[0]} x, {sql_corner(k)[1]} y FROM det" for k in range(4)) + "), z AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(y, 6), x) rn FROM c) SELECT event_id, round(x, 4) x, round(y, 4) y FROM z WHERE rn = 1")
def f10(s, d):
    return det(s, d).select("event_id", polygons.canonical(corners()).alias("p")).select("event_id", r(F.col("p")[0]["x"]).alias("x"), r(F.col("p")[0]["y"]).alias("y"))


@query("f11_aligned_corners", f"WITH {DET_SQL} SELECT event_id, round({sql_corner(0)[0]}, 4) x, round({sql_corner(0)[1]}, 4) y FROM det")
def f11(s, d):
    """A polygon that begins elsewhere, brought back to begin like its original."""
    rows = det(s, d).select("event_id", corners().alias("p"))
    back = polygons.aligned(polygons.rotated(F.col("p"), F.col("event_id") % 4), F.col("p"))
    return rows.select("event_id", r(back[0]["x"]).alias("x"), r(back[0]["y"]).alias("y"))


# text


@query("f20_label_line", f"WITH {DET_SQL} SELECT event_id, printf('%d %.6f %.6f', event_id % 8, cx/100, cy/1000) line FROM det")
def f20(s, d):
    return det(s, d).select("event_id", F.format_string("%d %.6f %.6f", F.col("event_id") % 8, F.col("cx") / 100, F.col("cy") / 1000).alias("line"))


@query("f31_frame_of_stem", f"WITH {DET_SQL} SELECT event_id, frame, tid FROM det")
def f31(s, d):
    """Names are made and read again."""
    names = det(s, d).select("event_id", F.format_string("clip_%06d", "frame").alias("stem"), F.concat(F.lit("track"), F.col("tid").cast("string")).alias("track"))
    return names.select("event_id", reshape.trailing_number("stem").alias("frame"), reshape.trailing_number("track").alias("tid"))


@query("f34_frame_digest", f"WITH {DET_SQL} SELECT frame, sha256(string_agg(event_id || ':' || tid, ',' ORDER BY event_id)) digest FROM det GROUP BY 1")
def f34(s, d):
    each = F.struct("event_id", F.concat_ws(":", F.col("event_id").cast("string"), F.col("tid").cast("string")).alias("t"))
    return det(s, d).groupBy("frame").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), ","), 256).alias("digest"))


@query("f35_numbers", f"WITH {DET_SQL} SELECT event_id, CASE WHEN score*8 = floor(score*8) THEN printf('%d', CAST(score*8 AS BIGINT)) ELSE printf('%.6f', score*8) END AS number FROM det")
def f35(s, d):
    x = F.col("score") * 8
    return det(s, d).select("event_id", reshape.number_text(x).alias("number"))


@query("f36_seconds_to_frames", f"WITH {DET_SQL} SELECT event_id, greatest(1, CAST(round_even(score * 25, 0) AS BIGINT)) frames, printf('%02d:%02d:%02d', (event_id*7) // 3600, (event_id*7) // 60 % 60, (event_id*7) % 60) elapsed FROM det")
def f36(s, d):
    t = F.col("event_id") * 7
    return det(s, d).select("event_id", F.greatest(F.lit(1), F.bround(F.col("score") * 25, 0).cast("long")).cast("long").alias("frames"), F.format_string("%02d:%02d:%02d", F.expr("event_id * 7 div 3600"), F.expr("event_id * 7 div 60") % 60, t % 60).alias("elapsed"))


@query("f37_lenient_numbers", "SELECT event_id, TRY_CAST(x AS DOUBLE) AS number FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE '' END x FROM events) z")
def f37(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    x = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise("")
    return e.select("event_id", x.try_cast("double").alias("number"))


# samples


@query("r03_stratified_trim", f"WITH {DET_SQL}, b AS (SELECT CAST(floor(heading / 45) AS BIGINT) k, event_id FROM det), n AS (SELECT k, count(*) n FROM b GROUP BY 1), f AS (SELECT *, n*800 // sum(n) OVER () fl, (n*800) % sum(n) OVER () rest FROM n), a AS (SELECT k, least(n, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= 800 - sum(fl) OVER () THEN 1 ELSE 0 END) take FROM f), z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (event_id * 7919) % 104729, event_id) rn FROM b) SELECT k AS bucket, event_id FROM z JOIN a USING (k) WHERE rn <= take")
def r03(s, d):
    """The order in a bucket is a fixed permutation's, so that SQL can follow it."""
    rows = det(s, d).select(F.floor(F.col("heading") / 45).cast("long").alias("bucket"), "event_id")
    take = statistics.apportion(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", 800)
    w = Window.partitionBy("bucket").orderBy((F.col("event_id") * 7919) % 104729, "event_id")
    return rows.withColumn("_r", F.row_number().over(w)).join(take.select("bucket", "allocated"), "bucket").where("_r <= allocated").select("bucket", "event_id")


@query("r07_negative_pairs", f"WITH {FRAG_SQL} SELECT a.frag_id a, b.frag_id b FROM frag a JOIN frag b ON a.frag_id < b.frag_id AND a.obj_id <> b.obj_id AND a.start_frame <= b.end_frame + 20 AND b.start_frame <= a.end_frame + 20")
def r07(s, d):
    f = frag(s, d).select("frag_id", "obj_id", "start_frame", (F.col("end_frame") + 20).alias("end_frame"))
    return sampling.overlapping_intervals(f, 64).where("a_obj <> b_obj").select("a", "b")


@query("r08_round_robin", f"WITH {DET_SQL}, z AS (SELECT event_id, tid, row_number() OVER (PARTITION BY tid ORDER BY event_id) AS round FROM det) SELECT event_id, round FROM (SELECT *, row_number() OVER (ORDER BY round, tid) q FROM z) y WHERE q <= 400")
def r08(s, d):
    """A preview of 400: the first of every track, then the second, and so on. Only the top 400 come together."""
    z = det(s, d).select("event_id", "tid", F.row_number().over(Window.partitionBy("tid").orderBy("event_id")).cast("long").alias("round"))
    return z.orderBy("round", "tid").limit(400).select("event_id", "round")
