"""Registered queries: staged tracking, contact episodes, rescues, angles, files, splits and reuse."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog_more import sql_corner
from .functions import angles, boxes, codes, fitting
from .operators import blobs, episodes, headings, identity, matching, reshape, resolver, sampling, sequences, statistics
from .plans import reuse
from .plans.views import DET_SQL, FRAG_SQL, OBS_SQL, STRUNG_SQL, det, frag, indexed, obs, strung
from .registry import PAIRS_SQL, query, r
from .session import fresh_path, ship
from .sources import lines, tables
from .streaming import staged

# angles


@query("f04_circular_distance", f"WITH {DET_SQL} SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0 ELSE abs((heading - (event_id*53 % 360) + 180 + 720) % 360 - 180) END, 4) AS apart FROM det")
def f04(s, d):
    other = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 53 % 360).cast("double"))
    return det(s, d).select("event_id", r(angles.distance(F.col("heading"), other)).alias("apart"))


@query("f05_axis_distance", f"WITH {DET_SQL}, z AS (SELECT event_id, (heading - event_id*53 % 360 + 720) % 180 a FROM det) SELECT event_id, round(least(a, 180 - a), 4) AS apart FROM z")
def f05(s, d):
    return det(s, d).select("event_id", r(angles.axis_distance(F.col("heading"), (F.col("event_id") * 53 % 360).cast("double"))).alias("apart"))


@query("f07_vector_class", f"WITH {DET_SQL} SELECT event_id, CASE WHEN sqrt((cx-50.003)*(cx-50.003) + (cy-501)*(cy-501)) > 1E-6 THEN CAST(floor(((degrees(atan2(cx - 50.003, 501 - cy)) + 720 + 22.5) % 360) / 45) AS BIGINT) END AS class FROM det")
def f07(s, d):
    return det(s, d).select("event_id", angles.vector_to_class(F.col("cx") - 50.003, F.col("cy") - 501.0).alias("class"))


_AXIS = "a AS (SELECT *, CASE WHEN w >= h*3 THEN heading ELSE (heading + 90) % 360 END axis, (event_id % 8) * 45.0 AS klass FROM det), c AS (SELECT *, round(cos(radians(axis - klass)), 9) along FROM a)"


def _along(s, d):
    """det with axis (the longer side's), klass (degrees) and along, the cosine between them."""
    axis = F.when(F.col("w") >= F.col("h") * 3, F.col("heading")).otherwise(angles.wrap(F.col("heading") + 90.0))
    rows = det(s, d).withColumn("axis", axis).withColumn("klass", angles.class_to_degrees(F.col("event_id") % 8))
    return rows.withColumn("along", F.round(F.cos(F.radians(F.col("axis") - F.col("klass"))), 9))


@query("f08_long_axis", f"WITH {DET_SQL}, {_AXIS} SELECT event_id, axis, CASE WHEN along >= 0 THEN axis ELSE (axis + 180) % 360 END AS signed_axis, abs(along) >= cos(radians(67.5)) AS fits FROM c")
def f08(s, d):
    sign = F.when(F.col("along") >= 0, F.col("axis")).otherwise(angles.wrap(F.col("axis") + 180.0))
    return _along(s, d).select("event_id", "axis", sign.alias("signed_axis"), (F.abs("along") >= F.cos(F.radians(F.lit(67.5)))).alias("fits"))


@query("p04_normalised_headings", f"WITH {DET_SQL}, {_AXIS} SELECT event_id, frame, CASE WHEN along >= 0 THEN axis ELSE (axis + 180) % 360 END AS heading, row_number() OVER (PARTITION BY frame ORDER BY score DESC, event_id) - 1 AS det_index FROM c WHERE abs(along) >= cos(radians(67.5))")
def p04(s, d):
    rows = _along(s, d).where(F.abs("along") >= F.cos(F.radians(F.lit(67.5))))
    sign = F.when(F.col("along") >= 0, F.col("axis")).otherwise(angles.wrap(F.col("axis") + 180.0))
    index = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), "event_id")) - 1
    return rows.select("event_id", "frame", sign.alias("heading"), index.cast("long").alias("det_index"))


def derived_seed(master: int, *parts: object) -> int:
    """An unsigned 64-bit number that depends on its arguments' text alone."""
    held = hashlib.blake2b("\x1f".join(str(x) for x in (int(master), *parts)).encode(), digest_size=8).digest()
    return int.from_bytes(held, "little")


@query("f33_derived_seeds")
def f33(s, d):
    """No built-in function computes this digest, so it runs in Arrow batches."""

    def run(batches):
        for p in batches:
            yield p.assign(seed=[str(derived_seed(42, "frame", f, t)) for f, t in zip(p["frame"], p["tid"])])

    ship(s)
    return det(s, d).select("event_id", "frame", "tid").mapInPandas(run, "event_id bigint, frame bigint, tid bigint, seed string")


# staged tracking


def _videos(s, d):
    """Sixteen users are one video, so there are more videos where there are more users."""
    return det(s, d).select(F.floor(F.col("tid") / 16).cast("string").alias("video"), "frame", F.col("event_id").alias("det"), "score", *staged.VALUES)


@query("t03_fixed_population")
def t03(s, d):
    ship(s)
    return staged.track_population(_videos(s, d), 3)


@query("t04_retractions")
def t04(s, d):
    ship(s)
    return staged.retractions(_videos(s, d), 3)


@query("t05_variable_population")
def t05(s, d):
    ship(s)
    return staged.track_variable(_videos(s, d), width=100.0, height=1000.0, margin=staged.edge_margin(34.0, 1.0, 2, 100.0, 1000.0), inner_hits=3)


@query("w19_static_windows")
def w19(s, d):
    return staged.static_windows(obs(s, d), ["tid"], 6, presence=0.5, iou=0.0, displacement=20.0)


# episodes and identities


def _contacts(s, d):
    """Contacts between ids, of which sixteen are one video."""
    rows = det(s, d).withColumn("frame", F.expr("tid div 16 * 100000 + frame"))  # boxes meet within a video only
    p = matching.overlapping_pairs(rows).select("a_event_id", "b_event_id")
    ids = det(s, d).select("event_id", "tid", "frame")
    p = p.join(ids.toDF("a_event_id", "a", "frame"), "a_event_id").join(ids.select("event_id", "tid").toDF("b_event_id", "b"), "b_event_id")
    return p.where("a <> b").select(F.expr("string(a div 16)").alias("video"), "frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _episodes(s, d):
    ship(s)
    return episodes.contact_episodes(_contacts(s, d), obs(s, d).select(F.expr("string(tid div 16)").alias("video"), "tid", "frame"))


@query("w22_contact_episodes")
def w22(s, d):
    return _episodes(s, d).withColumn("roster", F.array_join("roster", ","))


_CELLS = "cells AS (SELECT tid % 5 AS episode, tid, frame, event_id % 7 = 0 AS filled, CASE WHEN event_id % 3 = 0 THEN round(score, 3) ELSE 0 END iou FROM obs)"


def _cells(s, d):
    rows = obs(s, d)
    return rows.select((F.col("tid") % 5).alias("episode"), "tid", "frame", (F.col("event_id") % 7 == 0).alias("filled"), F.when(F.col("event_id") % 3 == 0, F.round("score", 3)).otherwise(0.0).alias("iou"))


@query("w23_episodes_at_risk", f"WITH {OBS_SQL}, {_CELLS} SELECT episode, max(iou) most_iou, bool_or(filled AND frame < 1) AS trigger, max(iou) >= 0.99 OR bool_or(filled AND frame < 1) AS risky FROM cells GROUP BY 1")
def w23(s, d):
    c = _cells(s, d)
    return episodes.at_risk(c.select("episode").distinct(), c, c.withColumn("filled", F.expr("filled AND frame < 1")), 0.99)


@query("w24_seams", f"WITH {OBS_SQL}, {_CELLS}, z AS (SELECT episode, tid, arg_min(frame, CASE WHEN filled AND iou > 0 THEN -iou*1000000 + frame END) f, arg_min(frame, CASE WHEN iou > 0 THEN -iou*1000000 + frame END) o FROM cells GROUP BY 1, 2), e AS (SELECT episode, CAST(floor((min(frame) + max(frame)) / 2) AS BIGINT) m FROM cells GROUP BY 1) SELECT episode, min(coalesce(f, o, m)) AS seam FROM z JOIN e USING (episode) GROUP BY 1")
def w24(s, d):
    return episodes.seams(_cells(s, d), ["episode"])


#: More than any frame's number.
_FRAMES = 1 << 31


_MATCHINGS = f"""WITH RECURSIVE {OBS_SQL}, z AS (SELECT tid // 4 AS roster, frame, event_id, cx, cy FROM obs),
c AS (SELECT a.roster, a.frame, a.event_id AS source, b.event_id AS target, sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) AS cost FROM z a JOIN z b ON a.roster = b.roster AND b.frame = a.frame + 1),
k AS (SELECT roster, frame, count(DISTINCT source) n, count(DISTINCT target) m, list_sort(list_distinct(list(source))) ss, list_sort(list_distinct(list(target))) ts FROM c GROUP BY 1, 2),
o AS (SELECT c.roster, c.frame, n > m AS turned, least(n, m) AS n, CASE WHEN n > m THEN list_position(ts, target) ELSE list_position(ss, source) END AS i, CASE WHEN n > m THEN source ELSE target END AS p, CASE WHEN n > m THEN target ELSE source END AS q, cost FROM c JOIN k USING (roster, frame)),
w AS (SELECT roster, frame, turned, n, 1 AS i, [p] AS used, [q] AS own, cost AS total FROM o WHERE i = 1 UNION ALL SELECT w.roster, w.frame, w.turned, w.n, w.i + 1, list_append(used, o.p), list_append(own, o.q), total + cost FROM w JOIN o ON o.roster = w.roster AND o.frame = w.frame AND o.i = w.i + 1 AND NOT list_contains(used, o.p)),
r AS (SELECT *, row_number() OVER (PARTITION BY roster, frame ORDER BY total) rn, lead(total) OVER (PARTITION BY roster, frame ORDER BY total) nxt FROM w WHERE i = n),
b AS (SELECT roster, frame, turned, unnest(own) AS q, unnest(used) AS p FROM r WHERE rn = 1 AND (nxt IS NULL OR nxt >= 1.5 * total))
SELECT roster, frame, CASE WHEN turned THEN p ELSE q END AS source, CASE WHEN turned THEN q ELSE p END AS target FROM b"""


@query("j25_unique_matchings", _MATCHINGS)
def j25(s, d):
    """Four ids are one roster, matched from each frame to the next."""
    roster = F.floor(F.col("tid") / 4)
    rows = obs(s, d).select(roster.alias("roster"), "tid", "frame", "event_id", "cx", "cy")
    cell = lambda f: (F.col("roster") * _FRAMES + f).alias("cell")
    here = rows.select(cell(F.col("frame")), F.col("event_id").alias("source"), "cx", "cy")
    there = rows.where("frame > 0").select(cell(F.col("frame") - 1), F.col("event_id").alias("target"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    costs = here.join(there, "cell").select("cell", "source", "target", F.sqrt(dx * dx + dy * dy).alias("cost"))
    return episodes.unique_matchings(costs, "cell").select(F.floor(F.col("cell") / _FRAMES).alias("roster"), (F.col("cell") % _FRAMES).alias("frame"), "source", "target")


_PIVOT = 2500
#: Medians of each object's fragments before the pivot, and its last and first fragment around it.
_PROTOTYPES = f"f AS (SELECT * FROM frag WHERE centroid IS NOT NULL AND obj_id IS NOT NULL), p AS (SELECT obj_id, list(v ORDER BY i) c FROM (SELECT obj_id, i, quantile_cont(CAST(centroid[CAST(i AS INT)] AS DOUBLE), 0.5) v FROM f, range(1, 65) t(i) WHERE end_frame < {_PIVOT} GROUP BY 1, 2) z GROUP BY 1), b AS (SELECT obj_id, arg_max(CAST(centroid AS DOUBLE[]), end_frame) c FROM f WHERE end_frame < {_PIVOT} GROUP BY 1), n AS (SELECT obj_id, arg_min(CAST(centroid AS DOUBLE[]), start_frame) c FROM f WHERE start_frame > {_PIVOT} GROUP BY 1)"
_COSTS = ", ".join(f"list_distance({k}{i}.c, p{j}.c) {name}{i}{j}" for k, name in (("b", "pre"), ("n", "post")) for i in (1, 2) for j in (1, 2))
_ROSTER = f"k AS (SELECT p1.obj_id a, p2.obj_id b, {_COSTS} FROM p p1 JOIN p p2 ON p2.obj_id = p1.obj_id + 1 JOIN b b1 ON b1.obj_id = p1.obj_id JOIN b b2 ON b2.obj_id = p2.obj_id JOIN n n1 ON n1.obj_id = p1.obj_id JOIN n n2 ON n2.obj_id = p2.obj_id)"


def _rescue_costs(s, d):
    f = frag(s, d).where("centroid IS NOT NULL AND obj_id IS NOT NULL")
    past = f.where(F.col("end_frame") < _PIVOT)
    p = episodes.vectors(statistics.centroids(past, "obj_id", "centroid", median=True), ["obj_id"])
    b = past.groupBy("obj_id").agg(F.max_by("centroid", "end_frame").alias("pre"))
    n = f.where(F.col("start_frame") > _PIVOT).groupBy("obj_id").agg(F.min_by("centroid", "start_frame").alias("post"))
    each = p.join(b, "obj_id").join(n, "obj_id")
    one = each.select(F.col("obj_id").alias("a"), (F.col("obj_id") + 1).alias("b"), *[F.col(c).alias(f"{c}1") for c in ("vector", "pre", "post")])
    two = each.select(F.col("obj_id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("vector", "pre", "post")])
    pairs = one.join(two, "b")
    return pairs.select("a", "b", *[identity.euclid(F.col(f"{k}{i}"), F.col(f"vector{j}")).alias(f"{k}{i}{j}") for k in ("pre", "post") for i in (1, 2) for j in (1, 2)])


@query("j27_prototype_rescue", f"WITH {FRAG_SQL}, {_PROTOTYPES}, {_ROSTER} SELECT a, b, round(post12 + post21, 4) swap_cost, CASE WHEN pre11 + pre22 < pre12 + pre21 AND post12 + post21 < post11 + post22 THEN 'swap' ELSE 'abstain' END decision FROM k")
def j27(s, d):
    return episodes.prototype_rescue(_rescue_costs(s, d)).select("a", "b", F.round(F.expr("post12 + post21"), 4).alias("swap_cost"), "decision")


@query("j28_one_sided_rescue", f"WITH {FRAG_SQL}, {_PROTOTYPES}, {_ROSTER} SELECT a, b, CASE WHEN greatest(post11, post22) < 5 AND post11 < least(post12, post21) AND post22 < least(post12, post21) THEN 'identity' WHEN greatest(post12, post21) < 5 AND post12 < least(post11, post22) AND post21 < least(post11, post22) THEN 'swap' ELSE 'abstain' END decision FROM k")
def j28(s, d):
    k = _rescue_costs(s, d)
    return k.select("a", "b", episodes.one_sided(*[F.col(f"post{x}") for x in ("11", "12", "21", "22")]).alias("decision"))


@query("a13_cohort_silhouette", f"WITH {FRAG_SQL}, v AS (SELECT frag_id, obj_id, CAST(centroid AS DOUBLE[]) c, start_frame // 200 AS era FROM frag WHERE centroid IS NOT NULL AND obj_id IS NOT NULL), e AS (SELECT era FROM v GROUP BY 1 ORDER BY count(DISTINCT obj_id) DESC, era LIMIT 1), h AS (SELECT DISTINCT obj_id FROM v JOIN e USING (era)), u AS (SELECT v.* FROM v JOIN h USING (obj_id)), m AS (SELECT a.frag_id, a.obj_id, b.obj_id o, avg(list_distance(a.c, b.c)) d FROM u a JOIN u b ON a.frag_id <> b.frag_id GROUP BY 1, 2, 3), z AS (SELECT frag_id, max(CASE WHEN obj_id = o THEN d END) a, min(CASE WHEN obj_id <> o THEN d END) b FROM m GROUP BY 1) SELECT frag_id, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 4) s FROM z")
def a13(s, d):
    """Labels are the objects of the time span in which most of them are seen."""
    ship(s)
    f = frag(s, d).where("centroid IS NOT NULL AND obj_id IS NOT NULL").withColumn("era", F.floor(F.col("start_frame") / 200))
    best = f.groupBy("era").agg(F.countDistinct("obj_id").alias("n")).agg(F.max_by("era", F.struct("n", -F.col("era"))).alias("era"))
    cohort = f.join(F.broadcast(best), "era").select("obj_id").distinct()  # one row
    return identity.silhouette(f.join(cohort, "obj_id", "left_semi"), "frag_id", "obj_id", "centroid").select("frag_id", r("s").alias("s"))


# summaries


@query("a19_reference_scale", f"WITH {OBS_SQL}, c AS (SELECT tid, quantile_cont(w*h, 0.5) m FROM obs GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT m FROM c WHERE (SELECT count(*) FROM c) >= 3 UNION ALL SELECT w*h FROM obs WHERE (SELECT count(*) FROM c) < 3) SELECT round(quantile_cont(m, 0.1), 4) low, round(quantile_cont(m, 0.5), 4) middle, round(quantile_cont(m, 0.99), 4) high FROM v")
def a19(s, d):
    return statistics.reference_scale(obs(s, d).withColumn("area", F.expr("w*h")), "tid", "area").select(*[r(c).alias(c) for c in ("low", "middle", "high")])


@query("a21_background", f"WITH {DET_SQL} SELECT tid AS x, CAST(cy AS BIGINT) % 50 AS y, CAST(floor(quantile_cont(floor(cx), 0.5)) AS BIGINT) med, CAST(max(floor(cx)) AS BIGINT) hi, CAST(min(floor(cx)) AS BIGINT) lo, CAST(floor(avg(floor(cx))) AS BIGINT) mean FROM det GROUP BY 1, 2")
def a21(s, d):
    p = det(s, d).select(F.col("tid").alias("x"), (F.col("cy").cast("long") % 50).alias("y"), F.floor("cx").alias("v"))
    whole = lambda c: F.floor(c).cast("long")
    return p.groupBy("x", "y").agg(whole(F.percentile("v", F.lit(0.5))).alias("med"), F.max("v").alias("hi"), F.min("v").alias("lo"), whole(F.avg("v")).alias("mean"))


# sequences


@query("w21_edited_heights", f"WITH {OBS_SQL}, z AS (SELECT *, max(CASE WHEN event_id % 3 <> 0 THEN frame END) OVER a fa, min(CASE WHEN event_id % 3 <> 0 THEN frame END) OVER b fb FROM obs WINDOW a AS (PARTITION BY tid ORDER BY frame), b AS (PARTITION BY tid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT z.event_id, round(CASE WHEN z.event_id % 3 <> 0 OR fa IS NULL OR fb IS NULL THEN z.h ELSE x.h + (y.h - x.h) * (z.frame - fa) / (fb - fa) END, 4) h FROM z LEFT JOIN obs x ON x.tid = z.tid AND x.frame = z.fa LEFT JOIN obs y ON y.tid = z.tid AND y.frame = z.fb")
def w21(s, d):
    return sequences.between_anchors(obs(s, d).withColumn("edited", F.expr("event_id % 3 = 0")), ["tid"], "h", "edited").select("event_id", r("h").alias("h"))


@query("s07_order_violations", f"WITH {OBS_SQL}, l AS (SELECT tid, frame - event_id % 3 AS position, lag(frame - event_id % 3) OVER (PARTITION BY tid ORDER BY frame) before FROM obs) SELECT tid, count(*) violations FROM l WHERE before >= position GROUP BY 1")
def s07(s, d):
    rows = obs(s, d).select("tid", "frame", F.expr("frame - event_id % 3").alias("position"))
    before = F.lag("position").over(Window.partitionBy("tid").orderBy("frame"))
    return rows.withColumn("before", before).where("before >= position").groupBy("tid").agg(F.count("*").alias("violations"))


@query("u02_parts_joined", f"WITH {DET_SQL} SELECT frame, event_id, row_number() OVER (PARTITION BY frame ORDER BY event_id) AS place FROM det")
def u02(s, d):
    rows = det(s, d).select("frame", "event_id")
    parts = [rows.where(F.col("frame") % 3 == k) for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy("event_id")))


@query("c05_synthetic_rows", f"WITH {OBS_SQL}, n AS (SELECT tid, frame, lead(frame) OVER (PARTITION BY tid ORDER BY frame) nxt FROM obs), g AS (SELECT tid, unnest(range(frame + 1, nxt)) frame FROM n WHERE nxt > frame + 1 AND nxt - frame - 1 < 3) SELECT tid, frame, event_id, false AS synthetic, CAST(NULL AS INT) AS history FROM obs UNION ALL SELECT tid, frame, NULL, true, 21 FROM g")
def c05(s, d):
    o = obs(s, d).select("tid", "frame", "event_id")
    g = sequences.gaps(o, ["tid"], 3).select("tid", F.explode(F.sequence(F.col("before") + 1, F.col("after") - 1)).alias("frame"))
    fills = g.select("tid", "frame", F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("synthetic"), F.lit(21).alias("history"))
    return o.withColumn("synthetic", F.lit(False)).withColumn("history", F.lit(None).cast("int")).unionByName(fills)


@query("c06_stage_names", f"WITH {DET_SQL} SELECT event_id, event_id % 37 AS code, CASE event_id % 37 " + " ".join(f"WHEN {code} THEN '{short}'" for code, short, _ in codes.CODES) + " END AS short, CASE event_id % 37 " + " ".join(f"WHEN {code} THEN '{label}'" for code, _, label in codes.CODES) + " END AS label, CASE WHEN event_id % 37 IN (" + ", ".join(str(code) for code, *_ in codes.CODES) + ") THEN event_id % 37 > 1 END AS refined FROM det")
def c06(s, d):
    return codes.described(det(s, d).select("event_id", (F.col("event_id") % 37).alias("code"))).select("event_id", "code", "short", "label", "refined")


@query("x02_in_polygon", f"WITH {DET_SQL}, e(x1, y1, x2, y2) AS (VALUES (10.0, 100.0, 90.0, 200.0), (90.0, 200.0, 60.0, 900.0), (60.0, 900.0, 40.0, 400.0), (40.0, 400.0, 10.0, 100.0)) SELECT event_id, count(*) FILTER ((y1 > cy) <> (y2 > cy) AND cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM det, e GROUP BY 1")
def x02(s, d):
    corners = [(10.0, 100.0), (90.0, 200.0), (60.0, 900.0), (40.0, 400.0)]
    crossed = [F.when(((F.lit(ay) > F.col("cy")) != (F.lit(by) > F.col("cy"))) & (F.col("cx") < (bx - ax) * (F.col("cy") - ay) / (by - ay) + ax), 1).otherwise(0) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])]
    return det(s, d).select("event_id", (sum(crossed) % 2 == 1).alias("inside"))


@query("x10_edit_log", f"WITH {OBS_SQL}, g AS (SELECT tid, frame // 2 AS frame, arg_max(heading, event_id) AS heading FROM obs WHERE event_id % 4 = 0 GROUP BY 1, 2) SELECT o.event_id, coalesce(g.heading, o.heading) AS heading, g.tid IS NOT NULL AS edited FROM obs o LEFT JOIN g USING (tid, frame)")
def x10(s, d):
    """Edits of one cell: the last one holds."""
    o = obs(s, d)
    log = o.where("event_id % 4 = 0").select("tid", F.floor(F.col("frame") / 2).alias("frame"), "event_id", F.col("heading").alias("new"))
    last = reshape.keep_last(log, ["tid", "frame"], "event_id").select("tid", "frame", "new")
    return o.join(last, ["tid", "frame"], "left").select("event_id", F.coalesce("new", "heading").alias("heading"), F.col("new").isNotNull().alias("edited"))


# splits and reuse


@query("r02_disjoint_split")
def r02(s, d):
    return sampling.disjoint_split(det(s, d).select("frame", "event_id"), "frame", 1500, "seed")


@query("r04_leak_free", "SELECT CAST(0 AS BIGINT) AS shared_frames, count(*) AS n FROM events")
def r04(s, d):
    rows = sampling.disjoint_split(det(s, d).select("frame", "event_id"), "frame", 1500, "seed")
    per = rows.groupBy("frame").agg(F.countDistinct("split").alias("k"), F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("k") > 1).alias("shared_frames"), F.sum("n").alias("n"))


_UNIT = "('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0"


@query("r06_rotations", f"WITH {DET_SQL} SELECT event_id, CASE WHEN {_UNIT.format("'seed/' || event_id")} < 0.5 THEN [90, 180, 270][1 + CAST(floor({_UNIT.format("'seed/which/' || event_id")} * 3) AS INT)] ELSE 0 END AS degrees FROM det")
def r06(s, d):
    return det(s, d).select("event_id", sampling.rotation("seed", [0, 90, 180, 270], 0.5, F.col("event_id")).alias("degrees"))


_DIGESTS = "x AS (SELECT frame, sha256(string_agg(event_id || ':' || tid, ',' ORDER BY event_id)) a, sha256(string_agg(event_id || ':' || CASE WHEN event_id % 97 = 0 THEN tid + 1 ELSE tid END, ',' ORDER BY event_id)) b FROM det GROUP BY 1)"


@query("m06_reusable_frames", f"WITH {DET_SQL}, {_DIGESTS} SELECT frame, a = b AS reusable FROM x")
def m06(s, d):
    old = det(s, d).select("frame", "event_id", "tid")
    new = old.withColumn("tid", F.expr("CASE WHEN event_id % 97 = 0 THEN tid + 1 ELSE tid END"))
    return reuse.reusable(old, new, "frame", "event_id", ["event_id", "tid"])


@query("m01_stage_cache", f"WITH {DET_SQL} SELECT tid, count(*) AS n FROM det GROUP BY 1")
def m01(s, d):
    """The second call reads what the first has committed."""
    cache = reuse.StageCache(s, fresh_path(s, "stages"))
    build = lambda: det(s, d).groupBy("tid").agg(F.count("*").alias("n"))
    cache.stage("counts", {"version": 1}, {"events": reuse.fingerprint(det(s, d))}, build)
    return cache.stage("counts", {"version": 1}, {"events": reuse.fingerprint(det(s, d))}, build)


# files


@query("s05_strict_result", f"WITH {STRUNG_SQL} SELECT frame, tid, round(cx, 4) cx, round(cy, 4) cy, w, h, heading FROM strung")
def s05(s, d):
    """Written as a wide table (K01) and read back."""
    path = fresh_path(s, "result")
    tables.write_result(strung(s, d), path, [0, 1, 2, 3])
    return tables.read_result(s, path).select("frame", "tid", r("cx").alias("cx"), r("cy").alias("cy"), "w", "h", "heading")


@query("s06_lenient_result", f"WITH {STRUNG_SQL} SELECT frame, tid, round(cx, 4) cx FROM strung WHERE event_id % 5 > 1")
def s06(s, d):
    """Some cells hold no number, some boxes no area."""
    path = fresh_path(s, "broken")
    rows = strung(s, d).select("frame", "tid", *[(F.when(F.col("event_id") % 5 == 0, "x") if v == "cx" else F.when(F.col("event_id") % 5 == 1, "0") if v == "w" else F).when(F.lit(True), F.col(v).cast("string")).alias(v) for v in tables.RESULT])
    reshape.to_wide(rows, [0, 1, 2, 3], tables.RESULT).write.option("header", True).csv(path)
    return tables.read_result(s, path, strict=False).select("frame", "tid", r("cx").alias("cx"))


@query("s11_centroids", f"WITH {STRUNG_SQL}, n AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS row FROM (SELECT DISTINCT frame FROM strung)) SELECT row AS frame, tid, round(cx, 4) AS x FROM strung JOIN n USING (frame) WHERE cx IS NOT NULL")
def s11(s, d):
    """Written in several files; the rows' numbers are the frames."""
    path = fresh_path(s, "centroids")
    rows = strung(s, d).select("frame", "tid", F.col("cx").alias("x"), F.col("cy").alias("y"))
    reshape.to_wide(rows, [0, 1, 2, 3], ["x", "y"]).orderBy("frame").drop("frame").write.option("header", True).csv(path)
    return tables.read_centroids(s, path, most_missing=0.99).where("x IS NOT NULL").select("frame", "tid", r("x").alias("x"))


@query("s07_ordered_rows", f"WITH {STRUNG_SQL} SELECT frame, count(*) AS n FROM strung GROUP BY 1")
def s07_rows(s, d):
    """A table of several files whose frames must increase."""
    path = fresh_path(s, "ordered")
    strung(s, d).groupBy("frame").agg(F.count("*").alias("n")).orderBy("frame").write.option("header", True).csv(path)
    return lines.ordered(s, path, "frame").select(F.col("frame").cast("long").alias("frame"), F.col("n").cast("long").alias("n"))


@query("s08_pose", f"WITH {OBS_SQL} SELECT frame, tid AS track, p AS point, round(CASE WHEN p = 'head' THEN cx ELSE cx + w END, 4) x FROM obs, (VALUES ('head'), ('tail')) t(p)")
def s08(s, d):
    path = fresh_path(s, "pose")
    rows = obs(s, d).selectExpr("concat('track_', tid) AS track", "frame AS frame_idx", "cx AS `head.x`", "cy AS `head.y`", "cx + w AS `tail.x`", "cy AS `tail.y`")
    rows.write.option("header", True).csv(path)
    return tables.read_pose(s, path).select("frame", "track", "point", r("x").alias("x"))


@query("s17_label_lines", f"WITH {DET_SQL} SELECT event_id % 8 AS klass, round(cx / 100, 4) x0, round(cy / 1000, 4) y0, round(cx / 100, 4) x3 FROM det")
def s17(s, d):
    path = fresh_path(s, "labels")
    x, y = F.col("cx") / 100, F.col("cy") / 1000
    det(s, d).select(F.format_string("%d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", F.col("event_id") % 8, x, y, x, y, x, y, x, y)).write.text(path)
    return tables.read_labels(s, path).select("klass", *[r(c).alias(c) for c in ("x0", "y0", "x3")])


@query("s16_delete_map", f"WITH {DET_SQL} SELECT event_id, 1 + CAST(score < 0.1 AS INT) AS n, CASE WHEN score < 0.1 THEN 'faint' ELSE 'far' END AS first FROM det WHERE cx > 90")
def s16(s, d):
    path = fresh_path(s, "deleted")
    why = F.array_join(F.filter(F.array(F.when(F.col("score") < 0.1, F.lit("faint")), F.lit("far")), lambda x: x.isNotNull()), "|")
    det(s, d).where("cx > 90").select("event_id", why.alias("reasons")).write.option("header", True).csv(path)
    rows = tables.read_reasons(s, path, "event_id bigint, reasons string")
    return rows.select("event_id", F.size("reasons").alias("n"), F.get("reasons", F.lit(0)).alias("first"))


@query("s14_complete_directions", f"WITH {DET_SQL} SELECT frame, event_id FROM det WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def s14(s, d):
    rows = det(s, d).select("frame", "event_id", F.expr("CASE WHEN event_id % 5 <> 0 THEN heading END").alias("head_angle_deg"), F.expr("CASE WHEN event_id % 7 <> 0 THEN sin(radians(heading)) ELSE double('nan') END").alias("direction_dx"), F.expr("-cos(radians(heading))").alias("direction_dy"))
    return tables.complete(rows, ["head_angle_deg", "direction_dx", "direction_dy"]).select("frame", "event_id")


_STATS = "m AS (SELECT count(*) n, count(DISTINCT tid) ids, min(frame) lo, max(frame) hi FROM det)"


@query("k03_tracking_stats", f"WITH {DET_SQL}, {_STATS} SELECT 'rows' metric, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT 'ids', ids FROM m UNION ALL SELECT 'first_frame', lo FROM m UNION ALL SELECT 'last_frame', hi FROM m")
def k03(s, d):
    m = det(s, d).agg(F.count("*").alias("rows"), F.countDistinct("tid").alias("ids"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return tables.metrics(m)


@query("s15_metric_values", f"WITH {DET_SQL}, {_STATS} SELECT CAST(n AS DOUBLE) AS \"rows\", CAST(hi AS DOUBLE) last_frame FROM m")
def s15(s, d):
    path = fresh_path(s, "metrics")
    k03(s, d).write.option("header", True).csv(path)
    return tables.read_metrics(s, path, ["rows", "last_frame"])


@query("k04_classified", f"WITH {DET_SQL} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE tid END AS track_id, CASE WHEN score < 0.1 THEN CASE WHEN cx > 90 THEN 'faint|far' ELSE 'faint' END WHEN cx > 90 THEN 'far' ELSE '' END AS reasons FROM det")
def k04(s, d):
    why = F.array_join(F.filter(F.array(F.when(F.col("score") < 0.1, F.lit("faint")), F.when(F.col("cx") > 90, F.lit("far"))), lambda x: x.isNotNull()), "|")
    return det(s, d).select("event_id", F.coalesce(F.expr("CASE WHEN event_id % 4 <> 0 THEN tid END"), F.lit(-1)).alias("track_id"), why.alias("reasons"))


@query("k06_corrections_log", f"WITH {DET_SQL} SELECT event_id, '{{\"kind\":\"relabel\",\"tid\":' || tid || ',\"frame\":' || frame || '}}' AS record FROM det")
def k06(s, d):
    return det(s, d).select("event_id", F.to_json(F.struct(F.lit("relabel").alias("kind"), "tid", "frame")).alias("record"))


@query("k10_run_summary", f"WITH {OBS_SQL}, b AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY tid ORDER BY frame) <= 2 THEN 0 ELSE 1 END nw FROM obs), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY tid ORDER BY frame) AS BIGINT) island FROM b) SELECT tid, island, min(frame) start_frame, max(frame) end_frame, count(*) n, count(*) FILTER (event_id % 5 = 0) deleted, 5 * count(*) FILTER (event_id % 5 = 0) >= 2 * count(*) AS dropped FROM i GROUP BY 1, 2")
def k10(s, d):
    rows = sequences.islands(obs(s, d).select("tid", "frame", "event_id"), ["tid"], max_gap=2)
    out = rows.groupBy("tid", "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.count_if(F.expr("event_id % 5 = 0")).alias("deleted"))
    return out.withColumn("dropped", F.expr("5 * deleted >= 2 * n"))


@query("k08_front_rear", f"WITH {STRUNG_SQL} SELECT frame, " + ", ".join(f"max(CASE WHEN tid = {k} THEN round(cx {sign} sin(radians(heading))*w/2, 4) END) {name}_x{k}" for k in range(4) for sign, name in (("+", "front"), ("-", "rear"))) + " FROM strung GROUP BY 1")
def k08(s, d):
    half = F.sin(F.radians("heading")) * F.col("w") / 2
    rows = strung(s, d).select("frame", "tid", r(F.col("cx") + half).alias("front_x"), r(F.col("cx") - half).alias("rear_x"))
    return reshape.to_wide(rows, [0, 1, 2, 3], ["front_x", "rear_x"])


@query("w17_flip_repair")
def w17(s, d):
    ship(s)
    return headings.repair_flips(obs(s, d), 2)


@query("j22_result_rescue")
def j22(s, d):
    """Results are the detections, a little off and some of them missing."""
    ship(s)
    blobs = det(s, d).select("frame", "event_id", *staged.VALUES)
    off = blobs.where("event_id % 9 <> 0").withColumn("cx", F.expr("cx + event_id % 3 * 0.3")).withColumn("heading", F.expr("heading + event_id % 5 * 6"))
    return matching.rescued(blobs, off, 60.0)


@query("k07_split_manifest", f"WITH {DET_SQL} SELECT CASE WHEN frame % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'cam' || lpad(CAST(frame AS VARCHAR), 6, '0') AS stem, frame AS source_frame, CASE WHEN event_id % 4 = 0 THEN 'clustered' ELSE 'single' END AS kind FROM det")
def k07(s, d):
    rows = det(s, d).select("frame", F.concat(F.lit("cam"), F.lpad(F.col("frame").cast("string"), 6, "0")).alias("stem"), F.col("frame").alias("source_frame"), F.expr("CASE WHEN event_id % 4 = 0 THEN 'clustered' ELSE 'single' END").alias("kind"))
    parts = [rows.where(on).withColumn("split", F.lit(name)) for name, on in (("val", "frame % 5 = 0"), ("train", "frame % 5 <> 0"))]
    return parts[0].unionByName(parts[1]).select("split", "stem", "source_frame", "kind")


@query("k02_corner_table", f"WITH {STRUNG_SQL}, z AS (SELECT frame, tid, heading AS c, " + ", ".join(f"round({sql_corner(k)[i]}, 4) {c}{k}" for k in range(4) for i, c in enumerate("xy")) + " FROM strung) SELECT frame AS position, " + ", ".join(f"max(CASE WHEN tid = {t} THEN {c} END) {c}{t}" for t in range(4) for c in [*[f"{c}{k}" for k in range(4) for c in "xy"], "c"]) + " FROM z GROUP BY 1")
def k02(s, d):
    rows = strung(s, d).withColumn("corners", F.transform(boxes.corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "heading")]), lambda p: F.struct(F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))))
    return reshape.corner_table(rows, [0, 1, 2, 3])


@query("s12_sniffed_format", "SELECT 'result' AS format UNION ALL SELECT 'pose' UNION ALL SELECT 'centroids'")
def s12(s, d):
    o = obs(s, d).where("tid = 1 AND frame < 5")
    tables_ = [o.selectExpr("frame", "cx AS cx0", "cy AS cy0", "w AS w0", "h AS h0"), o.selectExpr("tid AS track", "frame AS frame_idx", "cx AS `head.x`", "cy AS `head.y`"), o.selectExpr("cx AS x0", "cy AS y0")]
    found = []
    for k, t in enumerate(tables_):
        path = fresh_path(s, f"sniff{k}")
        t.coalesce(1).write.option("header", True).csv(path)
        found.append((tables.sniff(s, path),))
    return s.createDataFrame(found, "format string")


def _resolver_input(s, d):
    """Ten ids are one video, so there are more videos where there are more ids; each fragment is of one video, its object one of the video's ids."""
    o = obs(s, d)
    tracks = o.select(F.floor(F.col("tid") / 10).cast("string").alias("video"), "tid", "frame", *staged.VALUES)
    videos = o.agg((F.floor(F.max("tid") / 10) + 1).alias("videos"))
    f = frag(s, d).where("obj_id IS NOT NULL AND centroid IS NOT NULL").crossJoin(F.broadcast(videos))
    parts = f.select(F.expr("pmod(xxhash64(frag_id), videos)").alias("k"), "obj_id", F.expr("frag_id % 170").alias("start_frame"), F.expr("frag_id % 170 + 3").alias("end_frame"), "centroid")
    return tracks, parts.select(F.col("k").cast("string").alias("video"), (F.col("k") * 10 + F.col("obj_id")).alias("tid"), "start_frame", "end_frame", "centroid")


@query("c02_resolved_tracks")
def c02(s, d):
    ship(s)
    return resolver.resolve(*_resolver_input(s, d), resolver.Rules(limit=50.0))


@query("c04_guarded_decisions")
def c04(s, d):
    ship(s)
    return resolver.decisions(*_resolver_input(s, d), resolver.Rules(limit=50.0, closed_only=True))


#: Contours: the corners of each detection's box, and the middles between them, which don't change its axes.
_CONTOUR_SQL = "pts AS (" + " UNION ALL ".join(f"SELECT event_id, {sql_corner(k)[0]} x, {sql_corner(k)[1]} y FROM det" for k in range(4)) + ")"


def _contours(s, d):
    corners = boxes.corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "heading")])
    return det(s, d).select("frame", F.col("event_id").alias("blob_index"), corners.alias("contour"))


@query("f14_fitted_boxes", f"WITH {DET_SQL}, {_CONTOUR_SQL}, m AS (SELECT event_id, avg(x) mx, avg(y) my, atan2(2*covar_pop(x, y), var_pop(x) - var_pop(y))/2 a FROM pts GROUP BY 1), z AS (SELECT event_id, mx, my, (x-mx)*cos(a) + (y-my)*sin(a) u, (y-my)*cos(a) - (x-mx)*sin(a) v FROM pts JOIN m USING (event_id)) SELECT event_id AS blob_index, round(max(u) - min(u), 3) w, round(max(v) - min(v), 3) h FROM z GROUP BY 1")
def f14(s, d):
    return fitting.fitted(_contours(s, d), "contour").select("blob_index", r("w", 3).alias("w"), r("h", 3).alias("h"))


@query("s03_blob_index", f"WITH {DET_SQL}, {_CONTOUR_SQL} SELECT event_id AS blob_index, round(avg(x), 3) x, round(avg(y), 3) y, round(any_value(w*h), 3) area, round(min(x), 3) x0, round(min(y), 3) y0, round(max(x), 3) x1, round(max(y), 3) y1 FROM pts JOIN det USING (event_id) GROUP BY 1")
def s03(s, d):
    """Contours written as a blob table and read back, then measured."""
    path = fresh_path(s, "blobs")
    _contours(s, d).write.parquet(path)
    found = blobs.index(s.read.parquet(path))
    return found.select("blob_index", *[r(c, 3).alias(c) for c in ("x", "y", "area", "x0", "y0", "x1", "y1")])


@query("s04_detection_table", f"WITH {DET_SQL} SELECT frame, det_index, event_id, score FROM det")
def s04(s, d):
    path = fresh_path(s, "detections")
    tables.write_detections(indexed(det(s, d)), path)
    return tables.read_detections(s, path, 0).select("frame", "det_index", "event_id", "score")


@query("s09_headed_pose", f"WITH {STRUNG_SQL} SELECT frame, 'animal' || tid AS individual, p AS point, round(CASE WHEN p = 'head' THEN cx ELSE cx + w END, 4) x, round(score, 4) likelihood FROM strung, (VALUES ('head'), ('tail')) t(p)")
def s09(s, d):
    """A pose table under four header lines in a file of their own, before those of the rows."""
    path = fresh_path(s, "headed")
    rows = strung(s, d).withColumn("end", F.col("cx") + F.col("w"))
    wide = reshape.to_wide(rows, [0, 1, 2, 3], ["cx", "cy", "end", "score"])
    names = [(f"animal{i}", p, v, c) for i in range(4) for p, x in (("head", f"cx{i}"), ("tail", f"end{i}")) for v, c in (("x", x), ("y", f"cy{i}"), ("likelihood", f"score{i}"))]
    heads = [["scorer", *["s"] * len(names)], ["individuals", *[n[0] for n in names]], ["bodyparts", *[n[1] for n in names]], ["coords", *[n[2] for n in names]]]
    cells = wide.select(F.concat_ws(",", F.col("frame").cast("string"), *[F.coalesce(F.col(n[3]).cast("string"), F.lit("")) for n in names]).alias("value"), "frame")
    s.createDataFrame([(",".join(h), k) for k, h in enumerate(heads)], "value string, k int").coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/0")
    cells.orderBy("frame").select("value").write.text(f"{path}/1")
    return tables.read_headed_pose(s, f"{path}/*").where("x IS NOT NULL").select("frame", "individual", "point", r("x").alias("x"), r("likelihood").alias("likelihood"))


#: Three tracks each, in a frame (b) and the next one (a); costs are the way along x.
_ROSTER_SQL = "w AS (SELECT tid // 3 AS roster, frame, " + ", ".join(f"max(CASE WHEN tid % 3 = {k} THEN cx END) x{k}" for k in range(3)) + " FROM obs GROUP BY 1, 2), c AS (SELECT b.roster, b.frame, " + ", ".join(f"abs(b.x{i} - a.x{j}) c{i}{j}" for i in range(3) for j in range(3)) + " FROM w b JOIN w a ON a.roster = b.roster AND a.frame = b.frame + 1)"
_ORDERS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


@query("j26_roster_of_three", f"WITH {OBS_SQL}, {_ROSTER_SQL}, t AS (SELECT *, [" + ", ".join("+".join(f"c{i}{j}" for i, j in enumerate(p)) for p in _ORDERS) + "] o FROM c WHERE " + " AND ".join(f"c{i}{j} IS NOT NULL" for i in range(3) for j in range(3)) + "), z AS (SELECT *, list_sort(o) q FROM t) SELECT roster, frame, CASE WHEN q[1] = o[1] THEN CASE WHEN greatest(c00, c11, c22) >= 5 THEN 'gate_abs_dist' ELSE 'identity' END WHEN q[1] > 0.5 * least(o[1], q[2]) THEN 'gate_cost_ratio' ELSE 'swap' END AS decision, round(q[1], 4) AS best FROM z")
def j26_three(s, d):
    o = obs(s, d).select(F.expr("tid div 3").alias("roster"), "frame", (F.col("tid") % 3).alias("tid"), "cx")
    wide = o.groupBy("roster", "frame").agg(*[F.max(F.when(F.col("tid") == k, F.col("cx"))).alias(f"x{k}") for k in range(3)]).dropna()
    after = wide.select("roster", (F.col("frame") - 1).alias("frame"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(3)])
    cost = F.array(*[F.array(*[F.abs(F.col(f"x{i}") - F.col(f"y{j}")) for j in range(3)]) for i in range(3)])
    costs = wide.join(after, ["roster", "frame"]).select(F.struct("roster", "frame").alias("key"), F.lit(3).alias("n"), cost.alias("cost"))
    return identity.roster_decision(costs).select("key.*", "decision", r("best").alias("best"))
