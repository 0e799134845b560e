"""Queries on match points, telemetry, detections, fits and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import detections, fitting, matches, sweep, telemetry
from tessella.plans.fixtures import table, with_tables
from tessella.plans.registry import query

_H = (1.2, -0.1, 5.0, 0.1, 1.2, -3.0, 0.0, 0.0, 1.0)
_E = "sqrt(pow(src_x * 1.2 + src_y * -0.1 + 5 - ref_x, 2) + pow(src_x * 0.1 + src_y * 1.2 - 3 - ref_y, 2))"
_PTS = f"pts AS (SELECT *, {_E} AS err, {_E} <= 3 AS inlier FROM match_points)"


def _points(spark, sf):
    m = table(spark, sf, "match_points")
    h = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("run_id"), F.array(*[F.lit(x) for x in _H]).alias("h"))
    return matches.with_errors(m, h)


def _even(c, digits=6, name=None):
    return F.round(F.col(c) + 1e-9, digits).alias(name or c)


@query("x11_reprojection", with_tables("match_points", f"{_PTS} SELECT run_id, match_idx, round(err, 4) AS err FROM pts"))
def x11_reprojection(spark, sf):
    return _points(spark, sf).select("run_id", "match_idx", F.round("reproj_error_px", 4).alias("err"))


@query("a5_rmse", with_tables("match_points", f"{_PTS} SELECT run_id, round(sqrt(avg(err * err)), 6) AS rmse FROM pts GROUP BY 1"))
def a5_rmse(spark, sf):
    return matches.run_rmse(_points(spark, sf)).select("run_id", F.round("rmse", 6).alias("rmse"))


@query("a5_direct_rmse", with_tables("match_points", "SELECT run_id, round(sqrt(avg(pow(src_x - ref_x, 2) + pow(src_y - ref_y, 2))), 4) AS rmse FROM match_points GROUP BY 1"))
def a5_direct_rmse(spark, sf):
    return matches.direct_rmse(table(spark, sf, "match_points")).select("run_id", F.round("rmse", 4).alias("rmse"))


@query("a6_inliers", with_tables("match_points", f"{_PTS} SELECT run_id, count(*) AS total, count(*) FILTER (inlier) AS inliers, round(count(*) FILTER (inlier) / count(*), 9) AS ratio, round(max(err), 4) AS max_error FROM pts GROUP BY 1"))
def a6_inliers(spark, sf):
    return matches.inlier_stats(_points(spark, sf)).select("run_id", "total", "inliers", F.round("ratio", 9).alias("ratio"), F.round("max_error", 4).alias("max_error"))


@query("f3_thresholds", with_tables("match_points", f"{_PTS} SELECT run_id, threshold, count(*) FILTER (err <= threshold) AS inliers FROM pts, (SELECT unnest([1.0, 2.0, 3.0, 5.0]::DOUBLE[]) AS threshold) GROUP BY 1, 2"))
def f3_thresholds(spark, sf):
    return matches.inliers_at(_points(spark, sf), [1, 2, 3, 5]).select("run_id", "threshold", "inliers")


@query("f2_confidence_floor", with_tables("match_points", "SELECT run_id, count(*) AS n FROM match_points WHERE confidence >= 0.45 GROUP BY 1"))
def f2_confidence_floor(spark, sf):
    return matches.filter_confident(table(spark, sf, "match_points"), 0.45).groupBy("run_id").agg(F.count("*").alias("n"))


_CELL = "CAST(least(floor(ref_x / (1200.0::DOUBLE / 6)), 5) AS BIGINT) AS cx, CAST(least(floor(ref_y / (1200.0::DOUBLE / 6)), 5) AS BIGINT) AS cy"


@query("a8_uniformity", with_tables("match_points", f"""c AS (SELECT run_id, {_CELL}, count(*) AS c FROM match_points GROUP BY 1, 2, 3),
r AS (SELECT run_id, CAST(sum(c) AS DOUBLE) AS s, CAST(sum(c * c) AS DOUBLE) AS s2 FROM c WHERE cx BETWEEN 0 AND 5 AND cy BETWEEN 0 AND 5 GROUP BY 1)
SELECT run_id, round(sqrt(greatest(s2 / 36 - (s / 36) * (s / 36), 0)) / (s / 36), 8) AS uniformity FROM r"""))
def a8_uniformity(spark, sf):
    return matches.uniformity(table(spark, sf, "match_points"), 1200.0, 1200.0).select("run_id", F.round("uniformity", 8).alias("uniformity"))


@query("a9_heatmap", with_tables("match_points", 'SELECT run_id, CAST(greatest(0, least(floor(src_y / 200), 3)) AS BIGINT) AS "row", CAST(greatest(0, least(floor(src_x / 250), 3)) AS BIGINT) AS col, count(*) AS n FROM match_points GROUP BY 1, 2, 3'))
def a9_heatmap(spark, sf):
    return matches.heatmap(table(spark, sf, "match_points"), 1000.0, 800.0)


@query("w2_spatial_cap", with_tables("match_points", f"""c AS (SELECT run_id, match_idx, {_CELL} FROM match_points), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, cx, cy ORDER BY match_idx) AS k FROM c) SELECT run_id, CAST(match_idx AS BIGINT) AS match_idx FROM r WHERE k <= 12"""))
def w2_spatial_cap(spark, sf):
    return matches.spatial_cap(table(spark, sf, "match_points"), 1200.0, 1200.0).select("run_id", F.col("match_idx").cast("long").alias("match_idx"))


@query("a7_rotation_consistency", with_tables("match_points", """q AS (SELECT run_id, match_idx, src_x, src_y, ref_x, ref_y FROM match_points),
p AS (SELECT a.run_id, fmod(degrees(atan2(b.ref_y - a.ref_y, b.ref_x - a.ref_x)) - degrees(atan2(b.src_y - a.src_y, b.src_x - a.src_x)) + 180 + 720, 360) - 180 AS d
 FROM q a JOIN q b ON a.run_id = b.run_id AND a.match_idx < b.match_idx
 WHERE sqrt(pow(b.src_x - a.src_x, 2) + pow(b.src_y - a.src_y, 2)) > 0.001 AND sqrt(pow(b.ref_x - a.ref_x, 2) + pow(b.ref_y - a.ref_y, 2)) > 0.001)
SELECT run_id, round(stddev_pop(d), 4) AS rotation_std, count(*) AS n_pairs FROM p GROUP BY 1"""))
def a7_rotation_consistency(spark, sf):
    """The figure is defined over all pairs of a run."""
    m = table(spark, sf, "match_points")
    return matches.rotation_consistency(m).select("run_id", F.round("rotation_std", 4).alias("rotation_std"), "n_pairs")


_KNN = """a AS (SELECT * FROM keypoints WHERE image_id = 0), b AS (SELECT * FROM keypoints WHERE image_id = 1),
d AS (SELECT a.block, a.kp_id AS q, b.kp_id AS t, sqrt(list_sum(list_transform(list_zip(a.descriptor, b.descriptor), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS dist FROM a JOIN b ON a.block = b.block),
f AS (SELECT *, row_number() OVER (PARTITION BY block, q ORDER BY dist, t) AS r, lead(dist) OVER (PARTITION BY block, q ORDER BY dist, t) AS second FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY block, t ORDER BY dist, q) AS r, lead(dist) OVER (PARTITION BY block, t ORDER BY dist, q) AS second FROM d)"""


@query("j1_ratio_matches", with_tables("keypoints", f"{_KNN} SELECT block, q, t, round(dist, 6) AS dist FROM f WHERE r = 1 AND dist < 0.97 * second"))
def j1_ratio_matches(spark, sf):
    k = table(spark, sf, "keypoints")
    return matches.ratio_matches(k.where("image_id = 0"), k.where("image_id = 1"), 0.97).select("block", "q", "t", F.round("dist", 6).alias("dist"))


@query("j2_mutual_matches", with_tables("keypoints", f"{_KNN} SELECT f.block, f.q, f.t FROM f JOIN g ON f.q = g.q AND f.t = g.t WHERE f.r = 1 AND f.dist < 0.97 * f.second AND g.r = 1 AND g.dist < 0.97 * g.second"))
def j2_mutual_matches(spark, sf):
    k = table(spark, sf, "keypoints")
    return matches.mutual_matches(k.where("image_id = 0"), k.where("image_id = 1"), 0.97).select("block", "q", "t")


_BITS = """k AS (SELECT image_id, kp_id, block, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN descriptor[i] > 0 THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END))::BIGINT AS lo,
 list_sum(list_transform(range(33, 65), lambda i: CASE WHEN descriptor[i] > 0 THEN CAST(pow(2, i - 33) AS BIGINT) ELSE 0 END))::BIGINT AS hi FROM keypoints),
d AS (SELECT a.block, a.kp_id AS q, b.kp_id AS t, bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS dist FROM k a JOIN k b ON a.block = b.block AND a.image_id = 0 AND b.image_id = 1),
f AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS second FROM d WINDOW w AS (PARTITION BY block, q ORDER BY dist, t))"""


@query("j1_hamming_matches", with_tables("keypoints", f"{_BITS} SELECT block, q, t, CAST(dist AS DOUBLE) AS dist FROM f WHERE r = 1 AND dist < 0.9 * second"))
def j1_hamming_matches(spark, sf):
    """Descriptors of the signs of 64 components, in two words."""
    word = lambda lo: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("descriptor", i + lo) > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(0))
    k = table(spark, sf, "keypoints").withColumn("descriptor", F.array(word(0), word(32)))
    return matches.ratio_matches(k.where("image_id = 0"), k.where("image_id = 1"), 0.9, distance=matches.hamming).select("block", "q", "t", "dist")


@query("x40_match_confidence", with_tables("keypoints", f"{_KNN}, m AS (SELECT * FROM f WHERE r = 1 AND dist < 0.97 * second) SELECT block, q, round(1 - dist / max(dist) OVER (PARTITION BY block), 6) AS confidence FROM m"))
def x40_match_confidence(spark, sf):
    k = table(spark, sf, "keypoints")
    m = matches.match_confidence(matches.ratio_matches(k.where("image_id = 0"), k.where("image_id = 1"), 0.97))
    return m.select("block", "q", F.round("confidence", 6).alias("confidence"))


@query("a18_best_matcher", "WITH c AS (SELECT o_custkey AS pair_id, CASE o_orderkey % 3 WHEN 0 THEN 'sift' WHEN 1 THEN 'orb' ELSE 'dense' END AS matcher, o_orderkey % 3 AS ord, max(o_orderkey % 100 / 100.0::DOUBLE) AS r, count(*) AS n FROM orders GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN n >= 3 THEN r ELSE 0 END AS score FROM c) SELECT pair_id, arg_max(matcher, [score, -ord]) AS best, count(*) AS n_scores FROM s GROUP BY 1")
def a18_best_matcher(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("ord", F.col("o_orderkey") % 3)
    name = F.when(F.col("ord") == 0, "sift").when(F.col("ord") == 1, "orb").otherwise("dense")
    c = o.groupBy(F.col("o_custkey").alias("pair_id"), name.alias("matcher"), "ord").agg(F.max(F.col("o_orderkey") % 100 / 100.0).alias("inlier_ratio"), F.count("*").alias("n_points"))
    return matches.best_matcher(c, 3).select("pair_id", "best", F.size("scores").cast("long").alias("n_scores"))


@query("a19_confidence_histogram", with_tables("match_points", f"{_PTS} SELECT run_id, CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) FILTER (inlier) AS inliers, count(*) FILTER (NOT inlier) AS outliers FROM pts GROUP BY 1, 2"))
def a19_confidence_histogram(spark, sf):
    return matches.confidence_histogram(_points(spark, sf))


@query("a20_confidence_density", with_tables("match_points", f"{_PTS}, c AS (SELECT inlier, round(confidence, 4) AS c FROM pts) SELECT inlier, CAST(i AS INTEGER) AS i, round(sum(exp(-pow((i / 49.0::DOUBLE - c) / 0.08, 2) / 2)) / (count(*) * 0.08 * 2.5066282746310002), 6) AS density FROM c, range(0, 50) t(i) GROUP BY 1, 2"))
def a20_confidence_density(spark, sf):
    return matches.confidence_density(_points(spark, sf)).select("inlier", "i", F.round("density", 6).alias("density"))


@query("a21_confidence_by_class", with_tables("match_points", f"{_PTS} SELECT run_id, round(avg(confidence) FILTER (inlier), 8) AS inlier_mean, round(avg(confidence) FILTER (NOT inlier), 8) AS outlier_mean FROM pts GROUP BY 1"))
def a21_confidence_by_class(spark, sf):
    return matches.confidence_by_class(_points(spark, sf)).select("run_id", F.round("inlier_mean", 8).alias("inlier_mean"), F.round("outlier_mean", 8).alias("outlier_mean"))


@query("k5_display_sample", with_tables("match_points", f"{_PTS}, q AS (SELECT run_id, match_idx, row_number() OVER (PARTITION BY run_id ORDER BY match_idx) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM pts WHERE inlier) SELECT run_id, CAST(match_idx AS BIGINT) AS match_idx FROM q WHERE r % greatest(1, CAST(ceil(n / 40.0) AS BIGINT)) = 0"))
def k5_display_sample(spark, sf):
    return matches.display_sample(_points(spark, sf), 40).select("run_id", F.col("match_idx").cast("long").alias("match_idx"))


@query("f11_seeds", with_tables("match_points", "SELECT run_id, count(*) AS n, bool_and(src_x < 990 AND ref_x >= 0 AND ref_x < 1300 AND ref_y >= 0 AND ref_y < 1300) AS inside FROM match_points GROUP BY 1"))
def f11_seeds(spark, sf):
    s = table(spark, sf, "match_points").select("run_id", F.array("src_x", "src_y").alias("src"), F.array("ref_x", "ref_y").alias("ref"), F.lit(990).alias("src_w"), F.lit(800).alias("src_h"), F.lit(1300).alias("ref_w"), F.lit(1300).alias("ref_h"))
    return matches.check_seeds(s).select("run_id", "n", "inside")


@query("w8_interleave", with_tables("runs", "SELECT id, row_number() OVER (PARTITION BY sensor_type ORDER BY id) AS turn FROM runs"))
def w8_interleave(spark, sf):
    r = table(spark, sf, "runs").select("id", F.col("sensor_type").alias("lane"), F.col("id").alias("task"))
    return matches.interleave(r).select("id", F.col("turn").cast("long").alias("turn"))


# telemetry


@query("a14_telemetry_summary", with_tables("telemetry", "SELECT record_num % 20 AS product_id, count(*) AS n, arg_min(elevation, record_num) AS first_elevation, arg_max(azimuth, record_num) AS last_azimuth, round(avg(90 - elevation) + 1e-9, 6) AS mean_incidence FROM telemetry GROUP BY 1"))
def a14_telemetry_summary(spark, sf):
    t = table(spark, sf, "telemetry").withColumn("product_id", F.col("record_num") % 20)
    return telemetry.telemetry_summary(t).select("product_id", "n", "first_elevation", "last_azimuth", _even("mean_incidence"))


@query("j7_nearest_record", with_tables("acquisitions telemetry", """h AS (SELECT acq_id, record_num, abs(epoch_us(a.ts) - epoch_us(t.ts)) AS gap FROM acquisitions a JOIN telemetry t ON t.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND),
b AS (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY gap, record_num) AS r FROM h)
SELECT a.acq_id, record_num, gap / 1e6::DOUBLE AS gap_s FROM acquisitions a LEFT JOIN b ON b.acq_id = a.acq_id AND r = 1"""))
def j7_nearest_record(spark, sf):
    return telemetry.nearest_record(table(spark, sf, "acquisitions"), table(spark, sf, "telemetry")).select("acq_id", "record_num", "gap_s")


@query("j8_covering_file", "WITH c AS (SELECT 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file, o_orderdate AS a, o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 30 AS INTEGER) AS z FROM orders) SELECT l_orderkey * 10 + l_linenumber AS time_id, l_shipdate AS ts_, min(file) AS file FROM lineitem LEFT JOIN c ON l_shipdate BETWEEN a AND z GROUP BY 1, 2")
def j8_covering_file(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("start", F.col("o_orderdate").cast("timestamp"))
    c = o.select(F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("file"), "start", (F.col("start") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))).alias("stop"))
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("time_id"), F.col("l_shipdate").cast("timestamp").alias("ts")).distinct()
    return telemetry.covering_file(t, c).select("time_id", F.col("ts").cast("timestamp_ntz").alias("ts_"), "file")


@query("j23_run_geometry", """WITH tel AS (SELECT ts, event_id AS r, event_id * 3 % 100 + 1740 AS px, event_id * 7 % 100 + 1740 AS py, event_id * 11 % 100 + 1740 AS pz FROM events WHERE event_type = 'view'),
acq AS (SELECT event_id AS run_id, ts FROM events WHERE event_type = 'signup'),
h AS (SELECT a.run_id, px, py, pz, abs(epoch_us(a.ts) - epoch_us(t.ts)) AS gap, r FROM acq a JOIN tel t ON t.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND),
b AS (SELECT run_id, arg_min({'x': px, 'y': py, 'z': pz}, {'g': gap, 'r': r}) AS p FROM h GROUP BY 1),
o AS (SELECT acq.run_id, lead(acq.run_id) OVER (ORDER BY acq.run_id) AS ref_id FROM acq),
v AS (SELECT o.run_id, o.ref_id, s.p IS NOT NULL AND f.p IS NOT NULL AS available, 1000.0::DOUBLE - s.p.x AS ax, 1000.0::DOUBLE - s.p.y AS ay, 900.0::DOUBLE - s.p.z AS az, 1000.0::DOUBLE - f.p.x AS bx, 1000.0::DOUBLE - f.p.y AS by_, 900.0::DOUBLE - f.p.z AS bz
 FROM o LEFT JOIN b s ON s.run_id = o.run_id LEFT JOIN b f ON f.run_id = o.ref_id)
SELECT run_id, available, CASE WHEN NOT available THEN 'no position near the acquisition' END AS reason,
 CASE WHEN available THEN round(degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_ + az * bz) / sqrt((ax * ax + ay * ay + az * az) * (bx * bx + by_ * by_ + bz * bz)))))), 4) END AS divergence_deg FROM v""")
def j23_run_geometry(spark, sf):
    """Both observers of each run and the angle between their lines of sight."""
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    tel = ev.where("event_type = 'view'").select("ts", F.col("event_id").alias("record_num"), F.array(*[(F.col("event_id") * k % 100 + 1740).cast("double") for k in (3, 7, 11)]).alias("pos"))
    acq = ev.where("event_type = 'signup'").select(F.col("event_id").alias("acq_id"), "ts")
    at = matches.interleave(acq.select(F.lit(0).alias("lane"), F.col("acq_id").alias("task"))).select(F.col("task").alias("acq_id"), "turn")
    after = at.join(at.select(F.col("acq_id").alias("ref_id"), (F.col("turn") - 1).alias("turn")).hint("merge"), "turn", "left")
    runs = after.select(F.col("acq_id").alias("run_id"), F.col("acq_id").alias("src_id"), "ref_id")
    foot = acq.select(F.col("acq_id").alias("product_id"), F.array(F.lit(1000.0), F.lit(1000.0), F.lit(900.0)).alias("target"))
    return telemetry.run_geometry(runs, acq, tel, foot).select("run_id", "available", "reason", F.round("divergence_deg", 4).alias("divergence_deg"))


# detections


# boxes are at most 64 high and wide: overlapping ones have centres in the same or in adjacent cells of 64
_IOU = """db AS MATERIALIZED (SELECT *, CAST(floor(cx / 64) AS BIGINT) AS gx, CAST(floor(cy / 64) AS BIGINT) AS gy FROM detections),
h AS MATERIALIZED (SELECT db.*, gx + n // 3 - 1 AS hx, gy + n % 3 - 1 AS hy FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS n FROM db) db),
o AS MATERIALIZED (SELECT a.image_id, a.det_id AS a, b.det_id AS b, greatest(least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2), 0) * greatest(least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2), 0) AS i, a.w * a.h + b.w * b.h AS s
 FROM h a JOIN db b ON a.image_id = b.image_id AND a.hx = b.gx AND a.hy = b.gy AND a.det_id < b.det_id), e AS (SELECT * FROM o WHERE i > 0 AND i / (s - i) >= 0.3)"""


@query("j22_overlapping_boxes", with_tables("detections", f"{_IOU} SELECT image_id, a, b, round(i / (s - i), 6) AS iou FROM e"))
def j22_overlapping_boxes(spark, sf):
    return detections.overlapping_boxes(table(spark, sf, "detections"), 0.3).select("image_id", F.col("det_id_a").cast("long").alias("a"), F.col("det_id_b").cast("long").alias("b"), F.round("iou", 6).alias("iou"))


@query("g2_clusters", with_tables("detections", f"""{_IOU}, u AS (SELECT image_id * 1000000 + a AS x, image_id * 1000000 + b AS y FROM e UNION SELECT image_id * 1000000 + b, image_id * 1000000 + a FROM e),
t(x, o) AS (SELECT DISTINCT x, x FROM u UNION SELECT u.y, t.o FROM t JOIN u ON u.x = t.x),
c AS (SELECT x, min(o) AS cluster FROM t GROUP BY x), n AS (SELECT d.*, coalesce(c.cluster, d.image_id * 1000000 + d.det_id) AS cluster FROM detections d LEFT JOIN c ON c.x = d.image_id * 1000000 + d.det_id),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, det_id) AS k FROM n)
SELECT image_id, CAST(det_id AS BIGINT) AS det_id, CAST(cluster % 1000000 AS BIGINT) AS cluster FROM r WHERE k = 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def g2_clusters(spark, sf):
    """Every cluster with its most confident box."""
    best = detections.cluster_best(table(spark, sf, "detections"), 0.3)
    return best.select("image_id", F.col("det_id").cast("long").alias("det_id"), F.col("cluster").cast("long").alias("cluster"))


_BOX = "greatest(least(o.cx + o.w / 2, r.cx + r.w / 2) - greatest(o.cx - o.w / 2, r.cx - r.w / 2), 0) * greatest(least(o.cy + o.h / 2, r.cy + r.h / 2) - greatest(o.cy - o.h / 2, r.cy - r.h / 2), 0)"


@query("g3_suppression", with_tables("detections", f"""r AS (SELECT image_id, det_id, cx, cy, w, h, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_id) AS k FROM detections),
g(image_id, k, kept) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), list_filter([{{'det_id': det_id, 'cx': cx, 'cy': cy, 'w': w, 'h': h}}], lambda x: false) FROM r
 UNION ALL SELECT g.image_id, g.k + 1, CASE WHEN len(list_filter(g.kept, lambda o: {_BOX} > 0.45 * (o.w * o.h + r.w * r.h - {_BOX}))) = 0
  THEN list_append(g.kept, {{'det_id': r.det_id, 'cx': r.cx, 'cy': r.cy, 'w': r.w, 'h': r.h}}) ELSE g.kept END FROM g JOIN r ON r.image_id = g.image_id AND r.k = g.k + 1)
SELECT image_id, CAST(unnest(kept).det_id AS BIGINT) AS det_id FROM (SELECT image_id, arg_max(kept, k) AS kept FROM g GROUP BY 1)""").replace("WITH ", "WITH RECURSIVE ", 1))
def g3_suppression(spark, sf):
    return detections.suppress(table(spark, sf, "detections")).select("image_id", F.col("det_id").cast("long").alias("det_id"))


@query("a32_detection_buckets", with_tables("detections", "c AS (SELECT image_id, count(*) AS n FROM detections GROUP BY 1) SELECT CASE WHEN n >= 100 THEN '100 and more' WHEN n >= 20 THEN '20 to 99' ELSE 'below 20' END AS bucket, count(*) AS images, CAST(sum(n) AS BIGINT) AS detections FROM c GROUP BY 1"))
def a32_detection_buckets(spark, sf):
    return detections.detection_buckets(table(spark, sf, "detections"))


@query("a32_detection_spread", with_tables("detections", "c AS (SELECT image_id, count(*) AS n FROM detections GROUP BY 1) SELECT quantile_cont(n, 0.5) AS median, avg(n) AS mean FROM c"))
def a32_detection_spread(spark, sf):
    return detections.detection_spread(table(spark, sf, "detections"))


@query("f6_crater_class", with_tables("detections", "SELECT image_id, count(*) AS n FROM detections WHERE class_name = 'crater' GROUP BY 1"))
def f6_crater_class(spark, sf):
    return table(spark, sf, "detections").where("class_name = 'crater'").groupBy("image_id").agg(F.count("*").alias("n"))


def _nodes(spark, sf):
    return table(spark, sf, "detections").select("image_id", F.col("det_id").cast("long").alias("det_id"), "cx", "cy", (F.col("w") / 2).alias("radius_px"), "confidence", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))


@query("j14_neighbour_edges", with_tables("detections", """n AS (SELECT image_id, det_id, cx, cy, w / 2 AS r FROM detections),
p AS (SELECT a.image_id, a.det_id AS a, b.det_id AS b, sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS d, atan2(b.cy - a.cy, b.cx - a.cx) AS bearing, b.r / greatest(a.r, 1e-6) AS rr FROM n a JOIN n b ON a.image_id = b.image_id AND a.det_id <> b.det_id),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id, a ORDER BY d, b) AS k FROM p) SELECT image_id, a, b, CAST(k AS INTEGER) AS rank, round(bearing, 6) AS bearing, round(d / sqrt(1640000), 8) AS dist_norm, round(rr, 6) AS radius_ratio FROM q WHERE k <= 6"""))
def j14_neighbour_edges(spark, sf):
    e = detections.neighbour_edges(_nodes(spark, sf))
    return e.select("image_id", F.col("det_id_a").alias("a"), F.col("det_id_b").alias("b"), "rank", F.round("bearing", 6).alias("bearing"), F.round("dist_norm", 8).alias("dist_norm"), F.round("radius_ratio", 6).alias("radius_ratio"))


@query("g5_node_features", with_tables("detections", "SELECT image_id, det_id, round(cx / 1000, 6) AS x, round(cy / 800, 6) AS y, round(w / 2 / sqrt(800000), 6) AS r, round(confidence, 6) AS confidence FROM detections"))
def g5_node_features(spark, sf):
    return detections.node_features(_nodes(spark, sf)).select("image_id", "det_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "r", "confidence")])


# fits


@query("a34_affine_fit", with_tables("match_points", """m AS (SELECT run_id, count(*) AS n, avg(src_x) AS ax, avg(src_y) AS ay, avg(ref_x) AS ux, covar_pop(src_x, src_x) AS xx, covar_pop(src_x, src_y) AS xy, covar_pop(src_y, src_y) AS yy, avg(ref_y) AS vy, covar_pop(src_x, ref_x) AS xu, covar_pop(src_y, ref_x) AS yu, covar_pop(src_x, ref_y) AS xv, covar_pop(src_y, ref_y) AS yv FROM match_points GROUP BY 1),
k AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d FROM m)
SELECT run_id, n AS n_points, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(ux - a * ax - b * ay, 4) AS tx, round(vy - c * ax - d * ay, 4) AS ty FROM k"""))
def a34_affine_fit(spark, sf):
    return fitting.fit_affine(table(spark, sf, "match_points")).select("run_id", "n_points", *[F.round(F.col("h")[i], 6).alias(n) for n, i in (("a", 0), ("b", 1), ("c", 3), ("d", 4))], F.round(F.col("h")[2], 4).alias("tx"), F.round(F.col("h")[5], 4).alias("ty"))


@query("a35_robust_fit")
def a35_robust_fit(spark, sf):
    return fitting.fit_robust(table(spark, sf, "match_points")).select("run_id", "inliers", "total", F.round(F.col("h")[0], 3).alias("h00"))


_EXACT = """e AS (SELECT run_id, match_idx, src_x, src_y, match_idx % 3 = 0 AS off, 1 + run_id % 7 * 0.05::DOUBLE AS a, run_id % 5 * 0.02::DOUBLE AS b, run_id % 11 - 5.0::DOUBLE AS tx FROM match_points)"""


@query("a35_exact_consensus", with_tables("match_points", f"{_EXACT} SELECT run_id, count(*) FILTER (NOT off) AS inliers, count(*) AS total, round(min(a), 4) AS h00, round(min(0 - b), 4) AS h01, round(min(tx), 3) AS h02, round(min(b), 4) AS h10, round(min(a), 4) AS h11 FROM e GROUP BY 1 HAVING count(*) FILTER (NOT off) >= 20"))
def a35_exact_consensus(spark, sf):
    """Two thirds of a run's points follow a similarity exactly, a third lie hundreds of pixels off in all directions."""
    m = table(spark, sf, "match_points")
    a, b, tx, off = 1 + F.col("run_id") % 7 * 0.05, F.col("run_id") % 5 * 0.02, F.col("run_id") % 11 - 5.0, F.col("match_idx") % 3 == 0
    far = lambda k: F.when(off, 400 + F.pmod(F.xxhash64("run_id", "match_idx", F.lit(k)), F.lit(4000))).otherwise(0)
    points = m.select("run_id", "match_idx", "src_x", "src_y", (a * F.col("src_x") - b * F.col("src_y") + tx + far(1)).alias("ref_x"), (b * F.col("src_x") + a * F.col("src_y") + 3 - far(2)).alias("ref_y"))
    enough = points.where("match_idx % 3 <> 0").groupBy("run_id").agg(F.count("*").alias("n")).where("n >= 20").select("run_id")
    h = fitting.fit_robust(points.join(enough.hint("merge"), "run_id", "left_semi"))
    return h.select("run_id", "inliers", "total", *[F.round(F.col("h")[i] + 1e-9, 3 if n == "h02" else 4).alias(n) for n, i in (("h00", 0), ("h01", 1), ("h02", 2), ("h10", 3), ("h11", 4))])


# sweeps


_PLAN = """grid AS (SELECT 'sun_only' AS category, d AS sun_delta, 1.0::DOUBLE AS scale, 0 AS rotation_deg FROM (SELECT unnest([0, 15, 30, 45]) AS d)
 UNION ALL SELECT 'scale_only', 0, s, 0 FROM (SELECT unnest([0.5, 0.7, 1.0, 1.5, 2.0]::DOUBLE[]) AS s) UNION ALL SELECT 'rotation_only', 0, 1.0, r FROM (SELECT unnest([0, 15, 30, 45, 90]) AS r)),
hard AS (SELECT 'compound_hard' AS category, x[1]::INTEGER AS sun_delta, x[2]::DOUBLE AS scale, x[3]::INTEGER AS rotation_deg FROM (SELECT unnest([[30, 1.5, 30], [45, 2, 45]]) AS x)
 UNION ALL SELECT 'compound_grid', d, s, 30 FROM (SELECT unnest([0, 15, 30, 45]) AS d), (SELECT unnest([0.5, 0.7, 1.0, 1.5, 2.0]::DOUBLE[]) AS s)),
live AS (SELECT 'compound' AS category, x[1]::INTEGER AS sun_delta, x[2]::DOUBLE AS scale, x[3]::INTEGER AS rotation_deg FROM (SELECT unnest([[0, 1, 30], [15, 1.5, 30], [30, 0.7, 30], [45, 2, 30]]) AS x))"""


@query("p1_plan", f"WITH {_PLAN} SELECT s_suppkey AS source_id, category, sun_delta, scale, rotation_deg FROM supplier, (SELECT * FROM grid UNION ALL SELECT * FROM hard) WHERE s_suppkey % 3 < 2 OR category IN ('scale_only', 'rotation_only')")
def p1_plan(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 < 2).alias("has_sun"))
    return sweep.plan(s).select("source_id", "category", "sun_delta", "scale", "rotation_deg")


@query("p2_p3_identity", f"WITH {_PLAN} SELECT s_suppkey AS source_id, category, sun_delta, scale, rotation_deg, CASE WHEN sun_delta = 0 AND scale = 1 AND rotation_deg = 0 THEN 'identity' ELSE 'run' END AS status, CAST(greatest(2, s_suppkey % 60 - sun_delta) AS DOUBLE) AS elevation FROM supplier, (SELECT * FROM grid UNION ALL SELECT * FROM live)")
def p2_p3_identity(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("source_id"), F.lit(True).alias("has_sun"))
    known, rest = sweep.identity_records(sweep.plan(s, live=True))
    both = known.unionByName(rest.withColumn("status", F.lit("run")), allowMissingColumns=True).withColumn("el", (F.col("source_id") % 60).cast("double"))
    return both.select("source_id", "category", "sun_delta", "scale", "rotation_deg", "status", sweep.new_elevation("el", "sun_delta").alias("elevation"))


@query("p7_relight", "SELECT s_suppkey AS source_id, x[1]::INTEGER AS elevation_delta, x[2]::INTEGER AS azimuth_delta FROM supplier, (SELECT unnest([[-10, 0], [-15, 0], [-20, 0], [-25, 0], [-30, 0], [-35, 0], [-40, 0], [-45, 0], [0, 45], [0, 90], [0, 135]]) AS x)")
def p7_relight(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("source_id"))
    return sweep.relight_plan(s).select("source_id", "elevation_delta", "azimuth_delta")


@query("a15_pass_rates", with_tables("sweep_results", "SELECT category, x, round(avg(CASE WHEN validated THEN 100.0 ELSE 0 END::DOUBLE), 6) AS pass_rate, round(avg(err_m), 6) AS mean_err, count(*) AS n FROM sweep_results GROUP BY 1, 2"))
def a15_pass_rates(spark, sf):
    return sweep.pass_rates(table(spark, sf, "sweep_results")).select("category", "x", F.round("pass_rate", 6).alias("pass_rate"), F.round("mean_err", 6).alias("mean_err"), "n")


@query("a16_thresholds", with_tables("sweep_results", "r AS (SELECT category, x, avg(CASE WHEN validated THEN 100.0 ELSE 0 END) AS p FROM sweep_results GROUP BY 1, 2) SELECT category, min(x) FILTER (p < 100 AND x <> 0) AS first_degraded, min(x) FILTER (p <= 0 AND x <> 0) AS first_failed FROM r GROUP BY 1"))
def a16_thresholds(spark, sf):
    return sweep.thresholds(sweep.pass_rates(table(spark, sf, "sweep_results")))


@query("a17_pass_matrix", with_tables("sweep_results", 'SELECT category, round(avg(CASE WHEN validated THEN 100.0 ELSE 0 END::DOUBLE) FILTER (x = 0), 6) AS x0, round(avg(CASE WHEN validated THEN 100.0 ELSE 0 END::DOUBLE) FILTER (x = 15), 6) AS x15, round(avg(CASE WHEN validated THEN 100.0 ELSE 0 END::DOUBLE) FILTER (x = 30), 6) AS x30 FROM sweep_results GROUP BY 1'))
def a17_pass_matrix(spark, sf):
    m = sweep.pass_matrix(table(spark, sf, "sweep_results"), "category", "x", [0, 15, 30])
    return m.select("category", *[F.round(str(v), 6).alias(f"x{v}") for v in (0, 15, 30)])


@query("p4_truth_errors", "SELECT s_suppkey AS run_id, round(0.0::DOUBLE, 6) AS rotation_error_deg, round(sqrt(8), 6) AS mean_error_px FROM supplier")
def p4_truth_errors(spark, sf):
    from tessella.functions.transforms import variant_transform

    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("run_id"), F.lit(1.5).alias("scale"), (F.col("s_suppkey") % 80).cast("double").alias("rotation_deg"), F.lit(100.0).alias("height"), F.lit(80.0).alias("width"), F.lit(0.5).alias("gsd_m"))
    s = s.withColumn("h", F.transform(variant_transform("scale", "rotation_deg", "height", "width"), lambda x, i: F.when(i.isin(2, 5), x + 2).otherwise(x)))
    return sweep.truth_errors(s).select("run_id", F.round("rotation_error_deg", 6).alias("rotation_error_deg"), F.round("mean_error_px", 6).alias("mean_error_px"))


#: transforms of a 100 x 80 frame for table t(run_id, k, s, g), and how far those of k 1 put its corners from those of k 0
VARIANTS = """v AS (SELECT *, cos(radians(g)) * s AS c, sin(radians(g)) * s AS d FROM t), w AS (SELECT *, (1 - c) * 40 - d * 50 + (round_even(100 * abs(d) + 80 * abs(c), 0) - 80) / 2 AS tx, d * 40 + (1 - c) * 50 + (round_even(100 * abs(c) + 80 * abs(d), 0) - 100) / 2 AS ty FROM v),
x AS (SELECT a.run_id, sqrt(pow((a.c - b.c) * px + (a.d - b.d) * py + a.tx - b.tx, 2) + pow((b.d - a.d) * px + (a.c - b.c) * py + a.ty - b.ty, 2)) AS far, abs(a.s / b.s - 1) AS scale_error, sqrt(pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2)) AS shift FROM w a JOIN w b ON a.run_id = b.run_id AND a.k = 1 AND b.k = 0, (SELECT unnest([0, 80, 0, 80]) AS px, unnest([0, 0, 100, 100]) AS py))"""


@query("p4_varied_errors", f"WITH t AS (SELECT s_suppkey AS run_id, k, 1.5 + k * 0.01::DOUBLE * (s_suppkey % 5) AS s, s_suppkey % 80 + k * (s_suppkey % 7) AS g FROM supplier, range(0, 2) r(k)), {VARIANTS} SELECT run_id, (run_id % 7)::DOUBLE AS rotation_error_deg, round(min(scale_error), 6) AS scale_error, round(min(shift), 5) AS translation_error_px, round(avg(far), 5) AS mean_error_px, round(max(far), 5) AS max_error_px FROM x GROUP BY run_id")
def p4_varied_errors(spark, sf):
    """Estimates that are off by up to 6 degrees and 4 hundredths of scale."""
    from tessella.functions.transforms import variant_transform

    k = F.col("run_id")
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("run_id")).select("run_id", F.lit(1.5).alias("scale"), (k % 80).cast("double").alias("rotation_deg"), F.lit(100.0).alias("height"), F.lit(80.0).alias("width"), F.lit(0.5).alias("gsd_m"))
    s = s.withColumn("h", variant_transform(1.5 + k % 5 * 0.01, (k % 80 + k % 7).cast("double"), "height", "width"))
    e = sweep.truth_errors(s)
    return e.select("run_id", F.round("rotation_error_deg", 6).alias("rotation_error_deg"), F.round("scale_error", 6).alias("scale_error"), *[F.round(c, 5).alias(c) for c in ("translation_error_px", "mean_error_px", "max_error_px")])


@query("p5_progress", "SELECT s_suppkey AS source_id, CAST(36 - 36 * CAST(s_suppkey % 2 = 0 AS INTEGER) AS BIGINT) AS completed, CAST(36 AS BIGINT) AS total, CASE WHEN s_suppkey % 2 = 0 THEN 'pending' ELSE 'complete' END AS state FROM supplier")
def p5_progress(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("source_id"), F.lit(True).alias("has_sun"))
    planned = sweep.plan(s)
    keys = ["source_id", "category", "sun_delta", "scale", "rotation_deg"]
    return sweep.progress(planned, planned.where("source_id % 2 = 1").withColumn("status", F.lit("ok")), keys)


@query("p6_coarse_targets", "SELECT s_suppkey AS frame_id, i * 10 + j AS cell, CASE WHEN j + s_suppkey % 3 < 10 THEN i * 10 + j + s_suppkey % 3 ELSE -100 END AS target FROM supplier, range(0, 8) a(i), range(0, 10) b(j)")
def p6_coarse_targets(spark, sf):
    h = [F.lit(1.0), F.lit(0.0), (F.col("s_suppkey") % 3 * 8).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("frame_id"), F.lit(64).alias("height"), F.lit(80).alias("width"), F.array(*h).alias("h"))
    return sweep.coarse_targets(s)
