"""Queries on run history, catalogs, footprints and column functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessella.functions import geo, scoring, text, transforms
from tessella.functions.geo import KM_PER_DEG
from tessella.operators import catalog, footprints, history, telemetry
from tessella.plans.fixtures import table, with_tables
from tessella.plans.registry import query
from tessella.sources import labels


def _even(c: str, digits: int = 6):
    """Rounded a little off exact ties, which the order of a sum would decide."""
    return F.round(F.col(c) + 1e-9, digits).alias(c)


_PRIOR = "OVER (PARTITION BY sensor_type ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FLAGGED = f"""p AS (SELECT *, count(x) {_PRIOR} AS n_prior, avg(x) {_PRIOR} AS m, stddev_samp(x) {_PRIOR} AS s FROM (SELECT *, CASE WHEN isnan(rmse) THEN NULL ELSE rmse END AS x FROM runs)),
flagged AS (SELECT *, CASE WHEN n_prior >= 2 THEN m END AS baseline_mean, CASE WHEN n_prior >= 2 THEN s END AS baseline_std, coalesce(n_prior >= 2 AND s > 0 AND abs(x - m) / s > 2, false) AS anomalous FROM p)"""


@query("w1_anomaly", with_tables("runs", f"{_FLAGGED} SELECT id, sensor_type, n_prior, round(baseline_mean + 1e-9, 6) AS baseline_mean, round(baseline_std + 1e-9, 6) AS baseline_std, anomalous FROM flagged"))
def w1_anomaly(spark, sf):
    out = history.flag_anomalies(table(spark, sf, "runs"))
    return out.select("id", "sensor_type", "n_prior", _even("baseline_mean"), _even("baseline_std"), "anomalous")


@query("a1_baseline", with_tables("runs", "SELECT sensor_type, count(*) AS n_runs, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std FROM runs WHERE NOT isnan(rmse) GROUP BY 1"))
def a1_baseline(spark, sf):
    return history.sensor_baseline(table(spark, sf, "runs")).select("sensor_type", "n_runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a2_sensor_summary", with_tables("runs", f"{_FLAGGED} SELECT sensor_type, count(*) AS n_runs, round(avg(x), 6) AS mean_rmse, round(avg(inlier_ratio), 6) AS mean_inlier_ratio, round(avg(uniformity), 6) AS mean_uniformity, count(*) FILTER (anomalous) AS n_anomalous FROM flagged GROUP BY 1"))
def a2_sensor_summary(spark, sf):
    out = history.sensor_summary(history.flag_anomalies(table(spark, sf, "runs")))
    return out.select("sensor_type", "n_runs", *[F.round(c, 6).alias(c) for c in ("mean_rmse", "mean_inlier_ratio", "mean_uniformity")], "n_anomalous")


@query("a3_same_sensor_baseline", with_tables("runs", "SELECT sensor_type, min(inlier_ratio) AS min_ratio, max(inlier_ratio) AS max_ratio, count(*) AS n, true AS available FROM runs WHERE src_path ILIKE '%self_pair%' GROUP BY 1"))
def a3_same_sensor_baseline(spark, sf):
    return history.same_sensor_baseline(table(spark, sf, "runs"))


@query("k1_latest_runs", with_tables("runs", "SELECT id, sensor_type, rmse FROM runs WHERE sensor_type = 'view' ORDER BY id DESC LIMIT 200"))
def k1_latest_runs(spark, sf):
    return history.latest_runs(table(spark, sf, "runs"), 200, "view").select("id", "sensor_type", "rmse")


@query("w11_rmse_trend", with_tables("runs", "SELECT id, sensor_type, round(avg(rmse) OVER (PARTITION BY sensor_type ORDER BY id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS trend FROM runs"))
def w11_rmse_trend(spark, sf):
    return history.rmse_trend(table(spark, sf, "runs")).select("id", "sensor_type", _even("trend"))


@query("x46_result_field", with_tables("runs", "SELECT id, json_extract_string(result_json, '$.k') AS k FROM runs"))
def x46_result_field(spark, sf):
    return history.result_field(table(spark, sf, "runs"), "$.k", "k").select("id", "k")


@query("f5_drop_missing", with_tables("runs", "SELECT id, rmse FROM runs WHERE rmse IS NOT NULL AND NOT isnan(rmse)"))
def f5_drop_missing(spark, sf):
    return table(spark, sf, "runs").where(scoring.finite("rmse").isNotNull()).select("id", "rmse")


# catalog


@query("f1_bbox", with_tables("craters", "SELECT crater_id, lon, lat, diameter_km FROM craters WHERE lon BETWEEN 30 AND 75.5 AND lat BETWEEN -20 AND 10"))
def f1_bbox(spark, sf):
    return catalog.bbox(table(spark, sf, "craters"), 30, 75.5, -20, 10).select("crater_id", "lon", "lat", "diameter_km")


@query("u1_union_catalogs", with_tables("craters named_features", "SELECT crater_id, NULL AS name, lon, lat, source FROM craters UNION ALL SELECT NULL, name, lon, lat, source FROM named_features"))
def u1_union_catalogs(spark, sf):
    out = catalog.union_catalogs(table(spark, sf, "craters"), table(spark, sf, "named_features").drop("feature_id"))
    return out.select("crater_id", "name", "lon", "lat", "source")


@query("a4_catalog_status", with_tables("craters named_features", "SELECT source, count(*) AS n FROM (SELECT source FROM craters UNION ALL SELECT source FROM named_features) GROUP BY 1"))
def a4_catalog_status(spark, sf):
    return catalog.status(catalog.union_catalogs(table(spark, sf, "craters"), table(spark, sf, "named_features")))


_IN = "lon >= lon0 AND lon <= lon1 AND lat >= lat0 AND lat <= lat1"


@query("j3_craters_in_footprints", with_tables("craters footprints", f"SELECT product_id, crater_id FROM footprints JOIN craters ON {_IN}"))
def j3_craters_in_footprints(spark, sf):
    return catalog.each_in_boxes(table(spark, sf, "craters").select("crater_id", "lon", "lat"), table(spark, sf, "footprints")).select("product_id", "crater_id")


@query("j3_interior", with_tables("craters footprints", "SELECT product_id, count(*) AS n FROM footprints JOIN craters ON lon > lon0 AND lon < lon1 AND lat > lat0 AND lat < lat1 GROUP BY 1"))
def j3_interior(spark, sf):
    return catalog.count_in_boxes(table(spark, sf, "craters"), table(spark, sf, "footprints"), boundary="interior")


_GRID = f"""g AS (SELECT product_id, r, k, lat0 + r * 3 AS a0, lat0 + (r + 1) * 3 AS a1, lon0 + k * 2 AS b0, lon0 + (k + 1) * 2 AS b1 FROM footprints, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS k)),
s AS (SELECT product_id, r, k, max(abs((a1 - a0) * (b1 - b0)) * {KM_PER_DEG**2!r} * cos(radians((a0 + a1) / 2))) AS area, count(crater_id) AS n, coalesce(sum(diameter_km * diameter_km), 0) AS w
 FROM g LEFT JOIN craters ON lat >= a0 AND lat < a1 AND lon >= b0 AND lon < b1 GROUP BY 1, 2, 3)"""


@query("a10_roughness", with_tables("craters footprints", f"{_GRID} SELECT product_id, r, k, n, round(w, 3) AS weight, round(w / area, 8) AS score FROM s"))
def a10_roughness(spark, sf):
    out = catalog.roughness(table(spark, sf, "craters"), table(spark, sf, "footprints"), 3)
    return out.select("product_id", "r", "k", "n", F.round("weight", 3).alias("weight"), F.round("score", 8).alias("score"))


@query("d20_grid_cells", with_tables("footprints", "SELECT product_id, r, k, lat0 + r * 3 AS lat0, lon0 + (k + 1) * 2 AS lon1 FROM footprints, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS k)"))
def d20_grid_cells(spark, sf):
    return catalog.grid_of(table(spark, sf, "footprints"), 3).select("product_id", "r", "k", "lat0", "lon1")


@query("a11_density", with_tables("craters footprints", f"SELECT product_id, CAST(least(floor((lat - lat0) / ((lat1 - lat0) / 12)), 11) AS BIGINT) AS r, CAST(least(floor((lon - lon0) / ((lon1 - lon0) / 12)), 11) AS BIGINT) AS k, count(*) AS n FROM footprints JOIN craters ON {_IN} GROUP BY 1, 2, 3"))
def a11_density(spark, sf):
    return catalog.density(table(spark, sf, "craters"), table(spark, sf, "footprints")).select("product_id", F.col("r").cast("long").alias("r"), F.col("k").cast("long").alias("k"), "n")


@query("a12_diameter_histogram", with_tables("craters footprints", f"""h AS (SELECT product_id, diameter_km AS d FROM footprints JOIN craters ON {_IN}),
s AS (SELECT product_id, min(d) AS lo, max(d) AS hi, CAST(least(20, greatest(5, count(*) // 3)) AS BIGINT) AS bins FROM h GROUP BY 1)
SELECT product_id, bins, CAST(CASE WHEN hi > lo THEN least(floor((d - lo) / ((hi - lo) / bins)), bins - 1) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM h JOIN s USING (product_id) GROUP BY 1, 2, 3"""))
def a12_diameter_histogram(spark, sf):
    return catalog.diameter_histogram(table(spark, sf, "craters"), table(spark, sf, "footprints"))


@query("a13_footprint_stats", with_tables("craters footprints", f"""h AS (SELECT product_id, count(*) AS n, min(diameter_km) AS min_d, max(diameter_km) AS max_d, avg(diameter_km) AS mean_d FROM footprints JOIN craters ON {_IN} GROUP BY 1)
SELECT product_id, coalesce(n, 0) AS n, min_d, max_d, round(mean_d + 1e-9, 6) AS mean_d, round(coalesce(n, 0) / ((lon1 - lon0) * (lat1 - lat0) * {KM_PER_DEG**2!r} * cos(radians((lat0 + lat1) / 2))), 9) AS density FROM footprints LEFT JOIN h USING (product_id)"""))
def a13_footprint_stats(spark, sf):
    out = catalog.footprint_stats(table(spark, sf, "craters"), table(spark, sf, "footprints"))
    return out.select("product_id", "n", "min_d", "max_d", _even("mean_d"), F.round("density", 9).alias("density"))


@query("k2_top_named", with_tables("named_features footprints", f"""h AS (SELECT product_id, feature_id, name, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(diameter_km, 0) DESC, feature_id) AS rank, count(*) OVER (PARTITION BY product_id) AS total FROM footprints JOIN named_features ON {_IN})
SELECT product_id, feature_id, name, CAST(rank AS INTEGER) AS rank, total FROM h WHERE rank <= 20"""))
def k2_top_named(spark, sf):
    return catalog.top_named(table(spark, sf, "named_features"), table(spark, sf, "footprints")).select("product_id", "feature_id", "name", "rank", "total")


@query("j9_nearest_feature", with_tables("named_features footprints", """p AS (SELECT product_id AS point_id, (lon0 + lon1) / 2 AS px, (lat0 + lat1) / 2 AS py FROM footprints),
h AS (SELECT point_id, feature_id, 2 * 1737.4::DOUBLE * asin(sqrt(least(pow(sin(radians(lat - py) / 2), 2) + cos(radians(py)) * cos(radians(lat)) * pow(sin(radians(lon - px) / 2), 2), 1))) AS km
 FROM p JOIN named_features ON abs(lat - py) <= 5 AND least(abs(lon - px), 360 - abs(lon - px)) <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, feature_id) AS r FROM h)
SELECT p.point_id, feature_id, round(km, 6) AS km, feature_id IS NOT NULL AS available FROM p LEFT JOIN b ON b.point_id = p.point_id AND r = 1"""))
def j9_nearest_feature(spark, sf):
    p = table(spark, sf, "footprints").select(F.col("product_id").alias("point_id"), ((F.col("lon0") + F.col("lon1")) / 2).alias("lon"), ((F.col("lat0") + F.col("lat1")) / 2).alias("lat"))
    return catalog.nearest_feature(p, table(spark, sf, "named_features")).select("point_id", "feature_id", F.round("km", 6).alias("km"), "available")


@query("u2_replace_sources", with_tables("sweep_results", "SELECT category, count(*) AS n, sum(x) AS sx FROM (SELECT category, x FROM sweep_results WHERE category <> 'R' UNION ALL SELECT category, x + 1 FROM sweep_results WHERE category = 'R') GROUP BY 1"))
def u2_replace_sources(spark, sf):
    r = table(spark, sf, "sweep_results").select("category", "x")
    new = r.where("category = 'R'").withColumn("x", F.col("x") + 1)
    return catalog.replace_sources(r, new, "category").groupBy("category").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


# footprints


_WIDE = "wide AS (SELECT product_id, lon0, lon1 + product_id % 7 AS lon1, lat0 - product_id % 5 AS lat0, lat1 + product_id % 4 AS lat1 FROM footprints)"
_OVER = "(least(a.lon1, b.lon1 + 360 * s) - greatest(a.lon0, b.lon0 + 360 * s)) * (least(a.lat1, b.lat1) - greatest(a.lat0, b.lat0)) / least((a.lon1 - a.lon0) * (a.lat1 - a.lat0), (b.lon1 - b.lon0) * (b.lat1 - b.lat0))"


@query("j6_box_pairs", with_tables("footprints", f"""{_WIDE} SELECT a.product_id AS a, b.product_id AS b, round({_OVER} + 1e-9, 6) AS fraction
FROM wide a JOIN (SELECT w.*, s FROM wide w, range(-1, 2) t(s)) b ON a.product_id < b.product_id AND least(a.lon1, b.lon1 + 360 * s) > greatest(a.lon0, b.lon0 + 360 * s) AND least(a.lat1, b.lat1) > greatest(a.lat0, b.lat0) WHERE {_OVER} >= 0.1"""))
def j6_box_pairs(spark, sf):
    """Footprints widened by up to 7 degrees, so that neighbours overlap."""
    f, p = table(spark, sf, "footprints"), F.col("product_id")
    f = f.select("product_id", "lon0", (F.col("lon1") + p % 7).alias("lon1"), (F.col("lat0") - p % 5).alias("lat0"), (F.col("lat1") + p % 4).alias("lat1"))
    return footprints.box_pairs(f, f, 0.1).where("product_id_a < product_id_b").select(F.col("product_id_a").alias("a"), F.col("product_id_b").alias("b"), F.round(F.col("fraction") + 1e-9, 6).alias("fraction"))


def _ring(lon0="lon0", lat0="lat0", shear="shear"):
    p = lambda lat, lon: F.struct((F.col(lat0) + lat).alias("lat"), (F.col(lon0) + F.col(shear) * lat + lon).alias("lon"))
    return F.array(p(0, 0.0), p(0, 3.0), p(4, 3.0), p(4, 0.0))


def _rings(spark, sf):
    return table(spark, sf, "quads").select("product_id", _ring().alias("ring"))


@query("x24_ring_area", with_tables("quads", f"SELECT product_id, round(12 * {KM_PER_DEG**2!r} * cos(radians(lat0 + 2)), 3) AS area FROM quads"))
def x24_ring_area(spark, sf):
    return _rings(spark, sf).select("product_id", F.round(geo.ring_area_km2("ring"), 3).alias("area"))


@query("x25_ring_bbox", with_tables("quads", "SELECT product_id, lon0 AS lon_min, lon0 + shear * 4 + 3 AS lon_max, lat0 AS lat_min, lat0 + 4 AS lat_max FROM quads"))
def x25_ring_bbox(spark, sf):
    b = geo.ring_bbox("ring")
    return _rings(spark, sf).select("product_id", b["lon0"].alias("lon_min"), b["lon1"].alias("lon_max"), b["lat0"].alias("lat_min"), b["lat1"].alias("lat_max"))


@query("x50_ring_centroid", with_tables("quads", "SELECT product_id, round(lat0 + 2, 6) AS lat, round(fmod(lon0 + shear * 2 + 1.5, 360), 6) AS lon FROM quads"))
def x50_ring_centroid(spark, sf):
    c = geo.ring_centroid("ring")
    return _rings(spark, sf).select("product_id", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


_KM = f"{KM_PER_DEG!r}::DOUBLE"
_SEG = "CASE WHEN n > 0 THEN greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / n)) ELSE 0 END"


@query("j5_polygon_overlap", with_tables("quads", f"""b AS (SELECT product_id, lon0, lat0, shear, lon0 + shear * 4 + 3 AS lon1 FROM quads),
near AS (SELECT a.product_id AS pa, b.product_id AS pb, a.lon0 AS xa, a.lat0 AS ya, a.shear AS sa, b.lon0 + 360 * s AS xb, b.lat0 AS yb, b.shear AS sb, cos(radians((a.lat0 + b.lat0 + 4) / 2)) AS k
 FROM b a JOIN (SELECT q.*, s FROM b q, range(-1, 2) t(s)) b ON a.product_id < b.product_id AND a.lon0 < b.lon1 + 360 * s AND b.lon0 + 360 * s < a.lon1 AND a.lat0 < b.lat0 + 4 AND b.lat0 < a.lat0 + 4),
c AS (SELECT *, [[0, 0], [0, 3], [4, 3], [4, 0]] AS o FROM near),
v AS (SELECT pa, pb, i, (xa + sa * o[i][1] + o[i][2]) * k * {_KM} AS ax, (ya + o[i][1]) * {_KM} AS ay, (xb + sb * o[i][1] + o[i][2]) * k * {_KM} AS bx, (yb + o[i][1]) * {_KM} AS by_ FROM c, range(1, 5) t(i)),
e AS (SELECT v.pa, v.pb, v.i, v.ax, v.ay, w.ax AS ax2, w.ay AS ay2, v.bx, v.by_, w.bx AS bx2, w.by_ AS by2 FROM v JOIN v w ON w.pa = v.pa AND w.pb = v.pb AND w.i = v.i % 4 + 1),
x AS (SELECT p.pa, p.pb, p.ax, p.ay, p.ax2, p.ay2, q.bx, q.by_, q.bx2, q.by2,
 (q.bx2 - q.bx) * (p.ay - q.by_) - (q.by2 - q.by_) * (p.ax - q.bx) AS d1, (q.bx2 - q.bx) * (p.ay2 - q.by_) - (q.by2 - q.by_) * (p.ax2 - q.bx) AS d2,
 (p.ax2 - p.ax) * (q.by_ - p.ay) - (p.ay2 - p.ay) * (q.bx - p.ax) AS d3, (p.ax2 - p.ax) * (q.by2 - p.ay) - (p.ay2 - p.ay) * (q.bx2 - p.ax) AS d4 FROM e p JOIN e q ON q.pa = p.pa AND q.pb = p.pb),
m AS (SELECT pa, pb, bool_or((d1 * d2 < 0 AND d3 * d4 < 0)
 OR (abs(d1) < 1e-9 AND ax BETWEEN least(bx, bx2) - 1e-9 AND greatest(bx, bx2) + 1e-9 AND ay BETWEEN least(by_, by2) - 1e-9 AND greatest(by_, by2) + 1e-9)
 OR (abs(d2) < 1e-9 AND ax2 BETWEEN least(bx, bx2) - 1e-9 AND greatest(bx, bx2) + 1e-9 AND ay2 BETWEEN least(by_, by2) - 1e-9 AND greatest(by_, by2) + 1e-9)
 OR (abs(d3) < 1e-9 AND bx BETWEEN least(ax, ax2) - 1e-9 AND greatest(ax, ax2) + 1e-9 AND by_ BETWEEN least(ay, ay2) - 1e-9 AND greatest(ay, ay2) + 1e-9)
 OR (abs(d4) < 1e-9 AND bx2 BETWEEN least(ax, ax2) - 1e-9 AND greatest(ax, ax2) + 1e-9 AND by2 BETWEEN least(ay, ay2) - 1e-9 AND greatest(ay, ay2) + 1e-9)) AS meet FROM x GROUP BY 1, 2),
i AS (SELECT e.pa, e.pb, sum(CASE WHEN (e.by2 > f.ay) <> (e.by_ > f.ay) AND f.ax < (e.bx2 - e.bx) * (f.ay - e.by_) / (e.by2 - e.by_) + e.bx THEN 1 ELSE 0 END) % 2 = 1 AS a_in,
 sum(CASE WHEN (e.ay2 > f.by_) <> (e.ay > f.by_) AND f.bx < (e.ax2 - e.ax) * (f.by_ - e.ay) / (e.ay2 - e.ay) + e.ax THEN 1 ELSE 0 END) % 2 = 1 AS b_in FROM e JOIN v f ON f.pa = e.pa AND f.pb = e.pb AND f.i = 1 GROUP BY 1, 2),
s AS (SELECT pa, pb, ax AS px, ay AS py, bx AS ax, by_ AS ay, bx2 AS bx, by2 AS by_, pow(bx2 - bx, 2) + pow(by2 - by_, 2) AS n FROM x UNION ALL SELECT pa, pb, bx, by_, ax, ay, ax2, ay2, pow(ax2 - ax, 2) + pow(ay2 - ay, 2) FROM x),
d AS (SELECT pa, pb, min(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))) AS far FROM (SELECT *, {_SEG} AS t FROM s) GROUP BY 1, 2)
SELECT m.pa AS product_id_a, m.pb AS product_id_b, meet OR a_in OR b_in AS overlaps, CASE WHEN meet OR a_in OR b_in THEN 0 ELSE round(far, 6) END AS separation_km FROM m JOIN i USING (pa, pb) JOIN d USING (pa, pb)"""))
def j5_polygon_overlap(spark, sf):
    """Quads against the quads whose boxes overlap theirs. Distances are rounded once a pair of rings."""
    judged, members = footprints.overlapping_rings(_rings(spark, sf))
    judged = judged.withColumn("separation_km", F.round("separation_km", 6)).drop("reason")
    return footprints.of_products(judged, members).select("product_id_a", "product_id_b", "overlaps", "separation_km")


@query("j4_points_in_polygons", with_tables("craters quads", """SELECT product_id, count(*) AS n FROM quads JOIN (SELECT crater_id, lon + 360 * s AS lon, lat FROM craters, range(0, 2) t(s)) c ON lat > lat0 AND lat < lat0 + 4 AND lon > lon0 + shear * (lat - lat0) AND lon < lon0 + shear * (lat - lat0) + 3 GROUP BY 1"""))
def j4_points_in_polygons(spark, sf):
    """Strictly inside: points on or next to an edge are settled by the quads' own numbers. Equal quads and craters of one place are looked at once."""
    own = ["lon0", "lat0", "shear"]
    quads = table(spark, sf, "quads")
    rings = quads.groupBy(*own).agg(F.min("product_id").alias("product_id")).withColumnsRenamed({c: f"q_{c}" for c in own})
    boxes = rings.withColumn("ring", _ring("q_lon0", "q_lat0", "q_shear")).select("*", geo.ring_bbox("ring").alias("b")).select(*[f"q_{c}" for c in own], "ring", "b.*")
    hits = catalog.in_boxes(catalog.places(table(spark, sf, "craters")), boxes)
    ring, p = F.transform("ring", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))), F.struct(F.col("lon_in").alias("x"), F.col("lat").alias("y"))
    edge = F.col("q_lon0") + F.col("q_shear") * (F.col("lat") - F.col("q_lat0"))
    strictly = (F.col("lat") > F.col("q_lat0")) & (F.col("lat") < F.col("q_lat0") + 4) & (F.col("lon_in") > edge) & (F.col("lon_in") < edge + 3)
    hits = hits.where(footprints.contains_point(ring, p) | (footprints.edge_distance(ring, p) < 1e-6)).where(strictly)
    counts = hits.groupBy(*[F.col(f"q_{c}").alias(c) for c in own]).agg(F.sum("n_here").alias("n"))
    return quads.join(counts.hint("merge"), own).groupBy("product_id").agg(F.sum("n").alias("n"))


# column functions on catalog rows


@query("x1_x2_longitudes", with_tables("craters", "SELECT crater_id, round(CASE WHEN lon - 400 < 0 THEN lon - 400 + 360 * ceil((400 - lon) / 360) ELSE lon - 400 END, 6) AS lon360, round(10 + fmod(lon - 10 + 180 + 360, 360) - 180, 6) AS unwrapped FROM craters"))
def x1_x2_longitudes(spark, sf):
    return table(spark, sf, "craters").select("crater_id", F.round(geo.lon360(F.col("lon") - 400), 6).alias("lon360"), F.round(geo.unwrap_lon("lon", 10.0), 6).alias("unwrapped"))


@query("x4_haversine", with_tables("craters", "SELECT crater_id, round(2 * 1737.4::DOUBLE * asin(sqrt(least(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 50) / 2), 2), 1))), 4) AS km FROM craters"))
def x4_haversine(spark, sf):
    return table(spark, sf, "craters").select("crater_id", F.round(geo.haversine_km(10.0, 50.0, "lat", "lon"), 4).alias("km"))


@query("x5_xyz_round_trip", with_tables("craters", "SELECT crater_id, round(1742.4::DOUBLE * cos(radians(lat)) * cos(radians(lon)), 4) AS x, round(1742.4::DOUBLE * cos(radians(lat)) * sin(radians(lon)), 4) AS y, round(1742.4::DOUBLE * sin(radians(lat)), 4) AS z, round(lat, 6) AS lat, CASE WHEN abs(lat) < 90 THEN round(lon, 6) END AS lon FROM craters"))
def x5_xyz_round_trip(spark, sf):
    c = table(spark, sf, "craters").withColumn("v", geo.to_xyz("lat", "lon", 5.0)).withColumn("b", geo.from_xyz("v"))
    return c.select("crater_id", F.round(F.col("v")[0], 4).alias("x"), F.round(F.col("v")[1], 4).alias("y"), F.round(F.col("v")[2], 4).alias("z"), F.round("b.lat", 6).alias("lat"), F.when(F.abs("lat") < 90, F.round("b.lon", 6)).alias("lon"))


@query("x6_x7_rotation_divergence", with_tables("craters", "SELECT crater_id, round(-lat, 6) AS y, 90.0::DOUBLE AS angle, round(degrees(atan2(abs(lat) + 1, 9)), 6) AS slant FROM craters"))
def x6_x7_rotation_divergence(spark, sf):
    c = table(spark, sf, "craters").withColumn("v", F.array("lat", "lon", F.lit(1.0)))
    turned = geo.rotate(F.array(*[F.lit(float(x)) for x in (0, 1, 0, -1, 0, 0, 0, 0, 1)]), "v")
    t = F.array("lat", "lon", F.lit(0.0))
    up, side = F.zip_with(t, F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0)), lambda a, b: a + b), F.zip_with(t, F.array(F.lit(4.0), F.lit(0.0), F.lit(0.0)), lambda a, b: a + b)
    slant = F.array(F.col("lat"), F.col("lon") + F.abs("lat") + 1, F.lit(9.0))
    return c.select("crater_id", F.round(turned[1], 6).alias("y"), F.round(geo.view_divergence(t, up, side), 6).alias("angle"), F.round(geo.view_divergence(t, up, slant), 6).alias("slant"))


@query("x8_solar", with_tables("craters", """SELECT crater_id, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(1.5)) + cos(radians(lat)) * cos(radians(1.5)) * cos(radians(120 - lon)))))), 4) AS incidence,
 round(fmod(degrees(atan2(sin(radians(120 - lon)) * cos(radians(1.5)), cos(radians(lat)) * sin(radians(1.5)) - sin(radians(lat)) * cos(radians(1.5)) * cos(radians(120 - lon)))) + 360, 360), 5) AS azimuth FROM craters"""))
def x8_solar(spark, sf):
    return table(spark, sf, "craters").select("crater_id", F.round(geo.solar_incidence("lat", "lon", 1.5, 120.0), 4).alias("incidence"), F.round(geo.solar_azimuth("lat", "lon", 1.5, 120.0), 5).alias("azimuth"))


@query("x23_dem_index", with_tables("craters", "SELECT crater_id, CAST(floor((90 - lat) * 64) AS BIGINT) AS dem_row, CAST(floor(lon * 64) AS BIGINT) % 23040 AS dem_col FROM craters"))
def x23_dem_index(spark, sf):
    return table(spark, sf, "craters").select("crater_id", geo.dem_row("lat").alias("dem_row"), geo.dem_col("lon").alias("dem_col"))


@query("x26_x43_extent_dem", with_tables("footprints", f"SELECT product_id, round(9 * {KM_PER_DEG!r}::DOUBLE, 6) AS along, round(6 * cos(radians(lat0)) * {KM_PER_DEG!r}::DOUBLE, 6) AS cross_km, 3 * 64.0::DOUBLE AS dem_rows, true AS sufficient FROM footprints"))
def x26_x43_extent_dem(spark, sf):
    f = table(spark, sf, "footprints")
    p = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    e = geo.frame_extent_km(F.array(p("lat0", "lon0"), p("lat0", "lon1"), p("lat1", "lon0"), p("lat1", "lon1")))
    d = geo.dem_pixels_per_cell("lat0", "lat1", "lon0", "lon1", 3)
    return f.select("product_id", F.round(e["along"], 6).alias("along"), F.round(e["cross"], 6).alias("cross_km"), d["rows"].alias("dem_rows"), d["sufficient"].alias("sufficient"))


@query("x20_x21_bilinear", with_tables("footprints", "SELECT product_id, round(lon0 + 6 * 0.25, 6) AS lon, round(lat0 + 9 * 0.5, 6) AS lat, 50.0::DOUBLE AS line, 10.0::DOUBLE AS sample, true AS inside FROM footprints"))
def x20_x21_bilinear(spark, sf):
    p = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    f = table(spark, sf, "footprints").withColumn("c", F.array(p("lat0", "lon0"), p("lat0", "lon1"), p("lat1", "lon0"), p("lat1", "lon1")))
    at = geo.bilinear_lonlat("c", F.lit(50), F.lit(10), F.lit(101), F.lit(41))
    f = f.withColumn("at", at).withColumn("back", geo.inverse_bilinear("c", "at.lon", "at.lat", F.lit(101), F.lit(41)))
    return f.select("product_id", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"), F.round("back.line", 6).alias("line"), F.round("back.sample", 6).alias("sample"), (F.col("back.residual") < 1e-12).alias("inside"))


@query("x28_sensor", "SELECT page_id, CASE WHEN b LIKE '%ohrc%' THEN 'ohrc' WHEN b LIKE '%tmc%' THEN 'tmc' WHEN b LIKE '%iirs%' THEN 'iirs' WHEN b LIKE '%nac%' THEN 'nac' ELSE 'unknown' END AS sensor FROM (SELECT page_id, lower(list_extract(string_split(url || CASE page_id % 4 WHEN 0 THEN '_TMC_nac' WHEN 1 THEN '_NAC' ELSE '' END, '/'), -1)) AS b FROM pages)")
def x28_sensor(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    url = F.concat("url", F.when(F.col("page_id") % 4 == 0, "_TMC_nac").when(F.col("page_id") % 4 == 1, "_NAC").otherwise(""))
    return p.select("page_id", text.sensor_of(url).alias("sensor"))


@query("x31_text_parses", with_tables("craters", "SELECT crater_id, round(diameter_km, 7) AS km, lon AS wkt_lon, lat AS pair_lat FROM craters"))
def x31_text_parses(spark, sf):
    c = table(spark, sf, "craters")
    w = text.wkt_point(F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    p = text.lonlat_pair(F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string")))
    return c.select("crater_id", F.round(text.leading_number(F.concat(F.col("diameter_km").cast("decimal(20,8)").cast("string"), F.lit(" km"))), 7).alias("km"), w["lon"].alias("wkt_lon"), p["lat"].alias("pair_lat"))


@query("x48_pair_key", with_tables("runs", "SELECT id, 'run_' || CASE WHEN id % 3 = 0 THEN 'unknown' ELSE 's' || CAST(id AS VARCHAR) END || '_x_' || sensor_type || '_' || strftime(ts, '%Y%m%d') AS key FROM runs"))
def x48_pair_key(spark, sf):
    r = table(spark, sf, "runs")
    src = F.when(F.col("id") % 3 != 0, F.concat(F.lit("s"), F.col("id").cast("string")))
    return r.select("id", text.pair_key("run", src, F.col("sensor_type"), F.col("ts")).alias("key"))


@query("j19_product_of_run", with_tables("runs", "SELECT id, CASE WHEN src_path LIKE '%self_pair%' THEN 'self_pair' END AS product_id FROM runs"))
def j19_product_of_run(spark, sf):
    products = spark.sql("select 'self_pair' as product_id, 1 as ord union all select 'self', 2")
    return history.enrich_with_products(table(spark, sf, "runs"), products).select("id", "product_id")


@query("x29_products_in_paths", """WITH p AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'ohr_' || c_custkey ELSE 'tmc_' || lpad(c_custkey::VARCHAR, 8, '0') || '_d' END AS product_id, c_custkey AS ord FROM customer),
r AS (SELECT o_orderkey AS id, 'data/' || CASE WHEN o_custkey % 5 = 0 THEN 'ohr_' || o_custkey ELSE 'tmc_' || lpad(o_custkey::VARCHAR, 8, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '_d' ELSE '_e' END END || o_orderkey % 10 || '.img' AS path FROM orders)
SELECT id, arg_min(product_id, ord) AS product_id FROM r LEFT JOIN p ON contains(path, product_id) GROUP BY 1""")
def x29_products_in_paths(spark, sf):
    """Every customer is a product; a path may hold several short ids, of which the first in order counts, or none."""
    name = lambda c, end: F.when(F.col(c) % 5 == 0, F.concat(F.lit("ohr_"), F.col(c).cast("string"))).otherwise(F.concat(F.lit("tmc_"), F.lpad(F.col(c).cast("string"), 8, "0"), end))
    products = spark.read.parquet(f"{sf}/customer.parquet").select(name("c_custkey", F.lit("_d")).alias("product_id"), F.col("c_custkey").alias("ord"))
    end = F.when(F.col("o_orderkey") % 2 == 0, "_d").otherwise("_e")
    path = F.concat(F.lit("data/"), name("o_custkey", end), (F.col("o_orderkey") % 10).cast("string"), F.lit(".img"))
    runs = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), path.alias("src_path"))
    return history.enrich_with_products(runs, products).select("id", "product_id")


# transforms and scores

_H = "h00 AS (SELECT s_suppkey AS run_id, 1.2 + mod(s_suppkey, 10) * CAST(0.5 AS DOUBLE) AS a FROM supplier)"


def _homographies(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    h = [1.2 + F.col("s_suppkey") % 10 * 0.5, -0.1, 5.0, 0.1, 1.2, -3.0, 0.0, 0.0, 1.0]
    return s.select(F.col("s_suppkey").alias("run_id"), F.array(*[x if not isinstance(x, float) else F.lit(x) for x in h]).alias("h"))


@query("x12_x15_decompose", f"WITH {_H}, v AS (SELECT run_id, a, sqrt((a + 1.2) * (a + 1.2) + 0.04) AS p, abs(a - 1.2) AS q FROM h00) SELECT run_id, round(degrees(atan2(0.1, a)), 6) AS rotation, round(sqrt(a * a + 0.01), 6) AS scale, round((p + q) / abs(p - q), 5) AS condition, round((p + abs(p - q) / 2 + q / 2 - p / 2) / 2, 6) AS mean_scale, round(greatest(a / 2, 2 / a), 6) AS disagreement FROM v")
def x12_x15_decompose(spark, sf):
    h = _homographies(spark, sf)
    d, s = transforms.decompose("h"), transforms.singular_values("h")
    return h.select("run_id", F.round(d["rotation_deg"], 6).alias("rotation"), F.round(d["scale"], 6).alias("scale"), F.round(transforms.condition_ratio("h"), 5).alias("condition"), F.round(transforms.mean_scale("h"), 6).alias("mean_scale"), F.round(transforms.scale_disagreement(F.col("h")[0], F.lit(2.0)), 6).alias("disagreement"))


@query("x10_x47_project_inverse", with_tables("match_points", "SELECT run_id, match_idx, round(src_x * 1.2 - src_y * 0.1 + 5 + 1e-9, 6) AS px, round(src_x, 6) AS bx, round(src_y, 6) AS by_ FROM match_points"))
def x10_x47_project_inverse(spark, sf):
    m = table(spark, sf, "match_points").withColumn("h", F.array(*[F.lit(x) for x in (1.2, -0.1, 5.0, 0.1, 1.2, -3.0, 0.0, 0.0, 1.0)]))
    p = transforms.project("h", "src_x", "src_y")
    m = m.withColumn("p", p).withColumn("b", transforms.project(transforms.inverse("h"), "p.x", "p.y"))
    return m.select("run_id", "match_idx", F.round(F.col("p.x") + 1e-9, 6).alias("px"), (F.round("b.x", 6) + 0.0).alias("bx"), (F.round("b.y", 6) + 0.0).alias("by_"))


@query("x16_x17_levelling", "SELECT s_suppkey AS run_id, CASE WHEN s >= 1.8 THEN 'reference' WHEN s <= 1 / 1.8 THEN 'source' ELSE 'none' END AS side, CASE WHEN s <= 1 / 1.8 THEN 1 / s ELSE 1.0 END AS src_factor FROM (SELECT s_suppkey, (mod(s_suppkey, 30) + 1) / CAST(10 AS DOUBLE) AS s FROM supplier)")
def x16_x17_levelling(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("n", (F.col("s_suppkey") % 30 + 1).cast("double"))
    lv = transforms.levelling(transforms.dimension_scale(F.lit(10.0), F.lit(10.0), "n", "n"))
    return s.select(F.col("s_suppkey").alias("run_id"), lv["side"].alias("side"), lv["src_factor"].alias("src_factor"))


@query("x36_x18_truth_corners", "SELECT s_suppkey AS run_id, round(0.0::DOUBLE, 6) AS same, round(sqrt(2) * 2, 6) AS off FROM supplier")
def x36_x18_truth_corners(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("h", transforms.variant_transform(F.lit(1.5), (F.col("s_suppkey") % 90).cast("double"), F.lit(100.0), F.lit(80.0)))
    moved = F.transform("h", lambda x, i: F.when(i.isin(2, 5), x + 2).otherwise(x))
    return s.select(F.col("s_suppkey").alias("run_id"), F.round(transforms.corner_errors("h", "h", F.lit(100.0), F.lit(80.0))["max_px"], 6).alias("same"), F.round(transforms.corner_errors(moved, "h", F.lit(100.0), F.lit(80.0))["mean_px"], 6).alias("off"))


_VERDICT = """v AS (SELECT *, CASE WHEN total_matches < 20 OR floor(total_matches * inlier_ratio) < 20 THEN 1 ELSE 0 END + CASE WHEN inlier_ratio < 0.5 THEN 1 ELSE 0 END + CASE WHEN isnan(rmse) OR rmse >= 3 THEN 1 ELSE 0 END + CASE WHEN uniformity * 30 > 15 THEN 1 ELSE 0 END AS n FROM runs)"""


_LESS = "floor(total_matches * inlier_ratio)"
_RULES = f"""w AS (SELECT *, list_filter([CASE WHEN total_matches < 20 OR {_LESS} < 20 THEN printf('only %d inliers of %d matches, 20 needed', CAST({_LESS} AS BIGINT), total_matches) END,
 CASE WHEN inlier_ratio < 0.5 THEN printf('inlier ratio %.2f below 0.50', inlier_ratio) END, CASE WHEN isnan(rmse) OR rmse IS NULL THEN 'no valid rmse after refinement' WHEN rmse >= 3 THEN 'rmse after refinement' END,
 CASE WHEN uniformity * 30 > 15 THEN printf('rotation-consistency spread %.1f deg, limit 15.0 deg', uniformity * 30) END], lambda x: x IS NOT NULL) AS reasons FROM runs)"""


def _judged(spark, sf):
    v = scoring.verdict("total_matches", F.floor(F.col("total_matches") * F.col("inlier_ratio")), "inlier_ratio", "rmse", F.col("uniformity") * 30)
    return table(spark, sf, "runs").withColumn("v", v)


@query("x33_verdict", with_tables("runs", f"{_RULES} SELECT id, len(reasons) = 0 AS validated, CASE WHEN len(reasons) = 0 THEN 'validated' ELSE 'exploratory' END AS label, list_aggregate(list_transform(reasons, lambda r: split_part(r, ' px', 1)), 'string_agg', '; ') AS reasons FROM w"))
def x33_verdict(spark, sf):
    """The reasons themselves; of the one with the rmse the text before its number, which two printers may round apart."""
    reasons = F.transform("v.reasons", lambda r: F.regexp_replace(r, "^rmse after refinement.*", "rmse after refinement"))
    return _judged(spark, sf).select("id", "v.validated", "v.label", F.nullif(F.array_join(reasons, "; "), F.lit("")).alias("reasons"))


_STEPS = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in scoring.NEXT_STEPS)


@query("x34_next_steps", with_tables("runs", f"{_RULES}, l AS (SELECT id, len(reasons) = 0 AS ok, lower(coalesce(array_to_string(reasons, ' '), '')) AS t FROM w), f AS (SELECT id, ok, list_filter([{_STEPS}], lambda x: x IS NOT NULL) AS found FROM l) SELECT id, CASE WHEN ok THEN '{scoring.NO_STEP}' WHEN len(found) > 0 THEN array_to_string(found, '; ') ELSE '{scoring.DEFAULT_STEP}' END AS steps FROM f"))
def x34_next_steps(spark, sf):
    return _judged(spark, sf).select("id", F.array_join(scoring.next_steps("v.validated", "v.reasons"), "; ").alias("steps"))


_LOW = lambda v, limit: f"CASE WHEN {v} = 0 THEN 160 WHEN {v} > 0 THEN least({limit} / {v} * 100, 160) ELSE 0 END"


@query("x35_radar", with_tables("runs", " UNION ALL ".join(f"SELECT id, '{n}' AS axis, round({e} + 1e-9, 6) AS pct, {a} AS available FROM runs" for n, e, a in (
    ("inlier_count", "least(total_matches / 20.0::DOUBLE * 100, 160)", "total_matches IS NOT NULL"), ("inlier_ratio", "least(inlier_ratio / 0.5 * 100, 160)", "true"),
    ("rotation_consistency", _LOW("(uniformity * 30)", "15.0::DOUBLE"), "true"), ("rmse", _LOW("rmse", "3"), "rmse >= 0"), ("condition_ratio", _LOW("(1 + inlier_ratio * 9)", "5"), "true")))))
def x35_radar(spark, sf):
    axes = F.explode(scoring.radar("total_matches", "inlier_ratio", F.col("uniformity") * 30, "rmse", 1 + F.col("inlier_ratio") * 9)).alias("a")
    return table(spark, sf, "runs").select("id", axes).select("id", "a.axis", F.round(F.col("a.pct") + 1e-9, 6).alias("pct"), "a.available")


@query("x39_improvement", with_tables("runs", "SELECT id, round(CASE WHEN rmse > 0 THEN (rmse - uniformity) / rmse * 100 END, 6) AS pct FROM runs"))
def x39_improvement(spark, sf):
    return table(spark, sf, "runs").select("id", F.round(scoring.improvement_pct("rmse", "uniformity"), 6).alias("pct"))


@query("x9_x32_light", with_tables("telemetry", "SELECT record_num, round(90 - elevation, 6) AS incidence, round(cos(radians(elevation)) * sin(radians(azimuth)), 6) AS lx, round(sin(radians(elevation)), 6) AS lz FROM telemetry"))
def x9_x32_light(spark, sf):
    v = geo.light_vector("elevation", "azimuth")
    return table(spark, sf, "telemetry").select("record_num", F.round(geo.incidence_from_elevation("elevation"), 6).alias("incidence"), F.round(v[0], 6).alias("lx"), F.round(v[2], 6).alias("lz"))


@query("x19_x49_angles", with_tables("telemetry", "SELECT record_num, round(abs(fmod(azimuth - 200 + 180 + 360, 360) - 180), 6) AS diff FROM telemetry"))
def x19_x49_angles(spark, sf):
    return table(spark, sf, "telemetry").select("record_num", F.round(geo.angular_diff("azimuth", 200.0), 6).alias("diff"))


# further column functions, gates and reports


@query("x22_line_fraction", with_tables("craters footprints", f"SELECT product_id, crater_id, round((lat - lat0) / (lat1 - lat0), 6) AS fraction FROM footprints JOIN craters ON {_IN}"))
def x22_line_fraction(spark, sf):
    hits = catalog.each_in_boxes(table(spark, sf, "craters").select("crater_id", "lon", "lat"), table(spark, sf, "footprints"), fraction=F.round(geo.line_fraction("lat", "lat0", "lat1"), 6))
    return hits.select("product_id", "crater_id", "fraction")


@query("x27_gsd", with_tables("footprints", f"""p AS (SELECT *, CASE WHEN product_id % 3 = 0 THEN 250.0::DOUBLE END AS grid_km, CASE WHEN product_id % 3 = 1 THEN 1200 END AS bl, 9000.0::DOUBLE AS area FROM footprints)
SELECT product_id, CASE WHEN grid_km IS NOT NULL THEN 'grid' WHEN bl IS NOT NULL THEN 'box' ELSE 'area' END AS method,
 round(coalesce(grid_km * 1000 / 2000, ((lat1 - lat0) * {KM_PER_DEG!r} / bl + (lon1 - lon0) * cos(radians((lat0 + lat1) / 2)) * {KM_PER_DEG!r} / 600) / 2 * 1000, sqrt(area * 1e6 / (1200 * 600))), 6) AS gsd_m FROM p"""))
def x27_gsd(spark, sf):
    """Each product has the inputs of one of the three methods; the box needs its own line count."""
    p, k = table(spark, sf, "footprints"), F.col("product_id") % 3
    p = p.withColumn("grid_km", F.when(k == 0, 250.0)).withColumn("grid_lines", F.lit(2000)).withColumn("area_km2", F.lit(9000.0)).withColumn("lines", F.lit(1200)).withColumn("samples", F.lit(600))
    p = p.withColumn("lat0", F.when(k == 1, F.col("lat0"))).withColumn("lat1", F.when(k == 1, F.col("lat1")))
    return footprints.gsd(p).select("product_id", F.col("gsd_method").alias("method"), F.round("gsd_m", 6).alias("gsd_m"))


@query("x30_times", with_tables("runs", "SELECT id, ts AS z, ts - INTERVAL 5 HOUR AS shifted, NULL::TIMESTAMP AS bad FROM runs"))
def x30_times(spark, sf):
    r = table(spark, sf, "runs").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    when = lambda c: text.parse_time(c).cast("timestamp_ntz")
    return r.select("id", when(F.concat("t", F.lit("Z"))).alias("z"), when(F.concat("t", F.lit("+05:00"))).alias("shifted"), when(F.concat(F.lit("on "), "t")).alias("bad"))


@query("x38_quadrants", with_tables("footprints", "SELECT product_id, r, k, CASE WHEN r < 1.5 THEN 'north' ELSE 'south' END || CASE WHEN k < 1.5 THEN 'west' ELSE 'east' END AS quadrant FROM footprints, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS k) ORDER BY product_id, r, k"))
def x38_quadrants(spark, sf):
    """Cells row by row, each with its quadrant."""
    cells = catalog.grid_of(table(spark, sf, "footprints"), 3).select("product_id", "r", "k", geo.quadrant("r", "k", 3).alias("quadrant"))
    return catalog.in_reading_order(cells, ("product_id", "r", "k"))


@query("x41_rescale", f"WITH {_H} SELECT run_id, round(a * 0.25 / 0.5, 6) AS a, -0.05::DOUBLE AS b, 1.25::DOUBLE AS tx FROM h00")
def x41_rescale(spark, sf):
    h = _homographies(spark, sf)
    full = transforms.rescale("h", F.lit(0.5), F.lit(0.25))
    return h.withColumn("f", full).select("run_id", F.round(F.col("f")[0], 6).alias("a"), F.round(F.col("f")[1], 6).alias("b"), F.round(F.col("f")[2], 6).alias("tx"))


@query("x42_sample_types", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '>u2' WHEN 1 THEN '<i2' WHEN 2 THEN '<f4' END AS dtype, CASE p_size % 4 WHEN 3 THEN NULL WHEN 2 THEN 4 ELSE 2 END AS bytes, CASE WHEN p_size % 4 = 3 THEN 'unsupported sample type VAX_REAL' END AS warning FROM part")
def x42_sample_types(spark, sf):
    k = F.col("p_size") % 4
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("t", F.when(k == 0, "UnsignedMSB2").when(k == 1, "SignedLSB2").when(k == 2, "IEEE754LSBSingle").otherwise("VAX_REAL"))
    d = text.sample_dtype("t", F.when(k == 2, 32).otherwise(16))
    return p.select(F.col("p_partkey").alias("id"), d["dtype"].alias("dtype"), d["bytes"].alias("bytes"), d["warning"].alias("warning"))


@query("x44_availability", with_tables("sweep_results", "SELECT source_id, x, err_m IS NOT NULL AS available, round(err_m, 6) AS value, CASE WHEN err_m IS NULL THEN 'no error in metres' END AS reason FROM sweep_results"))
def x44_availability(spark, sf):
    v = scoring.availability("err_m", "no error in metres")
    return table(spark, sf, "sweep_results").select("source_id", "x", v["available"].alias("available"), F.round(v["value"], 6).alias("value"), v["reason"].alias("reason"))


@query("f8_not_identity", "SELECT s_suppkey AS run_id FROM supplier WHERE s_suppkey % 4 <> 0")
def f8_not_identity(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("e", F.when(F.col("s_suppkey") % 4 == 0, 1e-8).otherwise(0.01))
    h = F.array(*[F.lit(float(i % 4 == 0)) + (F.col("e") if i == 2 else 0.0) for i in range(9)])
    return s.where(~transforms.is_identity(h)).select(F.col("s_suppkey").alias("run_id"))


@query("f9_camera_files", "SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0")
def f9_camera_files(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    exif = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("271"), F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("256"), F.col("p_name")))
    return labels.reject_camera_files(p.select(F.col("p_partkey").alias("id"), exif.alias("exif"))).select("id")


@query("f12_overlap_gate", "SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN 'apart' ELSE 'on' END AS way FROM orders")
def f12_overlap_gate(spark, sf):
    """Pairs whose footprints lie apart stop; those that overlap and those without a check go on."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("pair_id"))
    checks = o.where("pair_id % 3 < 2").select("pair_id", (F.col("pair_id") % 3 == 1).alias("overlaps"), F.lit("apart").alias("reason"))
    on, stopped = footprints.overlap_gate(o, checks)
    return on.select("pair_id", F.lit("on").alias("way")).unionByName(stopped.select("pair_id", F.col("reason").alias("way")))


@query("f14_allow_list", with_tables("footprints", "SELECT product_id FROM footprints WHERE product_id IN (SELECT n_nationkey FROM nation)"))
def f14_allow_list(spark, sf):
    allow = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("product_id"))
    return catalog.allowed(table(spark, sf, "footprints"), allow).select("product_id")


@query("u3_candidates", with_tables("named_features", "SELECT 'crater' AS kind, name, lat, lon, diameter_km FROM named_features WHERE name IS NOT NULL AND diameter_km >= 40 UNION ALL SELECT 'massif', n_name, n_nationkey * 2.0::DOUBLE, n_regionkey * 9.0::DOUBLE, NULL FROM nation"))
def u3_candidates(spark, sf):
    m = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_regionkey") * 9.0).alias("lon"))
    return catalog.candidates(table(spark, sf, "named_features"), m, 40.0)


_REPORT = f"""{_RULES}, r AS (SELECT *, total_matches % 100 + 1 AS product_id FROM w),
g AS (SELECT product_id, count(*) AS n, avg(diameter_km) AS mean_d FROM footprints JOIN craters ON {_IN} GROUP BY 1),
q AS (SELECT product_id AS point_id, (lon0 + lon1) / 2 AS px, (lat0 + lat1) / 2 AS py FROM footprints),
f AS (SELECT point_id, feature_id, name, 2 * 1737.4::DOUBLE * asin(sqrt(least(pow(sin(radians(named_features.lat - py) / 2), 2) + cos(radians(py)) * cos(radians(named_features.lat)) * pow(sin(radians(named_features.lon - px) / 2), 2), 1))) AS km
 FROM q JOIN named_features ON abs(named_features.lat - py) <= 5 AND least(abs(named_features.lon - px), 360 - abs(named_features.lon - px)) <= 5),
b AS (SELECT point_id, arg_min(name, [km, feature_id]) AS name, min(km) AS km FROM f GROUP BY 1),
s AS (SELECT record_num % 20 AS product_id, count(*) AS n_records, avg(90 - elevation) AS inc FROM telemetry GROUP BY 1)"""


@query("a36_run_report", with_tables("runs craters footprints named_features telemetry", f"""{_REPORT} SELECT r.id AS run_id, r.product_id, len(reasons) = 0 AS validated, CAST(len(reasons) AS INTEGER) AS n_reasons, CASE WHEN p.product_id IS NOT NULL THEN coalesce(g.n, 0) END AS n_craters, round(g.mean_d + 1e-9, 6) AS mean_d,
 b.name AS nearest_name, round(b.km, 6) AS nearest_km, s.n_records, round(s.inc + 1e-9, 6) AS mean_incidence, CASE WHEN r.id % 2 = 0 THEN 'no footprint' END AS geometry_reason
FROM r LEFT JOIN footprints p ON p.product_id = r.product_id LEFT JOIN g ON g.product_id = r.product_id LEFT JOIN b ON b.point_id = r.product_id LEFT JOIN s ON s.product_id = r.product_id"""))
def a36_run_report(spark, sf):
    """One wide row a run, out of five tables."""
    runs, boxes = table(spark, sf, "runs"), table(spark, sf, "footprints")
    r = runs.select(F.col("id").alias("run_id"), (F.col("total_matches") % 100 + 1).alias("product_id"), F.col("total_matches").alias("total"), F.floor(F.col("total_matches") * F.col("inlier_ratio")).alias("inliers"), F.col("inlier_ratio").alias("ratio"), "rmse", (F.col("uniformity") * 30).alias("rotation_std"))
    points = boxes.select(F.col("product_id").alias("point_id"), ((F.col("lon0") + F.col("lon1")) / 2).alias("lon"), ((F.col("lat0") + F.col("lat1")) / 2).alias("lat"))
    geometry = runs.where("id % 2 = 0").select(F.col("id").alias("run_id"), F.lit(None).cast("double").alias("divergence_deg"), F.lit("no footprint").alias("reason"))
    sun = telemetry.telemetry_summary(table(spark, sf, "telemetry").withColumn("product_id", F.col("record_num") % 20))
    out = history.run_reports(r, catalog.footprint_stats(table(spark, sf, "craters"), boxes), catalog.nearest_feature(points, table(spark, sf, "named_features")), geometry, sun)
    return out.select("run_id", "product_id", "validated", F.size("reasons").alias("n_reasons"), "n_craters", _even("mean_d"), "nearest_name", F.round("nearest_km", 6).alias("nearest_km"), "n_records", _even("mean_incidence"), "geometry_reason")
