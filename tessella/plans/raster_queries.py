"""Queries on the pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.operators import detections, raster
from tessella.plans.fixtures import table, with_tables
from tessella.plans.registry import query

_B = 'pixels_b AS (SELECT raster_id, "row", col, lead(value, 17, value) OVER (ORDER BY "row", col) AS value FROM pixels)'


def _pixels(spark, sf):
    return table(spark, sf, "pixels")


def _other(spark, sf):
    """A second raster: each pixel holds the value 17 places on, the last ones their own."""
    p = _pixels(spark, sf)
    at = F.col("row") * 100 + F.col("col")
    on = p.select("raster_id", (at - 17).alias("at"), F.col("value").alias("next"))
    return p.withColumn("at", at).join(on, ["raster_id", "at"], "left").select("raster_id", "row", "col", F.coalesce("next", "value").alias("value"))


_BOUNDS = "q AS (SELECT raster_id, quantile_cont(value, [0.02, 0.25, 0.5, 0.75, 0.98]) AS p FROM pixels GROUP BY 1), b AS (SELECT raster_id, greatest(p[1], p[3] - 3 * (p[4] - p[2])) AS lo, least(p[5], p[3] + 3 * (p[4] - p[2])) AS hi FROM q)"


@query("a22_stretch_bounds", with_tables("pixels", "SELECT raster_id, round(quantile_cont(value, 0.01), 6) AS lo, round(quantile_cont(value, 0.99), 6) AS hi FROM pixels GROUP BY 1"))
def a22_stretch_bounds(spark, sf):
    return raster.stretch_bounds(_pixels(spark, sf)).select("raster_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("a23_adaptive_bounds", with_tables("pixels", f"{_BOUNDS} SELECT raster_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b"))
def a23_adaptive_bounds(spark, sf):
    return raster.adaptive_bounds(_pixels(spark, sf)).select("raster_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("r1_stretch", with_tables("pixels", f'{_BOUNDS} SELECT raster_id, "row", col, CAST(floor(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-6))) * 255) AS INTEGER) AS value FROM pixels JOIN b USING (raster_id)'))
def r1_stretch(spark, sf):
    p = _pixels(spark, sf)
    return raster.stretch(p, raster.adaptive_bounds(p))


@query("a24_shadow", with_tables("pixels", f"{_BOUNDS} SELECT raster_id, round(lo, 6) AS threshold, count(*) FILTER (value < lo) AS n_shadow, round(avg(CAST(value < lo AS INTEGER)), 8) AS fraction FROM pixels JOIN b USING (raster_id) GROUP BY 1, lo"))
def a24_shadow(spark, sf):
    s = raster.shadow_summary(raster.shadow_mask(_pixels(spark, sf)))
    return s.select("raster_id", F.round("threshold", 6).alias("threshold"), "n_shadow", F.round("fraction", 8).alias("fraction"))


@query("a25_contrast", with_tables("pixels", f"{_BOUNDS}, s AS (SELECT raster_id, value, floor(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-6))) * 255) AS v FROM pixels JOIN b USING (raster_id)) SELECT raster_id, round(stddev_pop(v) / stddev_pop(value), 6) AS recovery FROM s GROUP BY 1"))
def a25_contrast(spark, sf):
    p = _pixels(spark, sf)
    return raster.contrast_recovery(p, raster.stretch(p, raster.adaptive_bounds(p))).select("raster_id", F.round("recovery", 6).alias("recovery"))


@query("a33_block_mean", with_tables("pixels", 'SELECT raster_id, "row" // 4 AS "row", col // 4 AS col, round(avg(value) + 1e-9, 6) AS value FROM pixels GROUP BY 1, 2, 3'))
def a33_block_mean(spark, sf):
    return raster.block_mean(_pixels(spark, sf), 4).select("raster_id", "row", "col", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query("a33_pyramid", with_tables("pixels", "h AS (SELECT max(\"row\") + 1 AS h FROM pixels) SELECT CAST(l AS INTEGER) AS level, count(*) AS n FROM (SELECT DISTINCT l, \"row\" // CAST(pow(2, l) AS BIGINT) AS r, col // CAST(pow(2, l) AS BIGINT) AS c FROM pixels, range(0, 2) t(l), h WHERE l = 0 OR h.h // 2 >= 32) GROUP BY 1"))
def a33_pyramid(spark, sf):
    p = _pixels(spark, sf)
    h = p.agg(F.max("row")).first()[0] + 1
    return raster.pyramid(p, h, 100).groupBy("level").agg(F.count("*").alias("n"))


_ROWS = 'OVER (PARTITION BY raster_id, "row" ORDER BY col ROWS UNBOUNDED PRECEDING)'


@query("w4_integral", with_tables("pixels", f'r AS (SELECT raster_id, "row", col, sum(value) {_ROWS} AS v FROM pixels) SELECT raster_id, "row", col, round(sum(v) OVER (PARTITION BY raster_id, col ORDER BY "row" ROWS UNBOUNDED PRECEDING), 2) AS sat FROM r'))
def w4_integral(spark, sf):
    return raster.integral(_pixels(spark, sf), block=32).select("raster_id", "row", "col", F.round("sat", 2).alias("sat"))


@query("w5_horizon_shadow", with_tables("pixels", 'g AS (SELECT *, value * 10 + col * tan(radians(20)) AS g FROM pixels) SELECT raster_id, "row", col, coalesce(g < max(g) OVER (PARTITION BY raster_id, "row" ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1e-6, false) AS shadow FROM g'))
def w5_horizon_shadow(spark, sf):
    d = _pixels(spark, sf).withColumn("value", F.col("value") * 10)
    return raster.horizon_shadow(d, 20.0).select("raster_id", "row", "col", "shadow")


_SUNS = (250.0, 315.0, 20.0)


def _skewed(azimuth: float) -> str:
    ux, uy = round(-math.sin(math.radians(azimuth)), 15), round(math.cos(math.radians(azimuth)), 15)
    along, across, u, v = ("col", '"row"', ux, uy) if abs(ux) >= abs(uy) else ('"row"', "col", uy, ux)
    line = f"floor({across} - {along} * ({v / u!r})::DOUBLE + 0.5::DOUBLE)"
    return f"""SELECT {azimuth} AS azimuth, "row", col, coalesce(g < max(g) OVER (PARTITION BY line ORDER BY {'' if u > 0 else '-'}{along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1e-6, false) AS shadow
 FROM (SELECT *, {line} AS line, value * 10 + (col * ({ux!r})::DOUBLE + "row" * ({uy!r})::DOUBLE) * ({math.tan(math.radians(20))!r})::DOUBLE AS g FROM pixels)"""


@query("w5_any_azimuth", with_tables("pixels", "s AS (" + " UNION ALL ".join(_skewed(a) for a in _SUNS) + ") SELECT CAST(azimuth AS DOUBLE) AS azimuth, \"row\", col, shadow FROM s"))
def w5_any_azimuth(spark, sf):
    """Suns in the west-south-west, north-west and north-north-east."""
    d = _pixels(spark, sf).withColumn("value", F.col("value") * 10)
    each = [raster.cast_shadow(d, 20.0, a).select(F.lit(a).alias("azimuth"), "row", "col", "shadow") for a in _SUNS]
    return each[0].unionByName(each[1]).unionByName(each[2])


_GX = 'CASE WHEN lag(value) OVER x IS NULL AND lead(value) OVER x IS NULL THEN 0 WHEN lag(value) OVER x IS NULL THEN lead(value) OVER x - value WHEN lead(value) OVER x IS NULL THEN value - lag(value) OVER x ELSE (lead(value) OVER x - lag(value) OVER x) / 2 END'
_WIN = 'WINDOW x AS (PARTITION BY raster_id, "row" ORDER BY col), y AS (PARTITION BY raster_id, col ORDER BY "row")'


@query("w6_gradients", with_tables("pixels", f'SELECT raster_id, "row", col, round({_GX} + 1e-9, 6) AS gx, round({_GX.replace("OVER x", "OVER y")} + 1e-9, 6) AS gy FROM pixels {_WIN}'))
def w6_gradients(spark, sf):
    g = raster.gradients(_pixels(spark, sf))
    return g.select("raster_id", "row", "col", F.round(F.col("gx") + 1e-9, 6).alias("gx"), F.round(F.col("gy") + 1e-9, 6).alias("gy"))


@query("w6_sobel", with_tables("pixels", """n AS (SELECT a.raster_id, a."row", a.col, sum((b.col - a.col) * (CASE WHEN a."row" = b."row" THEN 2 ELSE 1 END) * b.value) AS gx, sum((b."row" - a."row") * (CASE WHEN a.col = b.col THEN 2 ELSE 1 END) * b.value) AS gy, count(*) AS n
 FROM pixels a, range(-1, 2) i(i), range(-1, 2) j(j), pixels b WHERE b.raster_id = a.raster_id AND b."row" = a."row" + i AND b.col = a.col + j GROUP BY 1, 2, 3) SELECT raster_id, "row", col, round(gx + 1e-9, 6) AS gx, round(gy + 1e-9, 6) AS gy FROM n WHERE n = 9"""))
def w6_sobel(spark, sf):
    g = raster.sobel(_pixels(spark, sf))
    return g.select("raster_id", "row", "col", F.round(F.col("gx") + 1e-9, 6).alias("gx"), F.round(F.col("gy") + 1e-9, 6).alias("gy"))


_LOCAL = """h AS (SELECT max("row") AS last FROM pixels),
n AS (SELECT a."row", a.col, avg(b.value) AS mean, var_pop(b.value) AS variance FROM pixels a, range(-2, 3) i(i), range(-2, 3) j(j), pixels b
 WHERE b."row" = a."row" + i AND b.col = (a.col + j + 100) % 100 GROUP BY 1, 2)"""


@query("w7_local_stats", with_tables("pixels", f'{_LOCAL} SELECT "row", col, round(mean + 1e-9, 5) AS mean, round(variance, 3) AS variance FROM n'))
def w7_local_stats(spark, sf):
    return raster.local_stats(_pixels(spark, sf), 2, 100).select("row", "col", F.round(F.col("mean") + 1e-9, 5).alias("mean"), F.round("variance", 3).alias("variance"))


@query("k4_top_variance", with_tables("pixels", f'{_LOCAL} SELECT "row", col, round(variance, 3) AS variance FROM n ORDER BY n.variance DESC, "row", col LIMIT 5'))
def k4_top_variance(spark, sf):
    return raster.top_variance(raster.local_stats(_pixels(spark, sf), 2, 100)).select("row", "col", F.round("variance", 3).alias("variance"))


@query("r4_difference", with_tables("pixels", f'{_B} SELECT a.raster_id, a."row", a.col, round(abs(a.value - b.value) + 1e-9, 6) AS value FROM pixels a JOIN pixels_b b ON a."row" = b."row" AND a.col = b.col'))
def r4_difference(spark, sf):
    return raster.difference(_pixels(spark, sf), _other(spark, sf)).select("raster_id", "row", "col", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query("j10_alignment", with_tables("pixels", "SELECT raster_id, CAST(sum(CAST(col >= 90 AS INTEGER)) AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, CAST(sum(CAST(col < 90 AS INTEGER)) AS BIGINT) AS both_, false AS aligned FROM pixels GROUP BY 1"))
def j10_alignment(spark, sf):
    p = _pixels(spark, sf)
    return raster.alignment(p, p.where("col < 90")).withColumnRenamed("both", "both_")


@query("r5_grid_compatible", with_tables("footprints", "SELECT product_id AS raster_id, true AS resolution, product_id % 2 = 0 AS shape, product_id % 3 = 0 AS origin, product_id % 6 = 0 AS compatible FROM footprints"))
def r5_grid_compatible(spark, sf):
    f = table(spark, sf, "footprints").select(F.col("product_id").alias("raster_id"), F.lit(10).alias("height"), F.lit(20).alias("width"), F.lit(0.5).alias("res_x"), F.lit(0.5).alias("res_y"), F.col("lon0").alias("x0"), F.col("lat0").alias("y0"))
    other = f.withColumn("height", F.col("height") + F.col("raster_id") % 2).withColumn("x0", F.col("x0") + F.col("raster_id") % 3)
    return raster.grid_compatible(f, other).select("raster_id", "resolution", "shape", "origin", "compatible")


@query("r6_hillshade", with_tables("pixels", f"""g AS (SELECT raster_id, "row", col, ({_GX}) / 100 AS gx, ({_GX.replace("OVER x", "OVER y")}) / 100 AS gy FROM pixels {_WIN})
SELECT raster_id, "row", col, round(greatest((-gx * cos(radians(30)) * sin(radians(135)) + gy * cos(radians(30)) * cos(radians(135)) + sin(radians(30))) / sqrt(gx * gx + gy * gy + 1), 0), 6) AS shade FROM g"""))
def r6_hillshade(spark, sf):
    return raster.hillshade(_pixels(spark, sf), 30.0, 135.0, 100.0).select("raster_id", "row", "col", F.round("shade", 6).alias("shade"))


def _height(p):
    return p.agg(F.max("row")).first()[0] + 1


@query("j11_resample", with_tables("pixels", """h AS (SELECT max("row") + 1 AS h FROM pixels), g AS (SELECT i AS r, j AS c, (i + 0.5::DOUBLE) * 2 - 0.5 AS y, (j + 0.5::DOUBLE) * 2 - 0.5 AS x FROM h, range(0, 10000000) a(i), range(0, 50) b(j) WHERE i < h // 2),
t AS (SELECT r, c, unnest([floor(y), floor(y) + 1]) AS ty, x FROM g), u AS (SELECT r, c, CAST(ty AS BIGINT) AS ty, CAST(unnest([floor(x), floor(x) + 1]) AS BIGINT) AS tx FROM t)
SELECT CAST(0 AS BIGINT) AS raster_id, r AS "row", c AS col, round(avg(value) + 1e-9, 6) AS value FROM u JOIN pixels p ON p."row" = ty AND p.col = tx GROUP BY 1, 2, 3""".replace("range(0, 10000000) a(i)", 'range(0, (SELECT max(event_id) // 100 + 1 FROM events)) a(i)')))
def j11_resample(spark, sf):
    p = _pixels(spark, sf)
    return raster.resample(p, 2.0, 2.0, _height(p) // 2, 50).select("raster_id", "row", "col", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query("r7_warp", with_tables("pixels", 'h AS (SELECT max("row") + 1 AS h FROM pixels), g AS (SELECT i AS "row", j AS col FROM h, range(0, (SELECT max(event_id) // 100 + 1 FROM events)) a(i), range(0, 100) b(j)) SELECT CAST(0 AS BIGINT) AS raster_id, a."row", a.col, round(coalesce(b.value, 0), 6) AS value, b.value IS NOT NULL AS valid FROM g a LEFT JOIN pixels b ON b."row" = a."row" + 3 AND b.col = a.col - 5'))
def r7_warp(spark, sf):
    p = _pixels(spark, sf)
    h = p.select("raster_id").distinct().withColumn("h", F.array(*[F.lit(float(x)) for x in (1, 0, 5, 0, 1, -3, 0, 0, 1)]))
    return raster.warp(p, h, _height(p), 100).select("raster_id", "row", "col", F.round("value", 6).alias("value"), "valid")


@query("j15_dem_sampling", with_tables("pixels", """q AS (SELECT "row" * 100 + col AS point_id, col + 0.25::DOUBLE AS x, "row" + 0.5::DOUBLE AS y FROM pixels),
t AS (SELECT point_id, x, unnest([floor(y), floor(y) + 1]) AS ty FROM q), u AS (SELECT point_id, x, CAST(ty AS BIGINT) AS ty, CAST(unnest([floor(x), floor(x) + 1]) AS BIGINT) AS tx FROM t),
s AS (SELECT point_id, sum(CASE WHEN tx = floor(x) THEN 0.75 ELSE 0.25 END * 0.5 * value) AS v, count(value) AS n FROM u LEFT JOIN pixels p ON p."row" = ty AND p.col = tx GROUP BY 1)
SELECT point_id, CASE WHEN n = 4 THEN round(v + 1e-9, 6) END AS value FROM s"""))
def j15_dem_sampling(spark, sf):
    p = _pixels(spark, sf)
    pts = p.select((F.col("row") * 100 + F.col("col")).alias("point_id"), "raster_id", (F.col("col") + 0.25).alias("x"), (F.col("row") + 0.5).alias("y"))
    return raster.sample_bilinear(pts, p).select("point_id", F.round(F.col("value") + 1e-9, 6).alias("value"))


_SSIM = f"""{_B}, j AS (SELECT a."row", a.col, a.value AS x, b.value AS y FROM pixels a JOIN pixels_b b ON a."row" = b."row" AND a.col = b.col),
s AS (SELECT a."row", a.col, avg(b.x) AS mx, avg(b.y) AS my, var_samp(b.x) AS vx, var_samp(b.y) AS vy, covar_samp(b.x, b.y) AS vxy, count(*) AS n FROM j a, range(-3, 4) p(i), range(-3, 4) q(k), j b WHERE b."row" = a."row" + i AND b.col = a.col + k GROUP BY 1, 2),
r AS (SELECT "row", col, (2 * mx * my + 6.5025) * (2 * vxy + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)) AS ssim FROM s WHERE n = 49)"""


@query("r9_ssim", with_tables("pixels", f'{_SSIM} SELECT "row", col, round(ssim, 5) AS ssim FROM r'))
def r9_ssim(spark, sf):
    return raster.ssim(_pixels(spark, sf), _other(spark, sf)).select("row", "col", F.round("ssim", 5).alias("ssim"))


@query("a28_ssim_summary", with_tables("pixels", f"{_SSIM} SELECT round(avg(ssim), 6) AS mean, round(avg(ssim) FILTER (col >= 50), 6) AS valid_mean, round(avg(CAST(col >= 50 AS INTEGER)), 6) AS valid_fraction FROM r"))
def a28_ssim_summary(spark, sf):
    p = _pixels(spark, sf)
    s = raster.ssim_summary(raster.ssim(p, _other(spark, sf)), p.withColumn("valid", F.col("col") >= 50))
    return s.select(F.round("mean", 6).alias("mean"), F.round("valid_mean", 6).alias("valid_mean"), F.round("valid_fraction", 6).alias("valid_fraction"))


@query("r10_summary_grid", with_tables("pixels", f'{_SSIM}, h AS (SELECT greatest(1, CAST(ceil(greatest(100, max("row") + 1) / 20.0) AS BIGINT)) AS f FROM pixels) SELECT "row" // f AS gy, col // f AS gx, round(avg(ssim), 5) AS ssim, avg(CAST(col >= 50 AS INTEGER)) > 0.5 AS valid FROM r, h GROUP BY 1, 2'))
def r10_summary_grid(spark, sf):
    p = _pixels(spark, sf)
    h = p.agg(F.max("row")).first()[0] + 1
    g = raster.summary_grid(raster.ssim(p, _other(spark, sf)), p.withColumn("valid", F.col("col") >= 50), h, 100, 20)
    return g.select(F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("ssim", 5).alias("ssim"), "valid")


@query("r12_band_mean", with_tables("pixels", f'{_B} SELECT "row", col, round(avg(value) + 1e-9, 6) AS value FROM (SELECT * FROM pixels UNION ALL SELECT * FROM pixels_b) GROUP BY 1, 2'))
def r12_band_mean(spark, sf):
    p = _pixels(spark, sf)
    cube = p.withColumn("band", F.lit(0)).unionByName(_other(spark, sf).withColumn("band", F.lit(1)))
    return raster.band_mean(cube).select("row", "col", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query("r13_crop", with_tables("pixels", 'c AS (SELECT * FROM pixels WHERE "row" BETWEEN 0 AND 8 AND col BETWEEN 46 AND 54) SELECT "row", col, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM c'))
def r13_crop(spark, sf):
    return raster.crop_stretch(_pixels(spark, sf), 4, 50, 4).select("row", "col", F.round("value", 6).alias("value"))


@query("r8_regions", with_tables("pixels", f"""RECURSIVE m AS (SELECT "row" * 100 + col AS id, "row" AS r, col AS c FROM pixels WHERE value < 8),
e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
t(id, o) AS (SELECT id, id FROM m UNION SELECT e.v, t.o FROM t JOIN e ON e.u = t.id),
g AS (SELECT o, min(o2) AS k FROM (SELECT id AS o, o AS o2 FROM t) GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS area, CAST(min(r) AS BIGINT) AS row0, CAST(max(r) AS BIGINT) AS row1, CAST(min(c) AS BIGINT) AS col0, CAST(max(c) AS BIGINT) AS col1 FROM m JOIN g ON g.o = m.id GROUP BY k HAVING count(*) >= 3""".replace("RECURSIVE m AS", "m AS")).replace("WITH ", "WITH RECURSIVE ", 1))
def r8_regions(spark, sf):
    m = _pixels(spark, sf).withColumn("shadow", F.col("value") < 8)
    return raster.regions(m, least=3, top=1_000_000).select("area", "row0", "row1", "col0", "col1")


_FLAT = """h AS (SELECT max("row") + 1 AS h FROM pixels), k AS (SELECT greatest(3.0, 0.06 * least(h, 100)) / 4 AS sigma, CAST(ceil(3 * greatest(3.0, 0.06 * least(h, 100)) / 4) AS BIGINT) AS reach, (h + 3) // 4 AS nh FROM h),
low AS (SELECT "row" // 4 AS r, col // 4 AS c, avg(value) AS v FROM pixels GROUP BY 1, 2),
g1 AS (SELECT a.r, a.c, sum(b.v * exp(-pow(b.r - a.r, 2) / (2 * sigma * sigma))) / sum(exp(-pow(b.r - a.r, 2) / (2 * sigma * sigma))) AS v FROM low a, k, low b WHERE b.c = a.c AND b.r BETWEEN a.r - reach AND a.r + reach GROUP BY 1, 2),
g2 AS (SELECT a.r, a.c, sum(b.v * exp(-pow(b.c - a.c, 2) / (2 * sigma * sigma))) / sum(exp(-pow(b.c - a.c, 2) / (2 * sigma * sigma))) AS v FROM g1 a, k, g1 b WHERE b.r = a.r AND b.c BETWEEN a.c - reach AND a.c + reach GROUP BY 1, 2),
q AS (SELECT "row", col, value, greatest(0, least((col + 0.5) / 4 - 0.5, 24)) AS x, greatest(0, least(("row" + 0.5) / 4 - 0.5, nh - 1)) AS y FROM pixels, k),
t AS (SELECT "row", col, value, x, y, CAST(unnest([floor(y), floor(y) + 1]) AS BIGINT) AS ty FROM q), u AS (SELECT *, CAST(unnest([floor(x), floor(x) + 1]) AS BIGINT) AS tx FROM t),
s AS (SELECT "row", col, any_value(value) AS value, sum((1 - abs(ty - y)) * (1 - abs(tx - x)) * g2.v) AS low FROM u JOIN g2 ON g2.r = ty AND g2.c = tx GROUP BY 1, 2)"""


@query("r2_flat_field", with_tables("pixels", f'{_FLAT} SELECT "row", col, round(greatest(0, least(value - low + 128, 255)) + 1e-9, 4) AS value FROM s'))
def r2_flat_field(spark, sf):
    p = _pixels(spark, sf)
    return raster.flat_field(p, _height(p), 100).select("row", "col", F.round(F.col("value") + 1e-9, 4).alias("value"))


_TILES = """h AS (SELECT (max("row") + 1) / 4.0::DOUBLE AS th, 25.0::DOUBLE AS tw FROM pixels),
p AS (SELECT "row", col, CAST(greatest(0, least(floor(value), 255)) AS INTEGER) AS dn, th, tw, least(CAST(floor("row" / th) AS BIGINT), 3) AS ty, least(CAST(floor(col / tw) AS BIGINT), 3) AS tx FROM pixels, h),
n AS (SELECT ty, tx, dn, count(*) AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT ty, tx, sum(n) AS total FROM n GROUP BY 1, 2),
b AS (SELECT t.ty, t.tx, CAST(d AS INTEGER) AS dn, total, greatest(1.0, 2.0 * total / 256) AS lim, coalesce(n.n, 0) AS n FROM t CROSS JOIN range(0, 256) r(d) LEFT JOIN n ON n.ty = t.ty AND n.tx = t.tx AND n.dn = d),
e AS (SELECT ty, tx, sum(greatest(n - lim, 0)) / 256 AS extra FROM b GROUP BY 1, 2),
lut AS (SELECT b.ty, b.tx, dn, sum(least(n, lim) + extra) OVER (PARTITION BY b.ty, b.tx ORDER BY dn ROWS UNBOUNDED PRECEDING) / total * 255 AS o FROM b JOIN e ON e.ty = b.ty AND e.tx = b.tx),
f AS (SELECT "row", col, dn, ("row" + 0.5) / th - 0.5 AS fy, (col + 0.5) / tw - 0.5 AS fx FROM p),
u AS (SELECT "row", col, dn, greatest(0, least(CAST(floor(fy) AS BIGINT) + i, 3)) AS ty, greatest(0, least(CAST(floor(fx) AS BIGINT) + j, 3)) AS tx,
 (CASE WHEN i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM f, range(0, 2) a(i), range(0, 2) c(j))"""


@query("r3_tile_equalise", with_tables("pixels", f'{_TILES} SELECT "row", col, round(sum(w * o) + 1e-9, 4) AS value FROM u JOIN lut ON lut.ty = u.ty AND lut.tx = u.tx AND lut.dn = u.dn GROUP BY 1, 2'))
def r3_tile_equalise(spark, sf):
    p = _pixels(spark, sf)
    return raster.tile_equalise(p, _height(p), 100, 4).select("row", "col", F.round(F.col("value") + 1e-9, 4).alias("value"))


_RIM = f"""g AS (SELECT "row", col, {_GX} AS gx, {_GX.replace("OVER x", "OVER y")} AS gy FROM pixels {_WIN}),
n AS (SELECT image_id * 100000 + det_id AS det_id, cx / 10 AS cx, cy / 10 AS cy, w / 10 + 3 AS r FROM detections),
a AS (SELECT det_id, i, CAST(round_even(cy + r * sin(i * 2 * pi() / 32), 0) AS BIGINT) AS pr, CAST(round_even(cx + r * cos(i * 2 * pi() / 32), 0) AS BIGINT) AS pc FROM n, range(0, 32) t(i)),
s AS (SELECT det_id, CAST(floor((atan2(gy, gx) + pi()) / (2 * pi()) * 8) AS BIGINT) % 8 AS b, sum(sqrt(gx * gx + gy * gy)) AS m FROM a JOIN g ON g."row" = pr AND g.col = pc GROUP BY 1, 2),
t AS (SELECT det_id, sum(m) AS total FROM s GROUP BY 1)"""


@query("j16_rim_texture", with_tables("pixels detections", f"{_RIM} SELECT t.det_id, CAST(k AS INTEGER) AS bin, round(CASE WHEN total > 0 THEN coalesce(m, 0) / total ELSE 0 END, 6) AS share FROM t CROSS JOIN range(0, 8) r(k) LEFT JOIN s ON s.det_id = t.det_id AND s.b = k"))
def j16_rim_texture(spark, sf):
    g = raster.gradients(_pixels(spark, sf)).withColumnRenamed("raster_id", "image_id")
    n = table(spark, sf, "detections").select(F.lit(0).cast("long").alias("image_id"), (F.col("image_id") * 100_000 + F.col("det_id")).alias("det_id"), (F.col("cx") / 10).alias("cx"), (F.col("cy") / 10).alias("cy"), (F.col("w") / 10 + 3).alias("radius_px"))
    return detections.rim_texture(n, g).select("det_id", F.posexplode("texture").alias("bin", "share")).select("det_id", "bin", F.round("share", 6).alias("share"))
