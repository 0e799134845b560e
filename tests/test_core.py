"""Hand-made cases: boundaries, seams, NaN, ties."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import geo, scoring, text, transforms
from tessella.operators import catalog, detections, fitting, footprints, history, matches, raster, sweep, telemetry
from tessella.operators.graph import connected_components


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in points])


def square(lat, lon, size, closed=False):
    p = [(lat, lon), (lat, lon + size), (lat + size, lon + size), (lat + size, lon)]
    return ring(*(p + p[:1] if closed else p))


def overlap(spark, a, b):
    return footprints.polygon_overlap(spark.range(1).select(a.alias("ring_a"), b.alias("ring_b"))).first()


def test_polygon_overlap(spark):
    assert overlap(spark, square(0, 359, 2), square(0, 0.5, 1)).overlaps  # over 0/360
    assert overlap(spark, square(0, 0, 1), square(0, 1, 1)).overlaps  # shared edge
    assert overlap(spark, square(0, 0, 10), square(4, 4, 1)).overlaps  # inside
    assert overlap(spark, square(0, 0, 1, True), square(0, 0.5, 1)).overlaps
    apart = overlap(spark, square(0, 0, 1), square(0, 3, 1))
    assert not apart.overlaps and 2 * geo.KM_PER_DEG * 0.99 < apart.separation_km <= 2 * geo.KM_PER_DEG + 1e-6
    assert "fewer than 3" in overlap(spark, ring((0, 0), (1, 1)), square(0, 0, 1)).reason


def test_touching_boxes_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 0.0, 1.0), (3, 0.5, 1.5, 0.0, 1.0)], "product_id long, lon0 double, lon1 double, lat0 double, lat1 double")
    got = {(r.product_id_a, r.product_id_b) for r in footprints.box_pairs(df, df, 0.1).where("product_id_a < product_id_b").collect()}
    assert got == {(1, 3), (2, 3)}


def test_ring_measures(spark):
    r = one(spark, a=geo.ring_area_km2(square(0, 359.5, 1)), b=geo.ring_area_km2(square(0, 359.5, 1, True)), c=geo.ring_centroid(square(0, 359, 2, True)))
    assert r.a == pytest.approx(r.b) and r.a == pytest.approx(geo.KM_PER_DEG**2, rel=1e-3)
    assert r.c.lat == pytest.approx(1) and math.cos(math.radians(r.c.lon)) == pytest.approx(1)


def test_cell_boundaries(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 0.5), (3, 0.5, 0.5)], "crater_id long, lon double, lat double")
    b = spark.createDataFrame([(9, 0.0, 1.0, 0.0, 1.0), (8, 5.0, 6.0, 0.0, 1.0)], "product_id long, lon0 double, lon1 double, lat0 double, lat1 double")
    ids = lambda kind: sorted(r.crater_id for r in catalog.in_boxes(p, b, boundary=kind).collect())
    assert ids("closed") == [1, 2, 3] and ids("half_open") == [2, 3] and ids("interior") == [3]
    assert catalog.in_boxes(p, b, how="left").where("crater_id is null").count() == 1
    with pytest.raises(ValueError):
        catalog.bbox(p, 2, 1, 0, 1)


def test_anomaly_baseline(spark):
    rows = [(1, "s", 1.0), (2, "s", 1.0), (3, "s", float("nan")), (4, "s", 1.1), (5, "s", 9.0), (6, "c", 2.0), (7, "c", 2.0), (8, "c", 50.0)]
    got = {r.id: r for r in history.flag_anomalies(spark.createDataFrame(rows, "id long, sensor_type string, rmse double")).collect()}
    assert [i for i, r in got.items() if r.anomalous] == [5] and got[1].baseline_mean is None and got[2].baseline_mean is None
    assert got[4].baseline_std == 0 and not got[8].anomalous


def test_pattern_is_wild_and_ignores_case(spark):
    runs = spark.createDataFrame([(1, "t", "a/SELF-pair/b", 0.5), (2, "t", "a/other", 0.1)], "id long, sensor_type string, src_path string, inlier_ratio double")
    assert history.same_sensor_baseline(runs).first().n == 1


def test_uniformity(spark):
    even = [(1, i, 100.0 + 200 * (i % 6), 100.0 + 200 * (i // 6)) for i in range(36)]
    single = [(2, i, 10.0, 10.0) for i in range(36)]
    df = spark.createDataFrame(even + single, "run_id long, match_idx long, ref_x double, ref_y double")
    got = {r.run_id: r.uniformity for r in matches.uniformity(df, 1200, 1200).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(math.sqrt(35))
    assert matches.spatial_cap(df, 1200, 1200).where("run_id = 2").agg(F.max("match_idx")).first()[0] == 11


def test_rotation_consistency_wraps(spark):
    pts = [(0, 0.0, 0.0)] + [(i, 10.0 * i, 0.0) for i in range(1, 4)]
    rows = [(1, i, x, y, x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for i, x, y in pts for a in [math.radians(175)]]
    r = matches.rotation_consistency(spark.createDataFrame(rows, "run_id long, match_idx long, src_x double, src_y double, ref_x double, ref_y double"), block=2).first()
    assert r.rotation_std == pytest.approx(0, abs=1e-6) and r.n_pairs == 6


def test_transforms(spark):
    h = F.array(*[F.lit(float(x)) for x in (10, 0, 3, 0, 1, 4, 0, 0, 1)])
    r = one(spark, c=transforms.condition_ratio(h), none=transforms.condition_ratio(F.lit(None).cast("array<double>")), i=transforms.is_identity(transforms.multiply(h, transforms.inverse(h))), s=transforms.scale_disagreement(F.lit(2.0), F.lit(0.0)))
    assert r.c == pytest.approx(10) and math.isinf(r.none) and r.i and math.isinf(r.s)
    v = one(spark, h=transforms.variant_transform(F.lit(1.0), F.lit(90.0), F.lit(40.0), F.lit(60.0)), e=transforms.variant_transform(F.lit(1.0), F.lit(0.0), F.lit(40.0), F.lit(60.0)))
    assert v.h[2] == pytest.approx(0, abs=1e-9) and v.h[5] == pytest.approx(60) and v.e == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_verdict(spark):
    nan = F.lit(float("nan"))
    r = one(spark, v=scoring.verdict(F.lit(30), F.lit(19), F.lit(0.4), F.lit(None), nan), ok=scoring.verdict(F.lit(40), F.lit(30), F.lit(0.75), F.lit(1.0), F.lit(3.0)))
    assert [x.split()[0] for x in r.v.reasons] == ["only", "inlier", "no", "rotation-consistency"] and not r.v.validated and r.ok.validated
    s = one(spark, n=scoring.next_steps(F.lit(False), F.array(F.lit("inlier ratio low"))), d=scoring.next_steps(F.lit(False), F.array(F.lit("odd"))), z=scoring.lower_is_better(F.lit(0.0), 3.0))
    assert len(s.n) == 1 and s.d == [scoring.DEFAULT_STEP] and s.z == 999


def test_text(spark):
    r = one(spark, s=text.sensor_of(F.lit("/nac/x_TMC_nac.img")), t=text.parse_time(F.lit("2024-01-02T03:04:05Z")), bad=text.parse_time(F.lit("soon")), n=text.leading_number(F.lit("12.5 km")), w=text.wkt_point(F.lit("POINT (3 -4)")), d=text.sample_dtype(F.lit("MSB_INTEGER"), F.lit(8)))
    assert r.s == "tmc" and r.t.hour == 3 and r.bad is None and r.n == 12.5 and (r.w.lon, r.w.lat) == (3, -4) and r.d.dtype == "<u1" and r.d.warning


def test_inverse_bilinear_outside(spark):
    c = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in ((0, 0), (0, 4), (2, 0.5), (2, 5))])
    r = one(spark, i=geo.inverse_bilinear(c, F.lit(2.125), F.lit(1.0), F.lit(101), F.lit(101)), o=geo.inverse_bilinear(c, F.lit(9.0), F.lit(1.0), F.lit(101), F.lit(101)))
    assert r.i.residual < 1e-12 and r.i.line == pytest.approx(50) and r.o.residual > 1


def test_verified_extent_and_gate(spark):
    corners = square(0, 0, 1)
    corners = F.array(corners[0], corners[1], corners[3], corners[2])
    frames = spark.range(1).select(F.lit(1).alias("pair_id"), corners.alias("corners"), F.lit(100).alias("lines"), F.lit(100).alias("samples"), F.lit(1000.0).alias("gsd_m"))
    grid = spark.range(400).select(F.lit(1).alias("pair_id"), (F.col("id") / 20).cast("int").alias("scan"), (F.col("id") % 20).cast("int").alias("pixel"), (F.col("id") % 20 / 15).alias("lon"), ((F.col("id") / 20).cast("int") / 15).alias("lat"))
    r = footprints.verified_extent(grid, frames).first()
    assert r.ok and r.n_verified == 256 and r.n_rejected == 144 and (r.bounds.s0, r.bounds.s1) == (0, 15) and not r.extent_mismatch
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair_id long")
    go, stop = footprints.overlap_gate(pairs, spark.createDataFrame([(1, False, "far"), (2, True, "")], "pair_id long, overlaps boolean, reason string"))
    assert sorted(x.pair_id for x in go.collect()) == [2, 3] and stop.first().reason == "far"


def test_grid_locate_and_corners(spark):
    g = spark.range(100).select(F.lit(1).alias("product_id"), (F.col("id") / 10).cast("int").alias("scan"), (F.col("id") % 10).cast("int").alias("pixel"), (10 + F.col("id") % 10 * 0.01).alias("lon"), (5 + (F.col("id") / 10).cast("int") * 0.01).alias("lat"))
    p = spark.createDataFrame([(1, 7, 10.025, 5.035), (1, 8, 50.0, 5.0)], "product_id long, point_id long, lon double, lat double")
    got = {r.point_id: r for r in footprints.locate_on_grid(p, g).collect()}
    assert got[7].scan == pytest.approx(3.5) and got[7].pixel == pytest.approx(2.5) and got[8].scan is None
    assert footprints.grid_corners(g).first().corners[3].lat == pytest.approx(5.09)


def test_as_of(spark):
    a = spark.createDataFrame([(1, 100), (2, 1000)], "acq_id long, s long").select("acq_id", F.timestamp_seconds("s").alias("ts"))
    t = spark.createDataFrame([(5, 159), (6, 41), (7, 161)], "record_num long, s long").select("record_num", F.timestamp_seconds("s").alias("ts"))
    got = {r.acq_id: r.record_num for r in telemetry.nearest_record(a, t).collect()}
    assert got == {1: 5, 2: None}  # a tie of 59 seconds goes to the smaller record


def grid(spark, rows):
    return spark.createDataFrame([(0, i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "raster_id long, row long, col long, value double")


def test_horizon(spark):
    d = grid(spark, [[0, 10] + [0] * 12])
    assert sorted(r.col for r in raster.horizon_shadow(d, -45.0).where("shadow").collect()) == list(range(2, 14))
    g = raster.horizon_shadow(d, 45.0)
    assert sorted(r.col for r in g.where("shadow").collect()) == list(range(2, 11))


def test_regions_and_ssim(spark):
    m = grid(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 0]]).withColumn("shadow", F.col("value") > 0)
    assert [r.area for r in raster.regions(m, least=1).collect()] == [2]
    g = grid(spark, [[(i * 7 + j * 13) % 50 for j in range(9)] for i in range(9)])
    s = raster.ssim(g, g).collect()
    assert len(s) == 9 and all(r.ssim == pytest.approx(1) for r in s)
    eye = spark.range(1).select(F.lit(0).cast("long").alias("raster_id"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("h"))
    w = {(r.row, r.col): r.value for r in raster.warp(g, eye, 9, 9).collect()}
    assert w == {(r.row, r.col): r.value for r in g.collect()}
    total = {(r.row, r.col): r.sat for r in raster.integral(g, block=4).collect()}
    v = {(r.row, r.col): r.value for r in g.collect()}
    assert total[(8, 8)] == sum(v.values()) and total[(3, 5)] == sum(x for (a, b), x in v.items() if a <= 3 and b <= 5)


def test_light_modes(spark):
    g = grid(spark, [[(i + j) % 200 for j in range(32)] for i in range(32)])
    for mode in ("none", "gradient", "clahe", "both"):
        out = raster.normalise_light(g, mode, 32, 32)
        assert out.count() == 1024 and out.where("value < 0 or value > 255.5 or value is null").count() == 0
    with pytest.raises(ValueError):
        raster.normalise_light(g, "x", 32, 32)


def test_suppression_and_clusters(spark):
    d = spark.createDataFrame([(1, 1, 10.0, 10.0, 10.0, 10.0, 0.5), (1, 2, 12.0, 10.0, 10.0, 10.0, 0.9), (1, 3, 14.0, 10.0, 10.0, 10.0, 0.4), (1, 4, 90.0, 90.0, 4.0, 4.0, 0.1)], "image_id long, det_id long, cx double, cy double, w double, h double, confidence double")
    assert sorted(r.det_id for r in detections.suppress(d, 0.45).collect()) == [2, 4]
    assert sorted(r.det_id for r in detections.cluster_best(d, 0.6).collect()) == [2, 4]  # 1-2 and 2-3 overlap


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)] + [(200, 201 + i) for i in range(30)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100 and {got[201 + i] for i in range(30)} == {200} and 7 in got


def test_fits(spark):
    h = [1.1, 0.05, 4.0, -0.05, 1.2, -7.0]
    pts = [(1, i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(60)]
    rows = [(r, i, x, y, h[0] * x + h[1] * y + h[2] + (200 if i % 5 == 0 else 0), h[3] * x + h[4] * y + h[5]) for r, i, x, y in pts] + [(2, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, match_idx long, src_x double, src_y double, ref_x double, ref_y double")
    got = {r.run_id: r for r in fitting.fit_robust(df).collect()}
    assert got[1].inliers == 48 and got[1].h[0] == pytest.approx(1.1, abs=1e-3) and got[2].h is None
    clean = {r.run_id: r.h for r in fitting.fit_affine(df.where("match_idx % 5 <> 0 or run_id = 2")).collect()}
    assert clean[1] == pytest.approx([*h, 0, 0, 1], abs=1e-6) and clean[2] is None


def test_refinement(spark):
    import numpy as np

    y, x = np.mgrid[0:48, 0:48]
    a = np.exp(-((y - 24) ** 2 + (x - 24) ** 2) / 40.0)
    b = np.exp(-((y - 23) ** 2 + (x - 25.5) ** 2) / 40.0)
    rows = [(1, 1, 48, a.ravel().tolist(), b.ravel().tolist()), (1, 2, 48, [0.0] * 2304, a.ravel().tolist()), (1, 3, 48, [1.0], None)]
    out = fitting.refine_points(spark.createDataFrame(rows, "run_id long, match_idx long, size int, src_patch array<double>, ref_patch array<double>"))
    got = {r.match_idx: r for r in out.collect()}
    assert got[1].outcome == "refined" and got[1].dy == pytest.approx(1, abs=0.1) and got[1].dx == pytest.approx(-1.5, abs=0.1)
    assert got[2].outcome == "flat" and got[3].outcome == "outside" and fitting.outcome_counts(out).first().flat == 1
    px = grid(spark, [[i * 10 + j for j in range(10)] for i in range(10)])
    pt = spark.createDataFrame([(1, 1, 0, 5.2, 5.7)], "run_id long, match_idx long, raster_id long, x double, y double")
    assert fitting.patches_at(pt, px, "x", "y", "p", 4).first().p[:4] == [33, 34, 35, 36]


def test_sweep(spark):
    s = spark.createDataFrame([(1, True), (2, False)], "source_id long, has_sun boolean")
    n = lambda live: {r.source_id: r["count"] for r in sweep.plan(s, live).groupBy("source_id").count().collect()}
    assert n(False) == {1: 36, 2: 10} and n(True) == {1: 18, 2: 10}
    assert one(spark, e=sweep.F.greatest(F.lit(2.0), F.lit(10.0) - 45)).e == 2


def test_feature_cache(spark):
    f = spark.createDataFrame([("a",), ("b",)], "file_hash string")
    first = history.compute_missing(f, spark.createDataFrame([], "key string, v int"), lambda d: d.select("key", F.lit(1).alias("v")), "p=1")
    again = history.compute_missing(f, first, lambda d: d.select("key", F.lit(2).alias("v")), "p=1")
    assert [r.v for r in again.collect()] == [1, 1] and len({r.key for r in first.collect()}) == 2


def test_products_beyond_the_broadcast(spark):
    products = spark.range(10_050).select(F.format_string("p%05dx", "id").alias("product_id"), (-F.col("id")).alias("ord"))
    rows = [(1, "/data/p10049x/p00001x.img"), (2, "/data/p00002x_p00003x.img"), (3, "/data/none.img"), (4, None), (5, "p10000x")]
    runs = spark.createDataFrame(rows, "id long, src_path string")
    want = {1: "p10049x", 2: "p00003x", 3: None, 4: None, 5: "p10000x"}
    assert {r.id: r.product_id for r in history.enrich_with_products(runs, products).collect()} == want
    few = products.where("ord in (-1, -2, -3, -10000, -10049)").unionByName(spark.createDataFrame([("data", 7), ("", 9), (None, -99999)], "product_id string, ord long"))
    want |= {3: "data"}
    assert {r.id: r.product_id for r in history.enrich_with_products(runs, few).collect()} == want
    assert {r.id: r.product_id for r in history.enrich_with_products(runs, few, 2).collect()} == want
