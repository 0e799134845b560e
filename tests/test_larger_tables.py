"""Work that must not grow faster than the tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import catalog, detections, footprints, matches, telemetry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, ids):
    corner = lambda a, o: F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon"))
    f = spark.createDataFrame([(i,) for i in ids], "pair_id long")
    return f.select("pair_id", F.array(corner(0, 0), corner(0, 6), corner(9, 0), corner(9, 6)).alias("corners"), F.lit(901).alias("lines"), F.lit(601).alias("samples"), F.lit(300.0).alias("gsd_m"))


def test_extents_broadcast_no_frames(spark):
    grid = spark.range(4).select((F.col("id") % 2).alias("pair_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("scan"), F.lit(0).alias("pixel"))
    grid = grid.select("pair_id", (F.col("scan") * 100).alias("scan"), "pixel", F.lit(0.0).alias("lon"), F.col("scan").cast("double").alias("lat"))
    out = footprints.verified_extent(grid, frames(spark, (0, 1)))
    assert "Broadcast" not in plan(out)
    assert sorted((r.pair_id, r.n_verified, r.n_rejected, r.along_km) for r in out.collect()) == [(i, 20, 0, 270.0) for i in (0, 1)]


def test_pairs_of_points_and_boxes_are_found_once_a_place_and_box(spark):
    """Equal places and boxes, one box over 0/360: the rows are those of the plain join, each with its column."""
    craters = spark.createDataFrame([(i, lon, 1.0) for i, lon in enumerate((0.5, 0.5, 359.5, 180.0, 3.0))], "crater_id long, lon double, lat double")
    boxes = spark.createDataFrame([(1, 359.0, 361.0, 0.0, 4.0), (2, 359.0, 361.0, 0.0, 4.0), (3, 0.5, 3.0, 1.0, 2.0)], "product_id long, lon0 double, lon1 double, lat0 double, lat1 double")
    got = catalog.each_in_boxes(craters, boxes, part=(F.col("lat") - F.col("lat0")) / (F.col("lat1") - F.col("lat0")))
    key = lambda r: (r.product_id, r.crater_id, r.lon_in)
    assert sorted(map(key, got.collect())) == sorted(map(key, catalog.in_boxes(craters, boxes).collect())) == [(1, 0, 360.5), (1, 1, 360.5), (1, 2, 359.5), (2, 0, 360.5), (2, 1, 360.5), (2, 2, 359.5), (3, 0, 0.5), (3, 1, 0.5), (3, 4, 3.0)]
    assert {(r.product_id, r.part) for r in got.collect()} == {(1, 0.25), (2, 0.25), (3, 0.0)}
    assert [(r.product_id, r.crater_id) for r in catalog.each_in_boxes(craters, boxes, boundary="interior").collect() if r.product_id == 3] == []


def test_equal_times_ask_once_and_each_row_has_its_own_file(spark):
    """One id at two times: the file goes with the time."""
    stamp = lambda c: F.col(c).cast("timestamp")
    c = spark.createDataFrame([("b", "2020-01-01", "2020-01-02"), ("a", "2020-01-01", "2020-01-02"), ("0", "2020-02-01", "2020-02-02")], "file string, start string, stop string")
    t = spark.createDataFrame([(1, "2020-01-02"), (1, "2020-02-01"), (2, "2020-01-02"), (3, "2021-01-01")], "time_id long, ts string").withColumn("ts", stamp("ts"))
    out = telemetry.covering_file(t, c.withColumn("start", stamp("start")).withColumn("stop", stamp("stop")))
    assert sorted((r.time_id, str(r.ts.date()), r.file) for r in out.collect()) == [(1, "2020-01-02", "a"), (1, "2020-02-01", "0"), (2, "2020-01-02", "a"), (3, "2021-01-01", None)]


def test_nearest_of_whole_images_and_of_cells_are_the_same(spark):
    """Small integer places, so that distances tie and places repeat; strips of more than one width."""
    rng = np.random.default_rng(3)
    rows = [(m, i, float(x), float(y), float(1 + i % 3), 100, 80) for m, n in ((0, 1), (1, 5), (2, 900)) for i, (x, y) in enumerate(rng.integers(0, 60 if n < 9 else 40, (n, 2)).tolist())]
    nodes = spark.createDataFrame(rows, "image_id long, det_id long, cx double, cy double, radius_px double, width int, height int")
    want = []
    for m in (1, 2):
        own = [r for r in rows if r[0] == m]
        for a in own:
            near = sorted((math.sqrt((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2), b[1]) for b in own if b is not a)[:6]
            want += [(m, a[1], b, k + 1, round(d / math.hypot(100, 80), 9)) for k, (d, b) in enumerate(near)]
    for whole in (20_000, 10):
        got = detections.neighbour_edges(nodes, whole=whole).collect()
        assert sorted((r.image_id, r.det_id_a, r.det_id_b, r.rank, round(r.dist_norm, 9)) for r in got) == sorted(want)
    assert "FlatMapGroupsInArrow" in plan(detections.neighbour_edges(nodes))


def test_turns_of_pairs_come_as_moments_of_block_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(m, i, *map(float, rng.integers(0, 9, 4))) for m, n in ((1, 40), (2, 2)) for i in range(1, n + 1)]
    points = spark.createDataFrame(rows, "run_id long, match_idx long, src_x double, src_y double, ref_x double, ref_y double")
    turns = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                s, r = (b[2] - a[2], b[3] - a[3]), (b[4] - a[4], b[5] - a[5])
                if any(s) and any(r):
                    turns.setdefault(a[0], []).append((math.degrees(math.atan2(r[1], r[0]) - math.atan2(s[1], s[0])) + 180 + 1e-9) % 360 - 180)
    out = matches.rotation_consistency(points, block=7)
    assert "FlatMapGroupsInArrow" in plan(out)
    got = {r.run_id: r for r in out.collect()}
    assert {m: (len(d), round(float(np.std(d)), 5)) for m, d in turns.items()} == {m: (r.n_pairs, round(r.rotation_std, 5)) for m, r in got.items()}


def test_equal_rings_are_sampled_once(spark):
    gradients = spark.range(400).select(F.lit(0).alias("image_id"), (F.col("id") % 20).alias("row"), F.expr("id div 20").alias("col"), (F.col("id") % 7 - 3.0).alias("gx"), (F.col("id") % 5 - 2.0).alias("gy"))
    rows = [(0, 1, 10.0, 10.0, 4.0), (0, 2, 10.0, 10.0, 4.0), (0, 3, 10.0, 10.0, 5.0), (0, 4, 90.0, 90.0, 5.0), (1, 5, 10.0, 10.0, 4.0)]
    nodes = spark.createDataFrame(rows, "image_id int, det_id long, cx double, cy double, radius_px double")
    out = detections.rim_texture(nodes, gradients)
    circles = [f for f in out.inputFiles() if "table-" in f]
    assert spark.read.parquet(circles[0].rpartition("/")[0]).count() == 4
    got = {r.det_id: r.texture for r in out.collect()}
    alone = {d: r.texture for d in (1, 3) for r in detections.rim_texture(nodes.where(F.col("det_id") == d), gradients).collect()}
    assert sorted(got) == [1, 2, 3] and got[1] == got[2]
    assert all(abs(a - b) < 1e-12 for d in (1, 3) for a, b in zip(got[d], alone[d])) and got[3] != got[1]


def test_equal_places_and_times_ask_once(spark):
    """Ties between features of one place and records of one time go to the smaller id, and every point and acquisition has its row."""
    points = spark.createDataFrame([(i, lon, 1.0) for i, lon in enumerate((0.5, 0.5, 90.0))], "point_id long, lon double, lat double")
    features = spark.createDataFrame([(8, "h", 359.5, 1.0), (7, "z", 359.5, 1.0), (9, "a", 3.0, 1.0)], "feature_id long, name string, lon double, lat double")
    near = catalog.nearest_feature(points, features)
    assert sorted((r.point_id, r.feature_id, r.name, r.available) for r in near.collect()) == [(0, 7, "z", True), (1, 7, "z", True), (2, None, None, False)]
    stamp = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    acq = stamp(spark.createDataFrame([(1, "2020-01-01 00:00:30"), (2, "2020-01-01 00:00:30"), (3, "2021-01-01 00:00:00"), (4, None)], "acq_id long, ts string"))
    rec = stamp(spark.createDataFrame([(6, "2020-01-01 00:00:31", "x"), (5, "2020-01-01 00:00:31", "y"), (4, "2020-01-01 00:01:00", "z")], "record_num long, ts string, pos string"))
    at = telemetry.nearest_record(acq, rec)
    assert sorted((r.acq_id, r.record_num, r.gap_s, r.rec and r.rec.pos) for r in at.collect()) == [(1, 5, 1.0, "y"), (2, 5, 1.0, "y"), (3, None, None, None), (4, None, None, None)]
    keys = lambda df, key: [line for line in plan(df).splitlines() if "SortMergeJoin" in line and "LeftOuter" in line and f"{key}#" in line]
    assert keys(near, "px") and keys(at, "us")  # results come to points and acquisitions by their place and time
