"""Boxes, points, rings and frames over 0/360."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import catalog, footprints

BOX = "product_id long, lon0 double, lon1 double, lat0 double, lat1 double"


def test_boxes_over_the_seam(spark):
    a = spark.createDataFrame([(1, 359.0, 1.0, 0.0, 2.0), (2, 358.0, 362.0, 0.0, 2.0), (3, -2.0, 2.0, 0.0, 2.0), (4, 100.0, 101.0, 0.0, 2.0)], BOX)
    b = spark.createDataFrame([(9, 0.5, 2.0, 0.0, 2.0)], BOX)
    got = {r.product_id_a: round(r.fraction, 9) for r in footprints.box_pairs(a, b, 0.1).collect()}
    assert got == {1: round(0.5 / 1.5, 9), 2: 1.0, 3: 1.0}
    assert footprints.box_pairs(a, a, 0.0).where("product_id_a < product_id_b").count() == 3


def test_points_over_the_seam(spark):
    boxes = spark.createDataFrame([(1, 359.0, 1.0, 0.0, 2.0), (2, 358.0, 362.0, 0.0, 2.0), (3, 0.0, 360.0, 0.0, 2.0), (4, -3.0, 0.0, 0.0, 2.0)], BOX)
    points = spark.createDataFrame([(i, lon, 1.0) for i, lon in enumerate([1.0, 359.5, 0.0, 361.0, 2.5, 180.0, -0.5])], "crater_id long, lon double, lat double")
    got = {}
    for r in catalog.in_boxes(points, boxes).collect():
        got.setdefault(r.product_id, []).append(r.crater_id)
        assert r.lon0 <= r.lon_in <= r.lon0 + 360
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 1, 2, 3, 6], 2: [0, 1, 2, 3, 6], 3: [0, 1, 2, 3, 4, 5, 6], 4: [1, 2, 6]}
    grid = {(r.product_id, r.k): r.n for r in catalog.density(points.withColumn("diameter_km", F.lit(1.0)), boxes.where("product_id = 2"), 4).collect()}
    assert grid == {(2, 1): 2, (2, 2): 1, (2, 3): 2}


def test_random_boxes_against_every_pair(spark):
    rnd = np.random.default_rng(1)
    boxes = [(i, float(lo), float(lo + w), float(y), float(y + 5)) for i, (lo, w, y) in enumerate(zip(rnd.uniform(-360, 720, 80), rnd.uniform(0.5, 170, 80), rnd.uniform(-80, 70, 80), strict=True))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rnd.uniform(0, 360, 300), rnd.uniform(-85, 80, 300), strict=True))]
    df = spark.createDataFrame(boxes, BOX)
    got = sorted((r.product_id, r.crater_id) for r in catalog.in_boxes(spark.createDataFrame(pts, "crater_id long, lon double, lat double"), df).collect())
    assert got == sorted((b[0], p[0]) for b in boxes for p in pts if b[3] <= p[2] <= b[4] and any(b[1] <= p[1] + 360 * k <= b[2] for k in range(-3, 4)))
    pairs = sorted((r.product_id_a, r.product_id_b) for r in footprints.box_pairs(df, df, 0.0).collect())
    want = [(a[0], b[0]) for a in boxes for b in boxes if min(a[4], b[4]) > max(a[3], b[3]) and any(min(a[2], b[2] + 360 * k) > max(a[1], b[1] + 360 * k) for k in range(-4, 5))]
    assert pairs == sorted(want)


def test_rings_and_frames_over_the_seam(spark):
    ring = [{"lat": la, "lon": lo} for la, lo in ((0.0, 359.5), (0.0, 0.5), (1.0, 0.5), (1.0, 359.5))]
    box = spark.createDataFrame([(ring,)], "ring array<struct<lat:double,lon:double>>").select(footprints.ring_box("ring").alias("b")).first().b
    assert (box.lon0, box.lon1) == (359.5, 360.5)
    corners = [{"lat": la, "lon": lo} for la, lo in ((0.0, 359.0), (0.0, 1.0), (2.0, 359.0), (2.0, 1.0))]
    frames = spark.createDataFrame([(7, corners, 201, 201, 300.0, 359.0, 1.0, 0.0, 2.0)], "image_id long, corners array<struct<lat:double,lon:double>>, lines int, samples int, gsd_m double, lon0 double, lon1 double, lat0 double, lat1 double")
    craters = spark.createDataFrame([(1, 359.5, 1.0, 3.0), (2, 0.25, 1.0, 3.0), (3, 5.0, 1.0, 3.0)], "crater_id long, lon double, lat double, diameter_km double")
    got = {r.crater_id: (round(r.cx, 6), round(r.cy, 6)) for r in footprints.place_craters(craters, frames).collect()}
    assert got == {1: (50.0, 100.0), 2: (125.0, 100.0)}
