"""Descriptor matching in cells of a grid and shadows along skewed lines, against direct work."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import matches, raster


def nearest(x, y, binary):
    d = np.array([[sum((int(p) ^ int(q)).bit_count() for p, q in zip(a, b, strict=True)) if binary else math.sqrt(((a - b) ** 2).sum()) for b in y] for a in x])
    return d


@pytest.mark.parametrize("binary", [False, True])
def test_a_hot_block_over_many_cells(spark, binary):
    rnd = np.random.default_rng(1)
    n, m = 90, 70
    x, y = (rnd.integers(0, 1 << 20, (k, 2)) if binary else rnd.normal(1000, 1, (k, 6)) for k in (n, m))
    y[5], y[6], x[3] = y[4], y[4], y[4]  # ties, and a distance of 0
    block = lambda i: 0 if i % 3 else 1 + i % 2
    kind = "array<bigint>" if binary else "array<double>"
    frame = lambda v: spark.createDataFrame([(i, block(i), r.tolist()) for i, r in enumerate(v)] + [(500, None, v[0].tolist()), (501, 0, None), (502, 9, v[0].tolist())], f"kp_id long, block int, descriptor {kind}")
    two = matches.two_nearest(frame(x), frame(y), distance=matches.hamming if binary else matches.l2, back=True, rows=16)
    got = {(r.way, r.q, r.r): (r.t, round(r.dist, 9)) for r in two.where("block < 9").collect()}
    d, want = nearest(x, y, binary), {}
    for way, far, rows, cols in ((0, d, n, m), (1, d.T, m, n)):
        for i in range(rows):
            near = sorted((round(far[i, j], 9), j) for j in range(cols) if block(j) == block(i))[:2]
            for r, (dist, j) in enumerate(near):
                want[(way, i, r + 1)] = (j, dist)
    assert got == want
    cells = two.where("block < 9").count()
    assert cells == len(want)


def test_matches_pass_the_ratio_both_ways(spark):
    a = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [10.0, 0.0]), (3, 1, [0.0, 0.0])], "kp_id long, block int, descriptor array<double>")
    b = spark.createDataFrame([(7, 0, [0.1, 0.0]), (8, 0, [10.1, 0.0]), (9, 0, [10.2, 0.0]), (6, 1, [0.0, 0.0])], "kp_id long, block int, descriptor array<double>")
    assert [(r.q, r.t) for r in matches.ratio_matches(a, b).orderBy("q").collect()] == [(1, 7), (2, 8)]
    assert [(r.q, r.t) for r in matches.mutual_matches(a, b).orderBy("q").collect()] == [(1, 7), (2, 8)]
    assert matches.ratio_matches(a.where("kp_id > 9"), b).count() == 0


@pytest.mark.parametrize("azimuth", [0, 45, 100, 180, 200.5, 270, 333])
def test_shadows_of_any_sun(spark, azimuth):
    rnd = np.random.default_rng(3)
    h = rnd.uniform(0, 12, (19, 26))
    ux, uy, slope = -math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth)), math.tan(math.radians(30))
    df = spark.createDataFrame([(0, i, j, float(h[i, j])) for i in range(19) for j in range(26)], "raster_id long, row long, col long, value double")
    got = {(r.row, r.col): r.shadow for r in raster.cast_shadow(df, 30, azimuth, block=5).collect()}
    assert len(got) == 19 * 26
    for i in range(19):
        for j in range(26):
            # back towards the sun, a step of the faster axis at a time, on the pixel's own line
            fast, slow, u, v = (j, i, ux, uy) if abs(ux) >= abs(uy) else (i, j, uy, ux)
            line, dark = math.floor(slow - fast * round(v, 15) / round(u, 15) + 0.5), False
            at = fast - (1 if u > 0 else -1)
            while 0 <= at < (26 if abs(ux) >= abs(uy) else 19):
                for side in range(19 if abs(ux) >= abs(uy) else 26):
                    if math.floor(side - at * round(v, 15) / round(u, 15) + 0.5) == line:
                        r, c = (side, at) if abs(ux) >= abs(uy) else (at, side)
                        way = (j - c) * ux + (i - r) * uy
                        dark |= h[r, c] - h[i, j] > way * slope + 1e-6
                at -= 1 if u > 0 else -1
            assert got[i, j] == dark, (i, j)


def test_a_row_of_a_million_pixels(spark):
    df = spark.range(1_000_000).select(F.lit(0).cast("long").alias("raster_id"), F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("value"))
    out = raster.cast_shadow(df, 45, 270)
    g = np.array([r.value for r in df.orderBy("col").select("value").collect()]) + np.arange(1_000_000)
    want = int((g[1:] < np.maximum.accumulate(g)[:-1] - 1e-6).sum())
    assert out.where("shadow").count() == want
