"""Array tiles against whole arrays in numpy, on tiles much smaller than the raster."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tessella.operators import fitting, raster, tiles


def pixels(spark, a, raster_id=0, row0=0, col0=0):
    r, c = np.nonzero(~np.isnan(a))
    return spark.createDataFrame([(raster_id, int(i) + row0, int(j) + col0, float(a[i, j])) for i, j in zip(r, c, strict=True)], "raster_id long, row long, col long, value double")


def grid(df, shape, name, row0=0, col0=0):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row - row0, r.col - col0] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def holed():
    rnd = np.random.default_rng(1)
    a = rnd.uniform(0, 200, (23, 31))
    a[4:7, 10:20] = np.nan
    a[rnd.random(a.shape) < 0.05] = np.nan
    return a


def test_round_trip_with_negative_places(spark, holed):
    back = tiles.to_pixels(tiles.to_tiles(pixels(spark, holed, 3, -9, -4), 8))
    assert np.array_equal(grid(back, holed.shape, "value", -9, -4), holed, equal_nan=True)
    assert tiles.to_tiles(pixels(spark, holed).where("row < 0"), 8).count() == 0


@pytest.mark.parametrize("wrap", [False, True])
def test_window_stats_over_borders(spark, holed, wrap):
    h, w = holed.shape
    for reach in (2, 9):  # 9 is more than a tile
        made = tiles.to_pixels(tiles.neighbourhood(tiles.to_tiles(pixels(spark, holed), 8), reach, tiles.window_stats(reach), ["mean", "variance"], 8, w if wrap else None), "mean", "variance").collect()
        assert len(made) == int((~np.isnan(holed)).sum())
        for r in made:
            rows = np.arange(max(0, r.row - reach), min(h, r.row + reach + 1))
            cols = np.arange(r.col - reach, r.col + reach + 1)
            cols = cols % w if wrap else cols[(cols >= 0) & (cols < w)]
            v = holed[np.ix_(rows, cols)].ravel()
            v = v[~np.isnan(v)]
            assert abs(r.mean - v.mean()) < 1e-9 and abs(r.variance - v.var()) < 1e-9 * max(1, v.var())


def test_variances_keep_their_digits(spark):
    rnd = np.random.default_rng(2)
    a = 30_000 + rnd.uniform(0, 0.1, (60, 50))
    a[:, 40:] = 1e9  # a far level elsewhere in the tile
    got = grid(raster.local_stats(pixels(spark, a), 2, 50, wrap=False), a.shape, "variance")
    for i in range(2, 58):
        for j in range(2, 37):
            v = a[i - 2 : i + 3, j - 2 : j + 3]
            true = ((v - v.mean()) ** 2).mean()
            assert abs(got[i, j] - true) < 1e-6 * true


def test_gradients_and_similarity_over_borders(spark, holed):
    g = tiles.to_pixels(tiles.neighbourhood(tiles.to_tiles(pixels(spark, holed), 8), 1, tiles.gradients, ["values", "gx", "gy"], 8), "values", "gx", "gy").collect()
    p = np.pad(holed, 1, constant_values=np.nan)
    for r in g:
        for name, (lo, hi) in {"gx": (p[r.row + 1, r.col], p[r.row + 1, r.col + 2]), "gy": (p[r.row, r.col + 1], p[r.row + 2, r.col + 1])}.items():
            v = holed[r.row, r.col]
            want = 0.0 if np.isnan(lo) and np.isnan(hi) else hi - v if np.isnan(lo) else v - lo if np.isnan(hi) else (hi - lo) / 2
            assert abs(r[name] - want) < 1e-9
    other = holed + np.random.default_rng(3).normal(0, 20, holed.shape)
    made = tiles.neighbourhood(tiles.to_tiles(pixels(spark, holed), 8), 3, tiles.ssim(), ["ssim", "dissimilarity"], 8, other=tiles.to_tiles(pixels(spark, other), 8))
    got = grid(tiles.to_pixels(made, "ssim"), holed.shape, "ssim")
    for i in range(23):
        for j in range(31):
            x, y = (v[max(0, i - 3) : i + 4, max(0, j - 3) : j + 4].ravel() for v in (holed, other))
            if len(x) < 49 or np.isnan(x).any():
                assert np.isnan(got[i, j])
            else:
                c = np.cov(x, y)
                want = (2 * x.mean() * y.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225))
                assert abs(got[i, j] - want) < 1e-9


@pytest.mark.parametrize("h", [[1, 0, 5, 0, 1, -3, 0, 0, 1], [0.4, 0.1, 2, -0.05, 0.5, 3, 0.001, -0.002, 1], [3, 0.2, -10, 0.1, 2.5, -6, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0.2, 0, -2]])
def test_warp_over_tiles(spark, holed, h):
    inv = np.linalg.inv(np.array(h, float).reshape(3, 3))
    to = spark.createDataFrame([(0, inv.ravel().tolist()), (1, inv.ravel().tolist())], "raster_id long, inv array<double>")
    made = tiles.warp(tiles.to_tiles(pixels(spark, holed), 8), to, 20, 27, 8)
    got = grid(tiles.to_pixels(made).where("raster_id = 0"), (20, 27), "value")
    assert made.where("raster_id = 1").count() == 12 and tiles.to_pixels(made).where("raster_id = 1").count() == 0
    padded = np.pad(holed, 1, constant_values=np.nan)
    seen = 0
    for r in range(20):
        for c in range(27):
            z = inv[2] @ (c, r, 1)
            if abs(z) < 1e-12:
                assert np.isnan(got[r, c])
                continue
            x, y = inv[0] @ (c, r, 1) / z, inv[1] @ (c, r, 1) / z
            fx, fy, want = int(np.floor(x)), int(np.floor(y)), 0.0
            for p in (0, 1):
                for q in (0, 1):
                    weight = (y - fy if p else 1 - y + fy) * (x - fx if q else 1 - x + fx)
                    if weight > 0:
                        inside = 0 <= fy + p < 23 and 0 <= fx + q < 31
                        want += weight * (padded[fy + p + 1, fx + q + 1] if inside else np.nan)
            assert np.isnan(want) == np.isnan(got[r, c]) and (np.isnan(want) or abs(want - got[r, c]) < 1e-6), (r, c, x, y)
            seen += not np.isnan(want)
    assert seen > 20


def test_patches_over_borders(spark):
    a = np.arange(40 * 40, dtype=float).reshape(40, 40)
    pts = spark.createDataFrame([(0, i, 0, float(x), float(y)) for i, (x, y) in enumerate([(7.9, 8.0), (16, 15.5), (0, 0), (39.2, 20), (100, 100)])], "run_id long, match_idx long, raster_id long, x double, y double")
    seen = tiles.at_points(pts, [tiles.to_tiles(pixels(spark, a), 8)], 3, lambda p: {"s": float(np.nansum(p))}, {"s": "double"}, ["run_id", "match_idx"], 8)
    got = {r.match_idx: r.s for r in seen.collect()}
    box = lambda x, y: a[max(0, y - 3) : max(0, y + 3), max(0, x - 3) : max(0, x + 3)].sum()
    assert got == {0: box(7, 8), 1: box(16, 15), 2: box(0, 0), 3: box(39, 20), 4: 0.0}
    assert fitting.shift_of(a[:8, :8], np.full((8, 8), np.nan), 4)[2] == "outside"


def test_scratch_folder_without_settings(tmp_path):
    """A session whose settings name no folder makes one, and tables can be written."""
    code = (
        "from tessella.session import local_session, materialize, shared_dir\n"
        "s = local_session(2, 2)\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert materialize(s.range(5)).count() == 5 and shared_dir(s) == shared_dir(s)\n"
        "print('fine')"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS",)} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
