"""Regions and clusters: brute force, places and ids beyond 2^31, rows of very many runs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import detections, raster, tiles
from tessella.operators.graph import connected_components


def brute(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for i, j in np.argwhere(mask):
        if seen[i, j]:
            continue
        todo, got = [(i, j)], []
        seen[i, j] = True
        while todo:
            r, c = todo.pop()
            got.append((r, c))
            for a in range(max(0, r - 1), min(mask.shape[0], r + 2)):
                for b in range(max(0, c - 1), min(mask.shape[1], c + 2)):
                    if mask[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        todo.append((a, b))
        g = np.array(got)
        out.append((len(g), round(g[:, 1].mean(), 9), round(g[:, 0].mean(), 9), g[:, 0].min(), g[:, 0].max(), g[:, 1].min(), g[:, 1].max()))
    return sorted(tuple(float(x) for x in r) for r in out)


def of(spark, places, raster_id=0):
    return spark.createDataFrame([(raster_id, int(r), int(c), True) for r, c in places], "raster_id long, row long, col long, shadow boolean")


@pytest.mark.parametrize("share", [0.2, 0.42, 0.7])
def test_regions_over_tiles(spark, share):
    mask = np.random.default_rng(int(share * 100)).random((40, 53)) < share
    marks = tiles.to_tiles(of(spark, np.argwhere(mask)).withColumn("value", F.lit(1.0)), 8)
    parts, labels = tiles.label_regions(marks, 8)
    comp = connected_components(tiles.region_links(labels, 8))
    r = parts.join(comp, "node", "left").withColumn("region", F.coalesce("component", "node")).groupBy("region")
    got = r.agg(F.sum("area"), F.sum("sum_col") / F.sum("area"), F.sum("sum_row") / F.sum("area"), F.min("row0"), F.max("row1"), F.min("col0"), F.max("col1")).drop("region").collect()
    assert sorted(tuple(round(float(x), 9) for x in g) for g in got) == brute(mask)
    whole = raster.regions(of(spark, np.argwhere(mask)), least=1, top=10_000)
    assert sorted(tuple(round(float(x), 9) for x in g[1:8]) for g in whole.collect()) == brute(mask)


def test_far_places_and_ids(spark):
    places = [(1, 4_194_311), (2, 7), (3, 7), (1 << 40, -5), (1 << 40, -4)]
    df = of(spark, places, 1 << 60).unionByName(of(spark, [(0, 0)], -(1 << 50)))
    got = sorted((r.raster_id, r.area, r.row0, r.col0) for r in raster.regions(df, least=1).collect())
    assert got == [(-(1 << 50), 1, 0, 0), (1 << 60, 1, 1, 4_194_311), (1 << 60, 2, 2, 7), (1 << 60, 2, 1 << 40, -5)]
    assert raster.regions(df.where("row < -9"), least=1).count() == 0


def test_rows_of_very_many_runs(spark):
    """40,000 runs in each of two rows: every run is looked at once."""
    df = spark.range(80_000).select(F.lit(0).cast("long").alias("raster_id"), (F.col("id") % 2).alias("row"), (F.floor(F.col("id") / 2) * 4).alias("col"), F.lit(True).alias("shadow"))
    start = time.perf_counter()
    got = raster.regions(df, least=2, top=100_000)
    assert got.count() == 40_000 and got.where("area = 2").count() == 40_000
    assert time.perf_counter() - start < 30


def test_clusters_of_large_image_ids(spark):
    rows = [(1 << 40, 1, 10.0, 10.0, 8.0, 8.0, 0.5), (1 << 40, 2, 10.5, 10.0, 8.0, 8.0, 0.9), (1 << 40, 3, 11.0, 10.0, 8.0, 8.0, None), (1 << 40, 1 << 35, 90.0, 90.0, 8.0, 8.0, 0.1), (-3, 1, 10.0, 10.0, 8.0, 8.0, 0.9), (-3, 2, 10.0, 10.0, 8.0, 8.0, 0.9)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, cx double, cy double, w double, h double, confidence double")
    got = sorted((r.image_id, r.det_id, r.cluster) for r in detections.cluster_best(df).collect())
    assert got == [(-3, 1, 1), (1 << 40, 2, 1), (1 << 40, 1 << 35, 1 << 35)]
