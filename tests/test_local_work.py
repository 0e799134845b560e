"""Steps that must look at what is near only, with the results of a wide look."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.geo import inverse_bilinear
from tessella.operators import detections, footprints, history
from tessella.sources import sinks


def test_points_try_the_patches_around_them_only(spark, monkeypatch):
    """A sheared grid with small and wide steps, places in it, on its samples, outside of it and nowhere: as all patches of the bin say."""
    rng, steps = np.random.default_rng(8), np.cumsum([0, *[0.002] * 20, *[0.02] * 4, 0.3])
    grid = [(1, i, j, 10 + float(x) + 0.2 * float(y), float(y) - 0.1 * float(x)) for i, y in enumerate(steps) for j, x in enumerate(steps)]
    grid += [(2, i, j, 0.01 * j, 0.01 * i) for i in range(8) for j in range(8)] + [(2, 8, 0, None, 0.08)]
    grid = spark.createDataFrame(grid, "product_id long, scan int, pixel int, lon double, lat double")
    places = [(1, k, 10 + float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-0.02, 0.5, (300, 2)))] + [(2, 1000 + k, 0.01 * (k % 8), 0.01 * (k // 8)) for k in range(64)]
    places += [(2, 2000, 0.075, 0.075), (2, 2001, 50.0, 5.0), (2, 2002, None, 0.0), (2, 2003, float("nan"), 0.0), (3, 2004, 0.0, 0.0)]
    points = spark.createDataFrame(places, "product_id long, point_id long, lon double, lat double")
    tried, best = [], footprints._best_patch
    monkeypatch.setattr(footprints, "_best_patch", lambda hits: tried.append(hits.count()) or best(hits))
    got = {r.point_id: (r.scan, r.pixel, r.residual) for r in footprints.locate_on_grid(points, grid).collect()}
    patch = footprints._patches(grid)
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / 0.05), F.floor(F.col(b) / 0.05))
    both = points.join(patch, "product_id").where(F.array_contains(cells("b.lon0", "b.lon1"), F.floor(F.col("lon") / 0.05)) & F.array_contains(cells("b.lat0", "b.lat1"), F.floor(F.col("lat") / 0.05)))
    at = both.withColumn("at", inverse_bilinear("corners", "lon", "lat", F.lit(2), F.lit(2)))
    at = at.select("point_id", F.struct("at.residual", (F.col("scan") + F.col("at.line") * (F.col("scan2") - F.col("scan"))).alias("scan"), (F.col("pixel") + F.col("at.sample") * (F.col("pixel2") - F.col("pixel"))).alias("pixel")).alias("b"))
    want = {r.point_id: (r.b.scan, r.b.pixel, r.b.residual) for r in at.groupBy("point_id").agg(F.min("b").alias("b")).collect()}
    same = lambda a, b: a == b or repr(a) == repr(b)
    assert len(got) == len(places) and all(same(got[k], want.get(k, (None, None, None))) for k in got)
    assert got[2000][2] > 0 and got[2001][0] is None and tried[0] < both.count() / 4


def test_frequent_substrings_of_paths_are_dealt_in_shares(spark, monkeypatch):
    """Short and long ids, one in every path, some with frequent substrings only: as a search of all ids in all paths, whichever way."""
    names = [f"tmc_{i:08d}_d" for i in range(40)] + [f"ohr_{i}" for i in range(0, 30, 3)] + ["data/", "data/tmc_", "é_ü", "tmc_0000", ""]
    products = [(p, (i * 7) % 11) for i, p in enumerate(names)] + [(None, -1), ("ohr_3", -5)]
    paths = [(i, f"data/{'tmc_%08d_%s' % (i % 50, 'de'[i % 2]) if i % 5 else 'ohr_%d' % (i % 31)}{i % 10}.img") for i in range(3000)] + [(3000, "x/é_ü"), (3001, None), (3002, ""), (3003, "ohr")]
    runs = spark.createDataFrame(paths, "id long, src_path string")
    frame = spark.createDataFrame(products, "product_id string, ord long")
    want = {i: min(((o, p) for p, o in products if p and path and p in path), default=(None, None))[1] for i, path in paths}
    dealt, real = [], history._frequent_grams
    monkeypatch.setattr(history, "_frequent_grams", lambda *a: dealt.append(real(*a)) or dealt[-1])
    for gram, small in ((8, 10_000), (8, 0), (3, 0), (3, 30)):
        assert {r.id: r.product_id for r in history.enrich_with_products(runs, frame, gram, small).collect()} == want
    shares = {r.gram: r.shares for r in dealt[1].collect()}
    assert shares["data/tmc"] > 700 and shares["tmc_0000"] > 700 and shares.get("0000047_", 1) < 30
    assert history.product_matches(runs, frame.limit(0)).count() == 0


def test_clusters_of_whole_images_and_of_rounds_are_the_same(spark, monkeypatch):
    """Boxes of sizes 0 to 9 on whole places, equal ids, confidences that tie, are null or no number; an image with a box without a place."""
    rng = np.random.default_rng(4)
    sure = [None, float("nan"), float("inf"), float("-inf"), 0.0, 0.5, 0.5, 1.0]
    rows = [(m, int(i), *map(float, rng.integers(0, side, 2)), *map(float, rng.integers(0, 10, 2)), sure[rng.integers(len(sure))], f"c{i}") for m, n, side in ((1, 400, 80), (2, 300, 30), (3, 1, 5), (4, 60, 40)) for i in rng.permutation(n)]
    rows += [(1, 7, 3.0, 3.0, 5.0, 5.0, 0.5, "again"), (4, 60, None, 3.0, 5.0, 5.0, 0.5, "nowhere"), (None, 1, 3.0, 3.0, 5.0, 5.0, 0.5, "no image")]
    frame = spark.createDataFrame(rows, "image_id long, det_id int, cx double, cy double, w double, h double, confidence double, name string").repartition(3)
    want = sorted(map(repr, detections._cluster_rounds(frame, 0.3).collect()))
    for whole in (20_000, 350, 0):
        assert sorted(map(repr, detections.cluster_best(frame, 0.3, whole).collect())) == want
    one = frame.where("image_id = 2")
    own = sorted(map(repr, detections._cluster_rounds(one, 0.3).collect()))
    monkeypatch.setattr(detections, "_cluster_rounds", None)
    assert sorted(map(repr, detections.cluster_best(one, 0.3).collect())) == own
    step = detections._clusters
    monkeypatch.setattr(detections, "_clusters", lambda least: step(least, 10))
    assert sorted(map(repr, detections.cluster_best(one, 0.3).collect())) == own


def test_files_of_match_points_do_not_grow_with_the_runs(spark, tmp_path):
    points = spark.range(3000).select(F.when(F.col("id") > 5, F.col("id") % 300).alias("run_id"), F.col("id").alias("match_idx"), (F.col("id") / 7).alias("x"))
    rows = sorted(map(repr, points.collect()))
    for form, by_run in (("csv", False), ("json", False), ("csv", True), ("json", True)):
        at = tmp_path / f"{form}{by_run}"
        sinks.write_match_points(points.repartition(5), str(at), form, by_run)
        files = list(at.rglob(f"part-*.{form}"))
        assert len(files) == 301 if by_run else len(files) <= 8
        back = spark.read.schema("run_id long, match_idx long, x double").option("header", "true")
        assert sorted(map(repr, (back.csv(str(at)) if form == "csv" and not by_run else back.format(form).load(str(at)).select("run_id", "match_idx", "x")).collect())) == rows
        if not by_run:
            place = back.format(form).load(str(at)).select("run_id", F.input_file_name().alias("file")).collect()
            turns = [(r.file, r.run_id) for i, r in enumerate(place) if not i or (r.file, r.run_id) != (place[i - 1].file, place[i - 1].run_id)]
            assert len(turns) == 301  # every run in one file, in one piece
