"""Footprints and craters that lie alike are looked at once."""

from pyspark.sql import functions as F

from tessella.operators import catalog, footprints
from tessella.plans import catalog_queries

BOX = "product_id long, lon0 double, lon1 double, lat0 double, lat1 double"


def tables(spark):
    craters = spark.createDataFrame([(i, 1.5 + i % 2, 1.5, float(1 + i)) for i in range(6)] + [(6, 9.0, 9.0, 1.0)], "crater_id long, lon double, lat double, diameter_km double")
    return craters, spark.createDataFrame([(1, 0.0, 6.0, 0.0, 9.0), (2, 0.0, 6.0, 0.0, 9.0), (3, 2.0, 8.0, 0.0, 9.0), (4, 2.0, 8.0, 0.0, 9.0), (4, 8.0, 10.0, 8.0, 10.0), (5, 20.0, 21.0, 0.0, 1.0)], BOX)


def test_equal_boxes_are_one_and_all_products_stay(spark):
    craters, boxes = tables(spark)
    members, shapes = catalog.alike(boxes)
    assert {r.product_id: r.like for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and shapes.count() == 5
    assert {r.product_id: r.n for r in catalog.count_in_boxes(craters, boxes).collect()} == {1: 6, 2: 6, 3: 3, 4: 4}
    stats = [(r.product_id, r.n, r.max_d, r.mean_d) for r in catalog.footprint_stats(craters, boxes).collect()]
    assert sorted(stats, key=str) == [(1, 6, 6.0, 3.5), (2, 6, 6.0, 3.5), (3, 3, 6.0, 4.0), (4, 4, 6.0, 3.25), (4, 4, 6.0, 3.25), (5, 0, None, None)]
    rough = {r.product_id: (r.n, r.weight) for r in catalog.roughness(craters, boxes.where("product_id < 3"), 1).collect()}
    assert rough == {1: (6, 91.0), 2: (6, 91.0)}
    assert {(r.product_id, r.bins) for r in catalog.diameter_histogram(craters, boxes).collect()} == {(i, 5) for i in (1, 2, 3, 4)}


def test_place_of_a_crater_is_worked_out_once_a_shape(spark):
    """Two frames of one shape and three craters of one place are six rows, each with its own radius, from one inverse grid."""
    craters = spark.createDataFrame([(i, 3.0, 4.5, 6.0 + i) for i in range(3)], "crater_id long, lon double, lat double, diameter_km double")
    corner = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    f = spark.createDataFrame([(1, 0.0, 6.0, 0.0, 9.0), (2, 0.0, 6.0, 0.0, 9.0)], BOX).withColumnRenamed("product_id", "image_id")
    f = f.withColumn("corners", F.array(corner("lat0", "lon0"), corner("lat0", "lon1"), corner("lat1", "lon0"), corner("lat1", "lon1"))).selectExpr("*", "901 as lines", "601 as samples", "300.0D * image_id as gsd_m")
    got = sorted((r.image_id, r.crater_id, round(r.cx, 6), round(r.cy, 6), round(r.radius_px, 6)) for r in footprints.place_craters(craters, f).collect())
    assert got == [(i, c, 300.0, 450.0, round((6 + c) * 500 / 300 / i, 6)) for i in (1, 2) for c in range(3)]


def test_equal_rings_are_judged_once(spark):
    rows = [(1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0), (5, 50.0)]
    at = lambda a, o: F.struct(F.lit(float(a)).alias("lat"), (F.col("x") + o).alias("lon"))
    rings = spark.createDataFrame(rows, "product_id long, x double").select("product_id", F.array(at(0, 0), at(0, 3), at(4, 3), at(4, 0)).alias("ring"))
    got = sorted((r.product_id_a, r.product_id_b, r.overlaps) for r in footprints.overlapping_footprints(rings).collect())
    assert got == [(a, b, True) for a in range(1, 5) for b in range(a + 1, 5)]


def test_points_on_an_edge_are_not_inside(spark, tmp_path):
    """Many craters lie on edges of quads; the query counts what its SQL counts."""
    import duckdb

    spark.range(0, 3000, 5).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(0, 400000, 40).selectExpr("id as o_orderkey", "1000.0D as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    from tessella.plans.registry import ORACLE

    want = sorted(c.execute(ORACLE["j4_points_in_polygons"]).fetchall())
    assert sorted(tuple(r) for r in catalog_queries.j4_points_in_polygons(spark, str(tmp_path)).collect()) == want and want
