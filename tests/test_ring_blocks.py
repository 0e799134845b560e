"""Pairs of rings go to tasks by blocks of their products."""

from pyspark.sql import functions as F

from tessella.operators import footprints
from tessella.plans import catalog_queries


def rings(spark):
    at = lambda a, o: F.struct(F.lit(float(a)).alias("lat"), (F.col("x") + o).alias("lon"))
    rows = [(i, float(i % 3)) for i in range(20)] + [(20, 50.0), (21, 4.5), (21, 4.5)]
    return spark.createDataFrame(rows, "product_id long, x double").select("product_id", F.array(at(0, 0), at(0, 3), at(4, 3), at(4, 0)).alias("ring")), dict(rows)


def test_each_pair_of_products_has_one_row_whatever_the_blocks(spark):
    table, x = rings(spark)
    want = sorted((a, b) for a in x for b in x if a < b and abs(x[a] - x[b]) < 3)
    for block in (2, 256):
        judged, members = footprints.overlapping_rings(table, block)
        assert (members.groupBy("shape").count().agg(F.max("count")).first()[0] > 1) == (block == 2)
        got = footprints.of_products(judged, members).collect()
        assert sorted((r.product_id_a, r.product_id_b) for r in got) == want and {r.overlaps for r in got} == {True}
    assert sorted((r.product_id_a, r.product_id_b) for r in footprints.overlapping_footprints(table).collect()) == want


def test_distances_are_rounded_before_products_meet(spark, tmp_path):
    spark.range(300).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    plan = str(catalog_queries.j5_polygon_overlap(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan())
    assert "round(" in plan and "round(" not in plan.split("Join")[0]
