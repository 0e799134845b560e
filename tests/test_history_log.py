"""Appending writers at once, histories from before the log, and product lookup among many ids."""

import threading

from pyspark.sql import functions as F

from tessella.operators import history
from tessella.session import create_once, read_text


def runs(spark, n, tag):
    return spark.range(n).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("sensor_type"), F.timestamp_seconds(F.col("id")).alias("ts"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("src_path"), (F.col("id") * 0.5).alias("rmse"))


def test_writers_at_once_take_distinct_ids(spark, tmp_path):
    path, failed = str(tmp_path / "history"), []

    def write(tag):
        try:
            history.append_runs(runs(spark, 40, tag), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(t,)) for t in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = history.read_history(spark, path).collect()
    assert sorted(r.id for r in got) == list(range(1, 161)) and len({r.src_path for r in got}) == 160
    for tag in "abcd":  # a writer's ids are in one stretch, in order
        ids = [r.id for r in sorted((r for r in got if r.src_path[0] == tag), key=lambda r: (r.sensor_type, r.ts))]
        assert ids == list(range(ids[0], ids[0] + 40))


def test_a_history_from_before_the_log_goes_on(spark, tmp_path):
    path = str(tmp_path / "old")
    runs(spark, 5, "o").withColumn("id", F.monotonically_increasing_id() % 5 + 100).coalesce(1).write.partitionBy("sensor_type").parquet(path)
    history.append_runs(runs(spark, 2, "n"), path)
    history.append_runs(runs(spark, 0, "none"), path)
    assert sorted(r.id for r in history.read_history(spark, path).where("src_path like 'n%'").collect()) == [105, 106]
    assert history.read_history(spark, path).count() == 7


def test_a_file_is_created_once(spark, tmp_path):
    at = str(tmp_path / "log/0001")
    assert create_once(spark, at, "first") and not create_once(spark, at, "second") and read_text(spark, at) == "first"
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["0001"]


def test_products_among_a_hundred_thousand(spark):
    products = spark.range(100_000).select(F.format_string("ch2_ohr_ncp_%06d_d_img", "id").alias("product_id"), F.col("id").alias("ord"))
    products = products.unionByName(spark.createDataFrame([("ab", 200_000), ("ohr_ncp_000007_d", -1), (None, -5), ("", -6)], "product_id string, ord long"))
    paths = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.format_string("x/ch2_ohr_ncp_%06d_d_img_d18.png", F.col("id") * 7)).when(F.col("id") % 3 == 1, F.lit("cab.png")).otherwise(F.lit("a")).alias("src_path"))
    paths = paths.unionByName(spark.createDataFrame([(9000, None), (9001, "ch2_ohr_ncp_000007_d_img")], "id long, src_path string"))
    got = {r.id: r.product_id for r in history.enrich_with_products(paths, products).collect()}
    want = {i: f"ch2_ohr_ncp_{i * 7:06d}_d_img" if i % 3 == 0 else "ab" if i % 3 == 1 else None for i in range(3000)} | {9000: None, 9001: "ohr_ncp_000007_d"}
    assert got == want
