"""The binary data sources: ranges, conditions, order, and what they refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import detections
from tessella.sources import labels, records


def test_records_in_pieces_and_by_rows(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("row"), F.array(*[(F.col("id") * 3 - 1500 + i) * 0.5 for i in range(4)]).alias("values"))
    at = str(tmp_path / "dem")
    records.write_records(df.repartition(5), at, 4, scale=0.5)
    assert sum(size for _, size in records.files_of(at)) == 8000
    back = records.read_records(spark, at, 4, scale=0.5, piece_bytes=400)
    assert back.rdd.getNumPartitions() >= 20
    assert {r.row: r.values for r in back.collect()} == {i: [(i * 3 - 1500 + j) * 0.5 for j in range(4)] for i in range(1000)}
    few = back.where("row > 100 and row <= 130 and values[0] < 0")
    assert few.rdd.getNumPartitions() <= 2 and few.count() == 30
    assert back.where("row = 999").count() == 1 and back.where("row > 5000").count() == 0
    records.write_records(df.limit(10), at, 4, scale=0.5, mode="overwrite")
    assert records.read_records(spark, at, 4).count() == 10


def test_records_refuse_what_does_not_fit(spark, tmp_path):
    row = lambda i, *v: (i, list(map(float, v)))
    for rows in ([row(0, 1, 2), row(2, 1, 2)], [row(0, 1)], [row(0, 40_000, 0)]):
        with pytest.raises(Exception, match="gaps|record does not hold|does not fit"):
            records.write_records(spark.createDataFrame(rows, "row long, values array<double>").coalesce(1), str(tmp_path / f"bad{len(rows[0][1])}{rows[-1][0]}{rows[0][1][0]}"), 2)
    (tmp_path / "odd.img").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole records"):
        records.read_records(spark, str(tmp_path / "odd.img"), 2).count()
    (tmp_path / "head.img").write_bytes(b"xx" + np.arange(4, dtype=">f4").tobytes())
    assert records.read_records(spark, str(tmp_path / "head.img"), 4, ">f4", offset=2).first()["values"] == [0, 1, 2, 3]


def test_whole_files(spark, tmp_path):
    at = str(tmp_path / "files")
    records.write_files(spark.createDataFrame([("a/b.txt", b"x\n"), ("c.bin", b"\x00\xff"), ("empty", b"")], "name string, content binary"), at)
    assert (tmp_path / "files/a/b.txt").read_bytes() == b"x\n" and (tmp_path / "files/c.bin").read_bytes() == b"\x00\xff" and (tmp_path / "files/empty").read_bytes() == b""
    detections.write_training_labels(spark.createDataFrame([(7, "0 2"), (7, "0 1"), (8, "0 3")], "image_id long, line string"), str(tmp_path / "labels"))
    assert (tmp_path / "labels/7.txt").read_text() == "0 1\n0 2\n" and (tmp_path / "labels/8.txt").read_text() == "0 3\n"
    assert {r.path.rpartition("/")[2]: r.length for r in labels.heads(spark, at + "/c.bin", 1).collect()} == {"c.bin": 2}
