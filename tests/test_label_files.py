"""Streams of many small label files."""

import gzip

from tessella.session import listed, settings
from tessella.sources import labels
from tessella.streaming import runs as streams


def test_a_trigger_takes_a_bounded_number_of_label_files(spark, tmp_path):
    """Plain and packed files, all of them, over several triggers; the session's settings are its own again."""
    src = tmp_path / "labels"
    src.mkdir()
    for k in range(5):
        (src / f"a b{k}.lbl").write_bytes(f"LINES = {k}\r\nORBIT_NUMBER = 7\r\nMD5_CHECKSUM = é\r\n".encode())
    (src / "c.lbl.gz").write_bytes(gzip.compress(b"LINES = 9\r\n"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    out = streams.drain(streams.label_stream(spark, str(src), labels.pds3_fields, per_trigger=2))
    got = sorted(((r.path.rpartition("/")[2].replace("%20", " "), r.lines, r.md5) for r in out.collect()), key=str)
    assert got == [*[(f"a b{k}.lbl", k, "é") for k in range(5)], ("c.lbl.gz", 9, None)]
    at = out.inputFiles()[0].rpartition("/rows/")[0]
    assert len(listed(spark, f"{at}/state/commits")) >= 3
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_settings_hold_for_a_while(spark):
    with settings(spark, {"spark.tessella.one": 1}):
        assert spark.conf.get("spark.tessella.one") == "1"
    assert spark.conf.get("spark.tessella.one", None) is None
