"""Readers, writers and streams on small retyped files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import history
from tessella.sources import labels, sinks
from tessella.streaming import runs as streams

PDS3 = 'PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 40\r\n^IMAGE = ("PIC.IMG",{at})\r\nLINES = 4\r\nLINE_SAMPLES = 5\r\nSAMPLE_BITS = 8\r\nSAMPLE_TYPE = {kind}\r\nSTART_TIME = 2020-01-02T03:04:05\r\nORBIT_NUMBER = 77\r\nEND\r\n'
PDS4 = """<?xml version="1.0"?><p:Product xmlns:p="http://x"><p:Time><p:start_date_time>2024-05-06T07:08:09Z</p:start_date_time></p:Time>
<p:File><p:file_name>a.img</p:file_name></p:File><p:Array><p:offset unit="byte">16</p:offset><p:data_type>UnsignedByte</p:data_type>
<p:Axis_Array><p:axis_name>Line</p:axis_name><p:elements>4</p:elements></p:Axis_Array><p:Axis_Array><p:axis_name>Sample</p:axis_name><p:elements>5</p:elements></p:Axis_Array></p:Array>
<p:sun_elevation>12.5</p:sun_elevation><p:upper_left_latitude>1</p:upper_left_latitude><p:upper_left_longitude>-10</p:upper_left_longitude></p:Product>"""
KML = """<kml xmlns="http://k"><Placemark><Point><coordinates>-5,2,0</coordinates></Point><LinearRing><coordinates>-6,1,0 -4,1,0 -4,3,0 -6,3,0 -6,1,0</coordinates></LinearRing></Placemark></kml>"""
GAZ = """<kml><Document><Placemark><ExtendedData><SchemaData><SimpleData name="type">Crater, craters</SimpleData><SimpleData name="clean_name">Abc</SimpleData><SimpleData name="center_lat">1.5</SimpleData><SimpleData name="center_lon">-20</SimpleData></SchemaData></ExtendedData></Placemark>
<Placemark><ExtendedData><SchemaData><SimpleData name="type">Mons</SimpleData><SimpleData name="clean_name">No</SimpleData></SchemaData></ExtendedData></Placemark></Document></kml>"""


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_labels(spark, tmp_path):
    r = labels.pds4_labels(spark, put(tmp_path / "p4.xml", PDS4)).first()
    assert (r.lines, r.samples, r.offset, r.file_name, r.sun_elevation) == (4, 5, 16, "a.img", 12.5) and r.corners[0].lon == 350 and r.start.hour == 7
    for at, want in (("3", 80), ("11 <BYTES>", 10)):
        r = labels.pds3_labels(spark, put(tmp_path / "p3.lbl", PDS3.format(at=at, kind="MSB_INTEGER"))).first()
        assert (r.lines, r.samples, r.offset, r.file_name, r.dtype, r.orbit) == (4, 5, want, "PIC.IMG", "<u1", 77) and r.warning
    r = labels.pds3_labels(spark, put(tmp_path / "p3b.lbl", PDS3.replace('("PIC.IMG",{at})', "2").format(kind="UNSIGNED_INTEGER"))).first()
    assert r.offset == 40 and r.file_name is None


def test_raw_rasters(spark, tmp_path):
    img = (np.arange(48)[:, None] + np.arange(64)[None, :]).astype(np.uint8)
    put(tmp_path / "a.img", b"x" * 16 + img.tobytes())
    put(tmp_path / "b.img", b"short")
    lab = spark.createDataFrame([("a.img", "a", 48, 64, 1, "<u1", 1, 16), ("b.img", "b", 48, 64, 1, "<u1", 1, 0)], "file_name string, product_id string, lines int, samples int, bands int, dtype string, sample_bytes int, offset long")
    tiles = labels.raw_rasters(spark, str(tmp_path / "*.img"), lab, tile=20)
    px = labels.tile_pixels(tiles).collect()
    assert len(px) == 48 * 64 and all(r.value == (r.row + r.col) % 256 for r in px)
    assert "needed" in tiles.where("product_id = 'b'").first().warning
    blob = b"x" * 16 + img.tobytes()
    assert labels.fingerprints(spark, str(tmp_path / "a.img")).first().file_hash == hashlib.sha1(blob + str(len(blob)).encode()).hexdigest()[:16]
    assert labels.fingerprints(spark, str(tmp_path / "a.img"), 100).first().file_hash == hashlib.sha1(blob[:100] + str(len(blob)).encode()).hexdigest()[:16]


def test_raw_strips_beyond_2_gb(spark, tmp_path):
    """Two bands of two-byte samples behind 3 GB that are never read (a sparse file)."""
    cube = np.arange(2 * 50 * 30, dtype=">i2").reshape(2, 50, 30)
    with open(tmp_path / "big one.img", "wb") as f:
        f.seek(3 << 30)
        f.write(cube.tobytes())
    lab = spark.createDataFrame([("big one.img", "big", 50, 30, 2, ">i2", 2, 3 << 30)], "file_name string, product_id string, lines int, samples int, bands int, dtype string, sample_bytes int, offset long")
    px = labels.tile_pixels(labels.raw_rasters(spark, str(tmp_path / "*.img"), lab, tile=16)).collect()
    assert {(r.band, r.row, r.col): r.value for r in px} == {k: float(v) for k, v in np.ndenumerate(cube)}


def test_footprint_grid_catalogs(spark, tmp_path):
    r = labels.footprint_kml(spark, put(tmp_path / "f.kml", KML)).first()
    assert len(r.ring) == 5 and r.ring[0].lon == 354 and r.centre.lat == 2
    g = labels.geometry_grid(spark, put(tmp_path / "g.csv", "Longitude,Latitude,Scan,Pixel\n-1,2,0,1\n")).first()
    assert (g.product_id, g.lon, g.pixel) == ("g", 359, 1)
    c = labels.crater_csv(spark, put(tmp_path / "c.csv", "CRATER_ID,LAT_CIRC_IMG,LON_CIRC_IMG,DIAM_CIRC_IMG\na,1,2,3\nb,x,2,3\n")).collect()
    assert [r.crater_id for r in c] == ["a"]
    z = labels.gazetteer_kml(spark, put(tmp_path / "z.kml", GAZ)).collect()
    assert [(r.name, r.lon, r.diameter_km) for r in z] == [("Abc", 340, None)]
    m = labels.manifest(spark, put(tmp_path / "m.json", json.dumps({"pairs": [{"query": "a", "reference": "b", "note": ""}]}))).collect()
    assert m[0].query == "a"


def test_dem_and_listing(spark, tmp_path):
    d = np.arange(24, dtype="<i2").reshape(4, 6)
    px = labels.dem_pixels(labels.dem_records(spark, put(tmp_path / "d.img", d.tobytes()), 6)).collect()
    assert {(r.row, r.col): r.value for r in px} == {(i, j): d[i, j] * 0.5 for i in range(4) for j in range(6)}
    got = {r.path: r.reader for r in labels.sniff(spark.createDataFrame([("x/a.img",), ("x/a.lbl",), ("x/b.img",), ("x/c.spm",)], "path string")).collect()}
    assert got == {"x/a.img": "raw_detached", "x/a.lbl": "pds3_label", "x/b.img": "raw_attached", "x/c.spm": "telemetry"}
    meta = spark.createDataFrame([(1, {"271": "maker"}), (2, {"1": "x"}), (3, None)], "id long, exif map<string,string>")
    assert sorted(r.id for r in labels.reject_camera_files(meta).collect()) == [2, 3]


def spm(n, elevation):
    return f"ORBTATTD {n} xx2023 4 5 6 7 8 250 1 2 3 4 5 6 10 20 30 {elevation}"


def test_telemetry_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src / "p1.spm", "\n".join([spm(1, 40), "junk", spm(2, 41)]))
    batch = labels.telemetry_files(spark, str(src)).orderBy("record_num").collect()
    assert len(batch) == 2 and batch[0].product_id == "p1" and batch[0].ts.microsecond == 250000 and batch[1].elevation == 41 and batch[0].pos == [1, 2, 3]
    q = streams.telemetry_stream(spark, str(src)).writeStream.format("memory").queryName("tele").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    put(src / "p2.spm", spm(9, 1))
    q.processAllAvailable()
    q.stop()
    assert spark.table("tele").count() == 3 and spark.table("tele").where("product_id = 'p2'").count() == 1


def test_label_stream(spark, tmp_path):
    """Files that come later are read by the next trigger; a file that is no label gives a row without lines, its image at byte 0 as in a label without a pointer."""
    src = tmp_path / "labels"
    src.mkdir()
    label = "PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 40\r\n^IMAGE = (\"A.IMG\",3)\r\nLINES = %d\r\nLINE_SAMPLES = 5\r\nEND\r\n"
    put(src / "a.lbl", label % 7)
    stream = streams.label_stream(spark, str(src), labels.pds3_fields).select("product_id", "lines", "offset")
    q = stream.writeStream.format("memory").queryName("lbl").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    put(src / "b.lbl", label % 9)
    put(src / "c.lbl", "nothing")
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("lbl").collect()) == [("a", 7, 80), ("b", 9, 80), ("c", None, 0)]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], float(v) if i % 9 else float("nan")) for i, v in enumerate(rng.normal(5, 1, 120))]
    rows[77] = (77, "b", 40.0)
    frame = spark.createDataFrame(rows, "id long, sensor_type string, rmse double")
    src = str(tmp_path / "runs")
    for a, b in ((0, 50), (50, 90), (90, 120)):
        frame.where(f"id >= {a} and id < {b}").coalesce(1).write.mode("append").json(src)
    stream = streams.results_stream(spark, src, "id long, sensor_type string, rmse double")
    stream = spark.readStream.schema("id long, sensor_type string, rmse string").option("maxFilesPerTrigger", 1).json(src).withColumn("rmse", F.col("rmse").cast("double"))
    q = streams.score_stream(stream).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r for r in spark.table("scored").collect()}
    want = {r.id: r for r in history.flag_anomalies(frame).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        g = got[i]
        assert (g.n_prior, g.anomalous) == (w.n_prior, w.anomalous)
        assert (g.baseline_std is None) == (w.baseline_std is None) and (w.baseline_std is None or g.baseline_std == pytest.approx(w.baseline_std))
    assert want[77].anomalous


def test_summary_and_enrichment_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 2.0, "p"), (2, "a", 4.0, "q")], "id long, sensor_type string, rmse double, product_id string").write.json(src)
    s = spark.readStream.schema("id long, sensor_type string, rmse double, product_id string").json(src)
    q = streams.summary_stream(s).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sums").first().mean_rmse == 3
    static = spark.createDataFrame([("p", 7)], "product_id string, orbit int")
    q = streams.enrich_stream(s, static).writeStream.format("memory").queryName("rich").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.orbit for r in spark.table("rich").collect()} == {1: 7, 2: None}


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(0, "2024-01-01", "a", "x"), (0, "2024-01-02", "b", "y")], "id long, ts string, sensor_type string, src_path string")
    path = str(tmp_path / "runs")
    history.append_runs(runs, path)
    history.append_runs(runs.withColumn("extra", F.lit(1)), path)
    back = history.read_history(spark, path).orderBy("id").collect()
    assert [r.id for r in back] == [1, 2, 3, 4] and back[0].extra is None and back[3].extra == 1
    many = spark.range(5000).select((F.col("id") * 0).alias("id"), F.lit("2024").alias("ts"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("sensor_type"), F.col("id").cast("string").alias("src_path"))
    history.append_runs(many.repartition(7), path + "2")
    back = history.read_history(spark, path + "2").orderBy("sensor_type", "ts", "src_path").collect()
    assert [r.id for r in back] == list(range(1, 5001))  # runs without a sensor are runs too
    cells = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0, 5)], "lon0 double, lon1 double, lat0 double, lat1 double, n int")
    f = json.loads(sinks.geojson(cells, ["n"]).first().feature)
    assert f["geometry"]["coordinates"][0][0] == [0, 2] and f["properties"]["n"] == 5
    pts = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "run_id long, match_idx long, x double")
    sinks.write_match_points(pts, str(tmp_path / "pts"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "pts")).count() == 2
    assert json.loads(sinks.run_documents(pts).where("run_id = 2").first().result_json)["x"] == 3
