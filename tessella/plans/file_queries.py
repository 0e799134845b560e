"""Queries on readers, writers and streams. Labels and lines are texts made of the given tables; files are written to the shared folder
and read back; streams run over the rows they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import detections, history
from tessella.plans.catalog_queries import _FLAGGED, _even
from tessella.plans.fixtures import table, with_tables
from tessella.plans.registry import query
from tessella.session import new_folder
from tessella.sources import labels, records, sinks
from tessella.streaming import runs as streams

_XML = """<?xml version="1.0"?><p:Product xmlns:p="http://x"><p:Time><p:start_date_time>2024-05-06T07:%02d:08Z</p:start_date_time></p:Time>
<p:File><p:file_name>f%d.img</p:file_name></p:File><p:Array><p:offset unit="byte">%d</p:offset><p:data_type>UnsignedByte</p:data_type>
<p:Axis_Array><p:axis_name>Line</p:axis_name><p:elements>%d</p:elements></p:Axis_Array><p:Axis_Array><p:axis_name>Sample</p:axis_name><p:elements>%d</p:elements></p:Axis_Array></p:Array>
<p:sun_elevation>%s</p:sun_elevation><p:upper_left_latitude>%d</p:upper_left_latitude><p:upper_left_longitude>-%d</p:upper_left_longitude></p:Product>"""
_KEYS = "PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 40\r\n^IMAGE = %s\r\nLINES = %d\r\nLINE_SAMPLES = 5\r\nSAMPLE_BITS = 16\r\nSAMPLE_TYPE = LSB_INTEGER\r\nORBIT_NUMBER = %d\r\nEND\r\n"
_KML = """<kml xmlns="http://k"><Placemark><Point><coordinates>%1$d,%2$d,0</coordinates></Point><LinearRing><coordinates>%1$d,%2$d,0 %3$d,%2$d,0 %3$d,%4$d,0 %1$d,%4$d,0 %1$d,%2$d,0</coordinates></LinearRing></Placemark></kml>"""


def _customers(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))


_LABELS = """SELECT 'p' || k AS product_id, epoch(TIMESTAMP '2024-05-06 07:00:08')::BIGINT + 60 * (k % 60) AS start_s, 'f' || k || '.img' AS file_name, k * 16 AS "offset", (k % 100 + 1)::INTEGER AS lines, (k % 50 + 2)::INTEGER AS samples,
CASE WHEN k % 7 > 0 THEN (k % 90)::DOUBLE END AS sun_elevation, (k % 80)::DOUBLE AS lat, ((360 - k % 180) % 360)::DOUBLE AS lon FROM (SELECT c_custkey::BIGINT AS k FROM customer)"""


def _label_texts(customers):
    """Every seventh label has an empty sun elevation."""
    sun = F.when(F.col("k") % 7 > 0, (F.col("k") % 90).cast("string")).otherwise("")
    value = F.format_string(_XML, F.col("k") % 60, "k", F.col("k") * 16, F.col("k") % 100 + 1, F.col("k") % 50 + 2, sun, F.col("k") % 80, F.col("k") % 180)
    return customers.select(F.format_string("d/p%d.xml", "k").alias("path"), value.alias("value"))


def _label_columns(out):
    corner = F.col("corners")[0]
    return out.select("product_id", F.unix_timestamp("start").alias("start_s"), "file_name", "offset", "lines", "samples", "sun_elevation", corner["lat"].alias("lat"), corner["lon"].alias("lon"))


@query("s2_pds4_labels", _LABELS)
def s2_pds4_labels(spark, sf):
    return _label_columns(labels.pds4_fields(_label_texts(_customers(spark, sf))))


@query("z3_label_stream", _LABELS)
def z3_label_stream(spark, sf):
    """The labels as new files of a folder. Keys are dealt out first, so that many tasks write files."""
    at = new_folder(spark)
    records.write_files(_label_texts(_customers(spark, sf).repartition("k")).select(F.substring_index("path", "/", -1).alias("name"), F.col("value").alias("content")), at)
    return _label_columns(streams.drain(streams.label_stream(spark, at)))


@query("s3_pds3_labels", """SELECT 'p' || k AS product_id, (k % 100 + 1)::INTEGER AS lines, CASE k % 3 WHEN 0 THEN (k % 9) * 40 WHEN 1 THEN k ELSE (k % 9) * 40 END AS "offset", CASE k % 3 WHEN 2 THEN NULL ELSE 'PIC' || k || '.IMG' END AS file_name, k::INTEGER AS orbit
FROM (SELECT c_custkey::BIGINT AS k FROM customer)""")
def s3_pds3_labels(spark, sf):
    """Pointers to a record of a file, to a byte of a file, and to a record of the label's own file."""
    record, kind = F.col("k") % 9 + 1, F.col("k") % 3
    pointer = F.when(kind == 0, F.format_string('("PIC%d.IMG",%d)', "k", record)).when(kind == 1, F.format_string('("PIC%d.IMG",%d <BYTES>)', "k", F.col("k") + 1)).otherwise(F.format_string("%d", record))
    value = F.format_string(_KEYS, pointer, F.col("k") % 100 + 1, "k")
    out = labels.pds3_fields(_customers(spark, sf).select(F.format_string("d/p%d.lbl", "k").alias("path"), value.alias("value")))
    return out.select("product_id", "lines", "offset", "file_name", "orbit")


@query("s4_footprint_kml", with_tables("footprints", "SELECT 'p' || product_id AS product_id, 5 AS n, lat1 AS lat, lon1 % 360 AS lon, lat0 AS centre_lat, lon0 AS centre_lon FROM footprints"))
def s4_footprint_kml(spark, sf):
    """The third corner of every ring, and the point."""
    whole = [F.col(c).cast("long") for c in ("lon0", "lat0", "lon1", "lat1")]
    texts = table(spark, sf, "footprints").select(F.format_string("d/p%d.kml", F.col("product_id").cast("long")).alias("path"), F.format_string(_KML, *whole).alias("value"))
    r = labels.footprint_rings(texts)
    corner = F.col("ring")[2]
    return r.select("product_id", F.size("ring").alias("n"), corner["lat"].alias("lat"), corner["lon"].alias("lon"), F.col("centre.lat").alias("centre_lat"), F.col("centre.lon").alias("centre_lon"))


@query("s5_geometry_grid", with_tables("pixels", 'SELECT "row"::INTEGER AS scan, col::INTEGER AS pixel, (360 - col) % 360::DOUBLE AS lon, "row" / 8 AS lat FROM pixels'))
def s5_geometry_grid(spark, sf):
    at = new_folder(spark)
    p = table(spark, sf, "pixels")
    p.select((-F.col("col")).alias("Longitude"), (F.col("row") / 8).alias("Latitude"), F.col("row").alias("Scan"), F.col("col").alias("Pixel")).write.csv(at, header=True)
    return labels.geometry_grid(spark, at).select("scan", "pixel", "lon", "lat")


@query("s7_crater_csv", with_tables("craters", "SELECT CAST(crater_id AS VARCHAR) AS crater_id, lat, lon % 360 AS lon, diameter_km FROM craters WHERE crater_id % 10 > 0"))
def s7_crater_csv(spark, sf):
    """The diameter of every tenth crater doesn't parse."""
    at = new_folder(spark)
    size = F.when(F.col("crater_id") % 10 > 0, F.col("diameter_km").cast("string")).otherwise("unknown")
    table(spark, sf, "craters").select(F.col("crater_id").alias("CRATER_ID"), F.col("lat").alias("LAT_CIRC_IMG"), F.col("lon").alias("LON_CIRC_IMG"), size.alias("DIAM_CIRC_IMG")).write.csv(at, header=True)
    return labels.crater_csv(spark, at).select("crater_id", "lat", "lon", "diameter_km")


def _lines(spark, sf):
    """A line a record; every tenth is of another kind, every eleventh has no position."""
    n = F.col("record_num")
    tag, x = F.when(n % 10 > 0, "ORBTATTD").otherwise("REMARK"), F.when(n % 11 > 0, (n % 100).cast("string")).otherwise("n/a")
    line = F.format_string("%s %d xx2023 %d %d %d %d %d %d %s 2 3 4 5 6 10 20 %d %d", tag, n, n % 12 + 1, n % 28 + 1, n % 24, n % 60, n % 59, n % 1000, x, F.col("azimuth").cast("long"), F.col("elevation").cast("long"))
    return table(spark, sf, "telemetry").select(F.lit("spm").alias("product_id"), line.alias("value"))


_RECORDS = with_tables("telemetry", """SELECT n AS record_num, '2023-' || lpad((n % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') || ' ' || lpad((n % 24)::VARCHAR, 2, '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') || ':' || lpad((n % 59)::VARCHAR, 2, '0') || '.' || lpad((n % 1000)::VARCHAR, 3, '0') AS at,
CASE WHEN n % 11 > 0 THEN (n % 100)::DOUBLE END AS pos_x, 4.0::DOUBLE AS vel_x, azimuth, elevation FROM (SELECT *, record_num::BIGINT AS n FROM telemetry) WHERE n % 10 > 0""")


def _records(t):
    return t.select("record_num", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), F.col("pos")[0].alias("pos_x"), F.col("vel")[0].alias("vel_x"), "azimuth", "elevation")


@query("s6_telemetry", _RECORDS)
def s6_telemetry(spark, sf):
    return _records(labels.telemetry(_lines(spark, sf)))


@query("z3_telemetry_stream", _RECORDS)
def z3_telemetry_stream(spark, sf):
    """The lines as new files of a folder."""
    at = new_folder(spark)
    _lines(spark, sf).select("value").write.text(at)
    return _records(streams.drain(streams.telemetry_stream(spark, at)))


@query("z3_results_stream", "SELECT event_id AS run_id, event_type AS sensor, round(value, 6) AS rmse FROM events")
def z3_results_stream(spark, sf):
    """Result files of a folder, as they come."""
    at = new_folder(spark)
    spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("long").alias("run_id"), F.col("event_type").alias("sensor"), F.col("value").alias("rmse")).write.json(at)
    out = streams.drain(streams.results_stream(spark, at, "run_id long, sensor string, rmse double"))
    return out.select("run_id", "sensor", F.round("rmse", 6).alias("rmse"))


@query("s11_match_points", with_tables("match_points", "SELECT run_id, count(*) AS n, round(sum(src_x), 4) AS src_x, min(ref_y) AS ref_y FROM match_points GROUP BY 1"))
def s11_match_points(spark, sf):
    """Points a run as its files hold them."""
    at = new_folder(spark)
    sinks.write_match_points(table(spark, sf, "match_points"), at, "json")
    back = spark.read.schema("match_idx long, src_x double, ref_y double, run_id long").json(at)
    return back.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("src_x"), 4).alias("src_x"), F.min("ref_y").alias("ref_y"))


@query("s12_run_documents", with_tables("runs", "SELECT id AS run_id, sensor_type, inlier_ratio, src_path FROM runs"))
def s12_run_documents(spark, sf):
    """Fields of every run's text."""
    d = sinks.run_documents(table(spark, sf, "runs").select(F.col("id").alias("run_id"), "sensor_type", F.struct("inlier_ratio").alias("matches"), "src_path"))
    get = lambda p: F.get_json_object("result_json", f"$.{p}")
    return d.select("run_id", get("sensor_type").alias("sensor_type"), get("matches.inlier_ratio").cast("double").alias("inlier_ratio"), get("src_path").alias("src_path"))


@query("s13_s17_history", with_tables("runs", """SELECT row_number() OVER (ORDER BY id % 2, sensor_type, ts, src_path) AS id, sensor_type, CASE WHEN id % 2 = 1 THEN 7 END AS extra FROM runs"""))
def s13_s17_history(spark, sf):
    """Runs of even id come first, those of odd id later and with one column more."""
    at = new_folder(spark)
    runs = table(spark, sf, "runs").select("id", "ts", "sensor_type", "src_path")
    history.append_runs(runs.where("id % 2 = 0"), at)
    history.append_runs(runs.where("id % 2 = 1").withColumn("extra", F.lit(7)), at)
    return history.read_history(spark, at).select("id", "sensor_type", "extra")


@query("s16_tiles", with_tables("pixels", 'SELECT "row" // 8 AS tile_row, count(*) AS n, round(sum(value), 4) AS total FROM pixels GROUP BY 1'))
def s16_tiles(spark, sf):
    """Strips of eight rows as their files hold them."""
    at = new_folder(spark)
    p = table(spark, sf, "pixels").groupBy("raster_id", F.expr("row div 8").alias("tile_row")).agg(F.array_agg("value").alias("values"))
    sinks.write_tiles(p, at)
    sums = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(at).select("tile_row", F.size("values").cast("long").alias("n"), F.round(sums, 4).alias("total"))


@query("s19_feature_cache", "SELECT substring(sha1('h' || c_custkey || 'p=1'), 1, 20) AS key, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END AS v FROM customer")
def s19_feature_cache(spark, sf):
    """Every third file is in the cache, which holds other files too."""
    k = _customers(spark, sf)
    files = k.select(F.concat(F.lit("h"), "k").alias("file_hash"))
    named = F.concat(F.when(F.col("k") % 3 == 0, "h").otherwise("other"), F.col("k"), F.lit("p=1"))
    cache = k.select(F.substring(F.sha1(named), 1, 20).alias("key"), F.lit(-1).alias("v"))
    return history.compute_missing(files, cache, lambda missing: missing.select("key", F.lit(1).alias("v")), "p=1")


@query("s15_geojson", with_tables("footprints", "SELECT product_id::BIGINT AS product_id, lon1 AS lon, lat1 AS lat, true AS closed FROM footprints"))
def s15_geojson(spark, sf):
    """The third corner of every polygon."""
    get = lambda p: F.get_json_object("feature", f"$.{p}")
    at = "geometry.coordinates[0]"
    return sinks.geojson(table(spark, sf, "footprints"), ["product_id"]).select(
        get("properties.product_id").cast("long").alias("product_id"), get(f"{at}[2][0]").cast("double").alias("lon"), get(f"{at}[2][1]").cast("double").alias("lat"), (get(f"{at}[0]") == get(f"{at}[4]")).alias("closed")
    )


@query("s20_sniff", """SELECT 'd/f' || p_partkey || '.img' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'raw_detached' ELSE 'raw_attached' END AS reader FROM part
UNION ALL SELECT 'd/f' || p_partkey || '.lbl', 'pds3_label' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'd/t' || p_partkey || '.spm', 'telemetry' FROM part""")
def s20_sniff(spark, sf):
    """Every part has an image and a telemetry file, every second one a label too."""
    k = F.col("p_partkey").cast("long")
    names = F.array_compact(F.array(F.format_string("d/f%d.img", k), F.when(k % 2 == 0, F.format_string("d/f%d.lbl", k)), F.format_string("d/t%d.spm", k)))
    return labels.sniff(spark.read.parquet(f"{sf}/part.parquet").select(F.explode(names).alias("path")))


@query("s21_products", """SELECT 'p' || k AS product_id, CASE WHEN k % 7 = 0 THEN 'c' ELSE 'd' END || '/p' || k || '.xml' AS path, CASE WHEN k % 5 > 0 THEN k / 4 END AS gsd_m, CASE WHEN k % 3 = 0 THEN 'h' || k END AS file_hash, 's' || k % 4 AS sensor,
concat_ws(';', CASE WHEN k % 2 > 0 THEN 'no footprint' END, CASE WHEN k % 3 > 0 THEN 'no file' END, CASE WHEN k % 5 = 0 THEN 'no ground sampling distance' END) AS warnings FROM (SELECT c_custkey::BIGINT AS k FROM customer)""")
def s21_products(spark, sf):
    """Every second product has a footprint, every third a file; every seventh has two labels, of which the first path counts."""
    c = _customers(spark, sf).withColumn("product_id", F.format_string("p%d", "k"))
    k = F.col("k")
    paths = F.array_compact(F.array(F.format_string("d/p%d.xml", k), F.when(k % 7 == 0, F.format_string("c/p%d.xml", k))))
    own = c.select("product_id", F.explode(paths).alias("path"), F.when(k % 5 > 0, k / 4).alias("gsd_m"))
    rings = c.where("k % 2 = 0").select("product_id", F.array(F.struct(F.lit(0.0).alias("lat"), k.cast("double").alias("lon"))).alias("ring"))
    hashes = c.where("k % 3 = 0").select("product_id", F.format_string("h%d", k).alias("file_hash"))
    sensors = c.select("product_id", F.format_string("s%d", k % 4).alias("sensor"))
    return labels.products(own, rings, hashes, sensors).select("product_id", "path", "gsd_m", "file_hash", "sensor", F.array_join("warnings", ";").alias("warnings"))


def _stream(spark, sf):
    """The runs as a stream over a folder of files."""
    at = new_folder(spark)
    runs = table(spark, sf, "runs").select("id", "sensor_type", "rmse")
    runs.write.parquet(at)
    return spark.readStream.schema(runs.schema).parquet(at)


@query("z1_score_stream", with_tables("runs", f"{_FLAGGED} SELECT id, sensor_type, n_prior, round(baseline_mean + 1e-9, 6) AS baseline_mean, round(baseline_std + 1e-9, 6) AS baseline_std, anomalous FROM flagged"))
def z1_score_stream(spark, sf):
    """The stream's scores are those of the batch. Runs are put in order of their times first, which are those of the ids here."""
    at = new_folder(spark)
    runs = table(spark, sf, "runs").select("id", "sensor_type", "rmse", F.timestamp_seconds("id").alias("time"))
    runs.write.parquet(f"{at}/runs")
    stream = streams.in_order(spark.readStream.schema(runs.schema).parquet(f"{at}/runs"), "time", "0 seconds")
    streams.score_to(stream, at).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return streams.scored_runs(spark, at).select("id", "sensor_type", "n_prior", _even("baseline_mean"), _even("baseline_std"), "anomalous")


@query("z2_summary_stream", with_tables("runs", "SELECT sensor_type, count(*) AS n_runs, round(avg(rmse) FILTER (NOT isnan(rmse)), 6) AS mean_rmse FROM runs GROUP BY 1"))
def z2_summary_stream(spark, sf):
    return streams.drain(streams.summary_stream(_stream(spark, sf)), "complete").select("sensor_type", "n_runs", F.round("mean_rmse", 6).alias("mean_rmse"))


@query("z4_enrich_stream", with_tables("runs", "SELECT id, id % 500 AS product_id, p_size::BIGINT AS size FROM runs LEFT JOIN part ON p_partkey = id % 500"))
def z4_enrich_stream(spark, sf):
    """Runs of products that the catalog doesn't hold stay, with nulls."""
    runs = _stream(spark, sf).select("id", (F.col("id") % 500).cast("long").alias("product_id"))
    products = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long").alias("product_id"), F.col("p_size").cast("long").alias("size"))
    return streams.drain(streams.enrich_stream(runs, products)).select("id", "product_id", "size")


# files written and read back: raw images, elevation, gazetteers, manifests, fingerprints, training labels

_IMAGE = "e AS (SELECT event_id AS i, event_id // 1000 AS k, event_id % 1000 AS o, (event_id * 7919) % 251 AS v FROM events), full_ AS (SELECT k FROM e GROUP BY 1 HAVING count(*) = 1000)"


def _event_ids(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("long").alias("i"))


@query("s1_raw_rasters", f"""WITH {_IMAGE} SELECT 'r' || k AS raster_id, (o // 500)::INTEGER AS band, (o % 500) // 50 AS "row", o % 50 AS col, v::DOUBLE AS value FROM e JOIN full_ USING (k)""")
def s1_raw_rasters(spark, sf):
    """Files of 16 bytes and two bands of 10 x 50 bytes; a file that ends early has a warning and no pixels."""
    e = _event_ids(spark, sf).select(F.floor(F.col("i") / 1000).alias("k"), "i", F.lpad(F.hex(F.col("i") * 7919 % 251), 2, "0").alias("x"))
    files = e.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    content = F.unhex(F.concat(F.lit("00" * 16), F.array_join(F.transform("p", lambda s: s["x"]), "")))
    at = new_folder(spark)
    records.write_files(files.select(F.format_string("r%d.img", "k").alias("name"), content.alias("content")), at)
    shape = {"lines": 10, "samples": 50, "bands": 2, "sample_bytes": 1, "offset": 16}
    named = files.select(F.format_string("r%d.img", "k").alias("file_name"), F.format_string("r%d", "k").alias("product_id"), *[F.lit(v).alias(n) for n, v in shape.items()], F.lit("<u1").alias("dtype"))
    return labels.tile_pixels(labels.raw_rasters(spark, at, named, tile=8)).select("raster_id", "band", F.col("row").cast("long").alias("row"), "col", "value")


@query("s9_dem_records", 'SELECT event_id // 100 AS "row", event_id % 100 AS col, ((event_id * 37) % 20001 - 10000) * 0.5::DOUBLE AS value FROM events WHERE event_id // 100 >= 7')
def s9_dem_records(spark, sf):
    """Elevation written and read as records of 100 counts of half a metre; lines from the seventh on are read."""
    e = _event_ids(spark, sf).select(F.floor(F.col("i") / 100).alias("row"), F.col("i"), ((F.col("i") * 37 % 20001 - 10000) * 0.5).alias("v"))
    lines = e.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("values"))
    at = new_folder(spark)
    records.write_records(lines, at, 100, scale=0.5)
    return labels.dem_pixels(labels.dem_records(spark, at, 100).where("row >= 7")).select("row", "col", "value")


_PLACEMARK = """<Placemark><ExtendedData><SchemaData><SimpleData name="type">%s</SimpleData><SimpleData name="clean_name">%s</SimpleData><SimpleData name="center_lat">%d</SimpleData><SimpleData name="center_lon">-%d</SimpleData>
<SimpleData name="diameter">%s</SimpleData><SimpleData name="link">http://x/%d</SimpleData></SchemaData></ExtendedData></Placemark>"""


@query("s8_gazetteer", """SELECT p_name AS name, (p_partkey % 90)::DOUBLE AS lat, ((360 - p_partkey % 180) % 360)::DOUBLE AS lon, CASE WHEN p_partkey % 5 > 0 THEN p_size::DOUBLE END AS diameter_km, 'http://x/' || p_partkey AS link, 'gazetteer' AS source FROM part WHERE p_partkey % 3 > 0""")
def s8_gazetteer(spark, sf):
    """Files of about a hundred placemarks; a third are no craters, a fifth have no diameter."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), "p_name", F.col("p_size").cast("string").alias("size"))
    mark = F.format_string(_PLACEMARK, F.when(F.col("k") % 3 > 0, "Crater, craters").otherwise("Mons"), "p_name", F.col("k") % 90, F.col("k") % 180, F.when(F.col("k") % 5 > 0, F.col("size")).otherwise("--"), "k")
    files = p.select(F.floor(F.col("k") / 100).alias("f"), mark.alias("m")).groupBy("f").agg(F.array_join(F.collect_list("m"), "").alias("m"))
    at = new_folder(spark)
    records.write_files(files.select(F.format_string("g%d.kml", "f").alias("name"), F.concat(F.lit("<kml><Document>"), "m", F.lit("</Document></kml>")).alias("content")), at)
    return labels.gazetteer_kml(spark, at)


@query("s10_manifest", "SELECT s_suppkey::BIGINT AS query, s_nationkey::BIGINT AS reference, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS note FROM supplier")
def s10_manifest(spark, sf):
    """A manifest a nation, over several lines; every second pair has a note."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("query"), F.col("s_nationkey").cast("long").alias("reference"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("note"))
    text = F.to_json(F.struct(F.collect_list(F.struct("query", "reference", "note")).alias("pairs")), {"pretty": "true"})
    at = new_folder(spark)
    records.write_files(s.groupBy("reference").agg(text.alias("content")).select(F.format_string("m%d.json", "reference").alias("name"), "content"), at)
    return labels.manifest(spark, at).select("query", "reference", "note")


@query("s18_fingerprints", "SELECT 'f' || s_suppkey AS file, substr(sha1(left(t, 1048576) || length(t)), 1, 16) AS file_hash FROM (SELECT s_suppkey, repeat(s_name, CASE WHEN s_suppkey % 10 = 0 THEN 70000 ELSE s_suppkey % 50 END::INTEGER) AS t FROM supplier)")
def s18_fingerprints(spark, sf):
    """Every tenth file is longer than the megabyte that counts."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    times = F.when(F.col("k") % 10 == 0, 70_000).otherwise(F.col("k") % 50).cast("int")
    at = new_folder(spark)
    records.write_files(s.select(F.format_string("f%d.img", "k").alias("name"), F.repeat("s_name", times).alias("content")), at)
    return labels.fingerprints(spark, at).select(F.regexp_extract("path", r"([^/]+)\.img$", 1).alias("file"), "file_hash")


@query("s14_label_files", "SELECT 'i' || l_suppkey AS file, count(*) AS n, sum(l_linenumber)::DOUBLE AS total FROM lineitem GROUP BY 1")
def s14_label_files(spark, sf):
    """A label file an image, written and read back."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.format_string("i%d", F.col("l_suppkey").cast("long")).alias("image_id"), F.format_string("0 %.6f 0 0 0", F.col("l_linenumber").cast("double")).alias("line"))
    at = new_folder(spark)
    detections.write_training_labels(li, at)
    back = spark.read.text(at).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("file"), F.split("value", " ")[1].cast("double").alias("v"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
