"""Readers of product labels, footprints, telemetry, catalogs and raw rasters."""

from __future__ import annotations

from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.geo import lon360
from tessella.functions.text import parse_time, sample_dtype, stem
from tessella.sources.records import place, read_records

#: Telemetry line tag, tokens a line has at least, kilometres of a raw DEM count.
TELEMETRY_TAG, TELEMETRY_TOKENS = "ORBTATTD", 19


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _open(path: str):
    system, at = place(path)
    return system.open_input_file(at)


def heads(spark: SparkSession, path: str, head: int) -> DataFrame:
    """``(path, length, head)``: the first ``head`` bytes of files of any size; no more is read. Paths must be of a file system of Arrow."""

    def read(batches):
        for batch in batches:
            for i, p in enumerate(batch.column("path").to_pylist()):
                with _open(p) as f:
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([f.read(head)], pa.binary())], ["path", "length", "head"])

    return _listing(spark, path).mapInArrow(read, "path string, length long, head binary")


def pds4_labels(spark: SparkSession, path: str) -> DataFrame:
    return pds4_fields(_texts(spark, path))


#: Elements of an XML label that are read, and the axes of its array.
_ELEMENTS = (
    "start_date_time", "stop_date_time", "file_name", "offset", "data_type", "spacecraft_altitude", "pixel_resolution", "sun_azimuth", "sun_elevation", "solar_incidence", "md5_checksum",
    *(f"{k}_{c}" for k in ("upper_left", "upper_right", "lower_left", "lower_right") for c in ("latitude", "longitude")),
)
_AXES = ("Line", "Sample", "Band")


def label_values(text: str | None) -> dict[str, str]:
    """The text of the first element of each name, whatever its prefix, and the elements of each axis, from one pass over a label."""
    found: dict[str, str] = {}
    if text is None:
        return found
    names = {*_ELEMENTS}
    for e in ElementTree.fromstring(text).iter():
        name = e.tag.rpartition("}")[2]
        if name in names and name not in found:
            found[name] = "".join(e.itertext())
        elif name == "Axis_Array":
            parts = [(c.tag.rpartition("}")[2], "".join(c.itertext())) for c in e]
            size = next((v for n, v in parts if n == "elements"), None)
            for n, v in parts:
                if n == "axis_name" and v in _AXES and size is not None:
                    found.setdefault(v, size)
    return found


@F.pandas_udf(StructType([StructField(k, StringType()) for k in (*_ELEMENTS, *_AXES)]))
def _label_parts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([label_values(t) for t in texts], columns=[*_ELEMENTS, *_AXES], dtype=object)


def pds4_fields(t: DataFrame) -> DataFrame:
    """Times, geometry, array shape and file name of XML labels ``(path, value)``. Each label is parsed once."""
    t = t.select("path", _label_parts("value").alias("__x"))
    x = lambda name: F.nullif(F.trim(F.col("__x")[name]), F.lit(""))
    num = lambda name: x(name).try_cast("double")
    axis = lambda name: F.col("__x")[name].try_cast("int")
    corner = lambda k: F.struct(num(f"{k}_latitude").alias("lat"), lon360(num(f"{k}_longitude")).alias("lon"))
    corners = F.array(*[corner(k) for k in ("upper_left", "upper_right", "lower_left", "lower_right")])
    return t.select(
        "path", stem("path").alias("product_id"), parse_time(x("start_date_time")).alias("start"), parse_time(x("stop_date_time")).alias("stop"), x("file_name").alias("file_name"),
        x("offset").try_cast("long").alias("offset"), x("data_type").alias("sample_type"), axis("Line").alias("lines"), axis("Sample").alias("samples"), axis("Band").alias("bands"),
        num("spacecraft_altitude").alias("altitude_km"), num("pixel_resolution").alias("gsd_m"), num("sun_azimuth").alias("sun_azimuth"), num("sun_elevation").alias("sun_elevation"),
        num("solar_incidence").alias("solar_incidence"), F.when(num("upper_left_latitude").isNotNull(), corners).alias("corners"), x("md5_checksum").alias("md5"),
    )


def pds3_labels(spark: SparkSession, path: str, head: int = 65_536) -> DataFrame:
    """Keyword labels, attached or detached, from the first ``head`` bytes of the files."""
    return pds3_fields(heads(spark, path, head).select("path", F.decode("head", "ISO-8859-1").alias("value")))


def pds3_fields(t: DataFrame) -> DataFrame:
    """Fields of keyword labels ``(path, value)``. The image pointer may be a record number, a byte offset, or a file with either; it becomes a byte offset."""
    key = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?m)^\s*{k}\s*=\s*([^\r\n]+)", 1), '"', "")), F.lit(""))
    num = lambda k: F.regexp_extract(key(k), r"([-+]?[0-9.]+)", 1).try_cast("double")
    t = t.withColumn("pointer", key(r"\^IMAGE")).withColumn("rec", num("RECORD_BYTES").cast("long"))
    file = F.nullif(F.regexp_extract("pointer", r"\(?\s*([A-Za-z][^,)\s]*)", 1), F.lit(""))
    at = F.regexp_extract("pointer", r"([0-9]+)\s*(?:<BYTES>)?\s*\)?\s*$", 1).try_cast("long")
    in_bytes = F.contains("pointer", F.lit("<BYTES>"))
    offset = F.when(at.isNull(), 0).when(in_bytes, at - 1).otherwise((at - 1) * F.col("rec"))
    kind = sample_dtype(key("SAMPLE_TYPE"), num("SAMPLE_BITS").cast("int"))
    return t.select(
        "path", stem("path").alias("product_id"), num("LINES").cast("int").alias("lines"), num("LINE_SAMPLES").cast("int").alias("samples"), F.coalesce(num("BANDS").cast("int"), F.lit(1)).alias("bands"),
        kind["dtype"].alias("dtype"), kind["bytes"].alias("sample_bytes"), kind["warning"].alias("warning"), file.alias("file_name"), offset.cast("long").alias("offset"),
        parse_time(key("START_TIME")).alias("start"), num("ORBIT_NUMBER").cast("int").alias("orbit"), key("MD5_CHECKSUM").alias("md5"),
    )


def footprint_kml(spark: SparkSession, path: str) -> DataFrame:
    return footprint_rings(_texts(spark, path))


def footprint_rings(t: DataFrame) -> DataFrame:
    """Ring and centre of footprint texts ``(path, value)``; longitudes as 0-360."""
    coords = lambda where: F.split(F.trim(F.xpath_string("value", F.lit(where))), r"\s+")
    point = lambda c: F.struct(F.split(c, ",")[1].cast("double").alias("lat"), lon360(F.split(c, ",")[0].cast("double")).alias("lon"))
    ring, centre = coords("//*[local-name()='LinearRing']/*[local-name()='coordinates']"), coords("//*[local-name()='Point']/*[local-name()='coordinates']")
    return t.select("path", stem("path").alias("product_id"), F.transform(ring, point).alias("ring"), F.when(F.length(centre[0]) > 0, point(centre[0])).alias("centre"))


def geometry_grid(spark: SparkSession, path: str) -> DataFrame:
    g = spark.read.csv(path, header=True, schema="Longitude double, Latitude double, Scan int, Pixel int")
    return g.select(stem(F.col("_metadata.file_name")).alias("product_id"), F.col("Scan").alias("scan"), F.col("Pixel").alias("pixel"), lon360("Longitude").alias("lon"), F.col("Latitude").alias("lat"))


def telemetry(lines: DataFrame) -> DataFrame:
    """Records of telemetry text ``(product_id, value)``: tagged lines of enough tokens; the year is the end of the third token. Positions and velocities that don't parse are null."""
    t = lines.withColumn("k", F.split(F.trim("value"), r"\s+")).where((F.size("k") >= TELEMETRY_TOKENS) & (F.col("k")[0] == TELEMETRY_TAG))
    tok = lambda i: F.col("k")[i]
    num = lambda i: tok(i).try_cast("double")
    year = F.right(tok(2), F.lit(4)).try_cast("int")
    sec = num(7) + F.coalesce(num(8), F.lit(0.0)) / 1000
    ts = F.make_timestamp(year, tok(3).try_cast("int"), tok(4).try_cast("int"), tok(5).try_cast("int"), tok(6).try_cast("int"), sec.cast("decimal(8,6)"))
    triple = lambda a: F.when(num(a).isNotNull() & num(a + 1).isNotNull() & num(a + 2).isNotNull(), F.array(num(a), num(a + 1), num(a + 2)))
    return t.select("product_id", tok(1).try_cast("long").alias("record_num"), ts.alias("ts"), triple(9).alias("pos"), triple(12).alias("vel"), num(15).alias("phase"), num(16).alias("aspect"), num(17).alias("azimuth"), num(18).alias("elevation"))


def telemetry_files(spark: SparkSession, path: str) -> DataFrame:
    return telemetry(spark.read.text(path).select("value", stem(F.col("_metadata.file_name")).alias("product_id")))


def crater_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows whose position and diameter all parse."""
    c = spark.read.csv(path, header=True)
    num = lambda k: F.col(k).try_cast("double")
    out = c.select(F.col("CRATER_ID").alias("crater_id"), num("LAT_CIRC_IMG").alias("lat"), lon360(num("LON_CIRC_IMG")).alias("lon"), num("DIAM_CIRC_IMG").alias("diameter_km"), F.lit("catalog").alias("source"))
    return out.dropna(subset=["lat", "lon", "diameter_km"])


def gazetteer_kml(spark: SparkSession, path: str) -> DataFrame:
    """Named craters of a placemark file; a missing diameter is null."""
    p = spark.read.format("xml").option("rowTag", "Placemark").schema("ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>").load(path)
    m = F.map_from_entries(F.transform("ExtendedData.SchemaData.SimpleData", lambda s: F.struct(s["_name"], s["_VALUE"])))
    g = p.select(m.alias("m"))
    f = lambda k: F.try_element_at("m", F.lit(k))
    return g.where(F.startswith(f("type"), F.lit("Crater"))).select(
        f("clean_name").alias("name"), f("center_lat").try_cast("double").alias("lat"), lon360(f("center_lon").try_cast("double")).alias("lon"), f("diameter").try_cast("double").alias("diameter_km"), f("link").alias("link"), F.lit("gazetteer").alias("source")
    )


def dem_records(spark: SparkSession, path: str, columns: int, scale: float = 0.5) -> DataFrame:
    """Fixed-record little-endian 16-bit elevation: one row a line, read by ranges of lines; conditions on ``row`` reach the files."""
    return read_records(spark, path, columns, "<i2", scale)


def dem_pixels(dem: DataFrame) -> DataFrame:
    return dem.select(F.lit(0).cast("long").alias("raster_id"), "row", F.posexplode("values").alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def raw_rasters(spark: SparkSession, path: str, labels: DataFrame, tile: int = 512) -> DataFrame:
    """Raw images to tiles ``(product_id, band, tile_row, tile_col, row0, col0, h, w, values, warning)`` by their labels
    ``(file_name, product_id, lines, samples, bands, dtype, sample_bytes, offset)``; short files give a warning row and no tile.

    Every strip of ``tile`` lines of a band is read on its own at its place in the file, so files may be of any size and one file
    is read by many tasks. Paths must be of a file system of Arrow."""
    shape = ["lines", "samples", "bands", "dtype", "sample_bytes", "offset"]
    files = _listing(spark, path).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    both = files.join(labels.select("file_name", F.col("product_id").cast("string").alias("product_id"), *shape).hint("merge"), "file_name")
    need = F.col("offset") + F.col("lines").cast("long") * F.col("samples") * F.col("bands") * F.col("sample_bytes")
    both = both.withColumn("need", need)
    strips = both.where("length >= need and lines > 0 and samples > 0 and bands > 0").select("path", "product_id", *shape, F.explode(F.expr("sequence(0, bands - 1)")).alias("band"))
    strips = strips.select("*", F.explode(F.expr(f"sequence(0, int((lines - 1) div {tile}))")).alias("tile_row")).repartition("path", "band", "tile_row")

    def cut(batches):
        names = ["product_id", "band", "tile_row", "tile_col", "row0", "col0", "h", "w", "values", "warning"]
        for pdf in batches:
            for r in pdf.itertuples():
                i, h, line = r.tile_row * tile, min(tile, r.lines - r.tile_row * tile), r.samples * r.sample_bytes
                with _open(r.path) as f:
                    f.seek(r.offset + (r.band * r.lines + i) * line)
                    strip = np.frombuffer(f.read(h * line), r.dtype).reshape(h, r.samples)
                out = []
                for j in range(0, r.samples, tile):
                    a = strip[:, j : j + tile]
                    out.append((r.product_id, r.band, r.tile_row, j // tile, i, j, h, a.shape[1], a.astype(float).ravel().tolist(), None))
                yield pd.DataFrame(out, columns=names)

    tiles = strips.mapInPandas(cut, "product_id string, band int, tile_row int, tile_col int, row0 int, col0 int, h int, w int, values array<double>, warning string")
    short = both.where("length < need").select("product_id", F.format_string("file has %d bytes, %d needed", "length", "need").alias("warning"))
    return tiles.unionByName(short, allowMissingColumns=True)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """Tiles to pixels per band."""
    t = tiles.where("values is not null").select("product_id", "band", "row0", "col0", "w", F.posexplode("values").alias("i", "value"))
    return t.select(F.col("product_id").alias("raster_id"), "band", (F.col("row0") + F.expr("i div w")).alias("row"), (F.col("col0") + F.col("i") % F.col("w")).cast("long").alias("col"), "value")


def fingerprints(spark: SparkSession, path: str, head: int = 1 << 20) -> DataFrame:
    """16 characters of the SHA-1 of a file's first megabyte and its size."""
    return heads(spark, path, head).select("path", F.substring(F.sha1(F.concat("head", F.encode(F.col("length").cast("string"), "UTF-8"))), 1, 16).alias("file_hash"))


def manifest(spark: SparkSession, path: str, root: str = "pairs") -> DataFrame:
    """Rows of the array at ``root`` of a JSON manifest."""
    return spark.read.json(path, multiLine=True).select(F.explode(root).alias("r")).select("r.*")


def sniff(listing: DataFrame) -> DataFrame:
    """Which reader each listed file needs; a label of the same name makes a raw file a detached one."""
    from tessella.functions.text import reader_for

    own = listing.withColumn("stem", stem("path"))
    label = own.where(F.lower("path").rlike(r"\.(lbl|xml)$")).select("stem").distinct().withColumn("has", F.lit(True))
    return own.join(label.hint("merge"), "stem", "left").select("path", reader_for("path", F.coalesce("has", F.lit(False))).alias("reader"))


def reject_camera_files(meta: DataFrame) -> DataFrame:
    """Rows without camera tags (maker, model, position, time taken) in their metadata map."""
    tags = F.array(*[F.lit(str(t)) for t in (271, 272, 34853, 36867)])
    return meta.where(F.col("exif").isNull() | ~F.arrays_overlap(F.map_keys("exif"), tags))


def products(labels: DataFrame, rings: DataFrame, hashes: DataFrame, sensors: DataFrame) -> DataFrame:
    """One record a product: label, footprint, file hash and sensor, and a warning for each part that is missing."""
    out = labels
    for part in (rings.select("product_id", "ring"), hashes, sensors):
        out = out.join(part.hint("merge"), "product_id", "left")
    warn = F.array_compact(F.array(F.when(F.col("ring").isNull(), F.lit("no footprint")), F.when(F.col("file_hash").isNull(), F.lit("no file")), F.when(F.col("gsd_m").isNull(), F.lit("no ground sampling distance"))))
    first = F.row_number().over(Window.partitionBy("product_id").orderBy("path"))
    return out.withColumn("warnings", warn).withColumn("__r", first).where("__r = 1").drop("__r")
