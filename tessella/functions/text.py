"""Column functions on names, paths, labels and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geo import col

#: Fixed values, in order of precedence.
SENSORS = ("ohrc", "tmc", "iirs", "nac")
#: Fixed values: (sample type, bits) -> (array type, bytes a sample). Types of 8 bits are unsigned whatever the label says.
SAMPLE_TYPES = {
    ("UNSIGNED_INTEGER", 8): ("<u1", 1),
    ("MSB_UNSIGNED_INTEGER", 8): ("<u1", 1),
    ("LSB_UNSIGNED_INTEGER", 8): ("<u1", 1),
    ("INTEGER", 8): ("<u1", 1),
    ("MSB_INTEGER", 8): ("<u1", 1),
    ("LSB_INTEGER", 8): ("<u1", 1),
    ("UNSIGNED_INTEGER", 16): (">u2", 2),
    ("MSB_UNSIGNED_INTEGER", 16): (">u2", 2),
    ("LSB_UNSIGNED_INTEGER", 16): ("<u2", 2),
    ("INTEGER", 16): (">i2", 2),
    ("MSB_INTEGER", 16): (">i2", 2),
    ("LSB_INTEGER", 16): ("<i2", 2),
    ("IEEE_REAL", 32): (">f4", 4),
    ("PC_REAL", 32): ("<f4", 4),
    ("UnsignedByte", 8): ("<u1", 1),
    ("UnsignedLSB2", 16): ("<u2", 2),
    ("UnsignedMSB2", 16): (">u2", 2),
    ("SignedLSB2", 16): ("<i2", 2),
    ("SignedMSB2", 16): (">i2", 2),
    ("IEEE754LSBSingle", 32): ("<f4", 4),
    ("IEEE754MSBSingle", 32): (">f4", 4),
}


def sensor_of(path) -> Column:
    """The first sensor named in a path's last part, else unknown."""
    base = F.lower(F.element_at(F.split(col(path), "/"), -1))
    out = F.when(F.contains(base, F.lit(SENSORS[0])), SENSORS[0])
    for s in SENSORS[1:]:
        out = out.when(F.contains(base, F.lit(s)), s)
    return out.otherwise("unknown")


def sample_dtype(kind, bits) -> Column:
    """(dtype, bytes, warning) for a label's sample type and bits."""
    out, warn = F.lit(None).cast("struct<dtype:string,bytes:int>"), F.lit(None).cast("string")
    for (t, b), (d, n) in reversed(list(SAMPLE_TYPES.items())):
        out = F.when((col(kind) == t) & (col(bits) == b), F.struct(F.lit(d).alias("dtype"), F.lit(n).alias("bytes"))).otherwise(out)
    signed = (col(bits) == 8) & ~F.contains(F.upper(col(kind)), F.lit("UNSIGNED"))
    warn = F.when(out.isNull(), F.concat(F.lit("unsupported sample type "), col(kind))).when(signed, F.lit("8-bit samples read as unsigned")).otherwise(warn)
    return F.struct(out["dtype"].alias("dtype"), out["bytes"].alias("bytes"), warn.alias("warning"))


def parse_time(text) -> Column:
    """An ISO time with or without an offset (none: UTC); null if it doesn't parse."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(text)), "Z$", "+00:00"))


def leading_number(text) -> Column:
    """12.5 of '12.5 km'."""
    return F.regexp_extract(col(text), r"([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def wkt_point(text) -> Column:
    """(lon, lat) of 'POINT (lon lat)'."""
    part = lambda i: F.regexp_extract(col(text), r"(?i)POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)", i).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("lon"), part(2).alias("lat")))


def lonlat_pair(text) -> Column:
    """(lon, lat) of 'lon,lat'."""
    p = F.split(F.trim(col(text)), r"\s*,\s*")
    lon, lat = F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def stem(path) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def pair_key(prefix: str, src, ref, ts) -> Column:
    """prefix_src_x_ref_yyyymmdd, with unknown for what is missing."""
    part = lambda c: F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("unknown"))
    return F.concat_ws("_", F.lit(prefix), part(src), F.lit("x"), part(ref), F.coalesce(F.date_format(col(ts), "yyyyMMdd"), F.lit("undated")))


def reader_for(path, has_label) -> Column:
    """Which reader an image file needs, by its extension and whether a label of its name lies beside it."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext == "xml", "pds4_label").when(ext == "lbl", "pds3_label").when(ext.isin("img", "dat", "raw", "qub"), F.when(col(has_label), "raw_detached").otherwise("raw_attached"))
        .when(ext.isin("tif", "tiff", "png", "jpg", "jpeg"), "codec").when(ext == "kml", "footprint").when(ext == "csv", "table").when(ext == "spm", "telemetry").otherwise("unknown")
    )
