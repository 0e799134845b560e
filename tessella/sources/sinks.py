"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_match_points(points: DataFrame, path: str, form: str = "csv", by_run: bool = False) -> None:
    """Match points as CSV with a header or as JSON lines. Files hold runs one after another, ``run_id`` a column, so their number grows with
    the bytes and not with the runs. ``by_run``: one folder a run, for as many runs as a file system likes to list. Rows are dealt by run
    first, so a run is in one file, or in few; a large run is split."""
    dealt = points.hint("rebalance", "run_id")
    w = dealt.write.partitionBy("run_id") if by_run else dealt.sortWithinPartitions("run_id").write
    w.option("header", "true").csv(path) if form == "csv" else w.json(path)


def run_documents(results: DataFrame) -> DataFrame:
    """Each run's nested result as one JSON text."""
    return results.select("run_id", F.to_json(F.struct(*[c for c in results.columns if c != "run_id"])).alias("result_json"))


def geojson(cells: DataFrame, properties: list[str]) -> DataFrame:
    """Boxes as closed GeoJSON polygons, longitude first."""
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(corner("lon0", "lat0"), corner("lon1", "lat0"), corner("lon1", "lat1"), corner("lon0", "lat1"), corner("lon0", "lat0"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    tiles.write.partitionBy("raster_id").parquet(path)
