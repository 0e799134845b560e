"""Crater catalogs against footprints and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geo import KM_PER_DEG, haversine_km, lon_cell, lon_cells, lon_end, near_lon


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Several catalogs one after the other, never de-duplicated; what one lacks is null."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def bbox(catalog: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float) -> DataFrame:
    """Closed box in 0-360 longitudes; a filter that reaches the Parquet scan."""
    if lon0 > lon1 or lat0 > lat1:
        raise ValueError("box limits out of order")
    return catalog.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))


def status(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("source").agg(F.count("*").alias("n"))


def _cells(lo, hi, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 3.0, boundary: str = "closed", how: str = "inner") -> DataFrame:
    """Points in the lon0/lon1/lat0/lat1 boxes: boxes are spread over degree cells, points have one, so the range join is an
    equi-join on cells that Spark shuffles and splits by itself. ``boundary``: closed, half_open or interior. With ``how``
    left, boxes without a point stay, with nulls.

    Cells are counted modulo 360, so boxes may lie over 0/360 (lon1 past 360, lon0 below 0, or lon1 below lon0) and meet each
    point once; ``lon_in`` is the point's longitude by whole turns inside its box."""
    ends = {"closed": (">=", "<="), "half_open": (">=", "<"), "interior": (">", "<")}[boundary]
    spread = boxes.select("*", _cells("lat0", "lat1", cell).alias("cell_y")).select("*", F.explode(lon_cells("lon0", "lon1", cell)).alias("cell_x"))
    p = points.withColumn("cell_x", lon_cell("lon", cell)).withColumn("cell_y", F.floor(F.col("lat") / cell))
    east = lon_end("lon0", "lon1")
    hits = spread.hint("merge").join(p, ["cell_x", "cell_y"]).withColumn("lon_in", near_lon("lon", (F.col("lon0") + east) / 2)).withColumn("__east", east)
    inside = F.expr(f"lon_in {ends[0]} lon0 and lon_in {ends[1]} __east and lat {ends[0]} lat0 and lat {ends[1]} lat1")
    hits = hits.where(inside).drop("cell_x", "cell_y", "__east")
    if how == "inner":
        return hits
    missing = boxes.join(hits.select(*boxes.columns).distinct().hint("merge"), boxes.columns, "left_anti")
    return hits.unionByName(missing, allowMissingColumns=True)


def places(points: DataFrame, *values: str) -> DataFrame:
    """Points of one place (and of equal ``values``) as one row with their number ``n_here``."""
    return points.groupBy("lon", "lat", *values).agg(F.count("*").alias("n_here"))


def each_in_boxes(points: DataFrame, boxes: DataFrame, boundary: str = "closed", **worked: Column) -> DataFrame:
    """A row a pair of a point and a box it lies in, as :func:`in_boxes` gives them, with the columns ``worked``. Which places lie in
    which boxes, and ``worked``, which may use the place, ``lon_in`` and the limits only, are found once for all points of a place
    and all equal boxes; the pairs then come from joins on equal keys, so the work beyond that is the rows of the result."""
    limits = ["lon0", "lon1", "lat0", "lat1"]
    hits = in_boxes(places(points).drop("n_here"), boxes.select(*limits).distinct(), boundary=boundary)
    hits = hits.select("lon", "lat", *limits, "lon_in", *[c.alias(name) for name, c in worked.items()])
    return points.hint("merge").join(hits, ["lon", "lat"]).hint("merge").join(boxes, limits)


def alike(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with equal boxes as one: ``(product_id, like)``, the least id of those with the same boxes, and the boxes of the
    products that stand for others. What is counted for those holds for all, so work doesn't grow with footprints that lie alike."""
    limits = ["lon0", "lon1", "lat0", "lat1"]
    own = boxes.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(*limits))).alias("__boxes"))
    first = own.groupBy("__boxes").agg(F.min("product_id").alias("like"))
    return own.join(first.hint("merge"), "__boxes").select("product_id", "like"), first.select(F.col("like").alias("product_id"), F.inline("__boxes"))


def _for_all(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("product_id", "like").hint("merge"), "like").select("product_id", *[c for c in found.columns if c != "product_id"])


def count_in_boxes(points: DataFrame, boxes: DataFrame, boundary: str = "closed") -> DataFrame:
    """``(product_id, n)``: points in each box that has any."""
    members, shapes = alike(boxes)
    return _for_all(members, in_boxes(places(points), shapes, boundary=boundary).groupBy("product_id").agg(F.sum("n_here").alias("n")))


def grid_of(footprints: DataFrame, n: int = 3) -> DataFrame:
    """``n`` x ``n`` cells of each footprint box with their area."""
    at = footprints.select("product_id", F.col("lat0").alias("y"), F.col("lon0").alias("x"), ((F.col("lat1") - F.col("lat0")) / n).alias("dy"), ((lon_end("lon0", "lon1") - F.col("lon0")) / n).alias("dx"))
    rows = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    cells = rows.select(
        "product_id", "r", "k", (F.col("y") + F.col("r") * F.col("dy")).alias("lat0"), (F.col("y") + (F.col("r") + 1) * F.col("dy")).alias("lat1"),
        (F.col("x") + F.col("k") * F.col("dx")).alias("lon0"), (F.col("x") + (F.col("k") + 1) * F.col("dx")).alias("lon1"),
    )
    area = F.abs((F.col("lat1") - F.col("lat0")) * (F.col("lon1") - F.col("lon0"))) * KM_PER_DEG**2 * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    return cells.withColumn("area_km2", area)


def roughness(craters: DataFrame, footprints: DataFrame, n: int = 3, boundary: str = "half_open") -> DataFrame:
    """Per grid cell: craters inside, the sum of squared diameters, and that over the cell's area. Empty cells stay with 0;
    craters without a diameter don't count."""
    cells, (members, shapes) = grid_of(footprints, n), alike(footprints)
    at = places(craters.where("diameter_km is not null").withColumn("square", F.col("diameter_km") * F.col("diameter_km")), "square")
    hits = in_boxes(at, grid_of(shapes, n), boundary=boundary)
    keys = ["product_id", "r", "k"]
    sums = _for_all(members, hits.groupBy(*keys).agg(F.sum("n_here").alias("n"), F.sum(F.col("square") * F.col("n_here")).alias("weight")))
    out = cells.select(*keys, "area_km2").join(sums.hint("merge"), keys, "left")
    weight = F.coalesce("weight", F.lit(0.0))
    return out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), weight.alias("weight"), (weight / F.col("area_km2")).alias("score"))


def density(craters: DataFrame, footprints: DataFrame, n: int = 12) -> DataFrame:
    """Counts over an n x n grid of each box; the last row and column are closed."""
    members, shapes = alike(footprints)
    hits = in_boxes(places(craters), shapes).withColumn("lon1", lon_end("lon0", "lon1"))
    bin_of = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / n)), F.lit(n - 1))
    bins = hits.groupBy("product_id", bin_of("lat", "lat0", "lat1").alias("r"), bin_of("lon_in", "lon0", "lon1").alias("k"))
    return _for_all(members, bins.agg(F.sum("n_here").alias("n")))


def diameter_histogram(craters: DataFrame, footprints: DataFrame) -> DataFrame:
    """Per footprint, min(20, max(5, n / 3)) equal bins from the least to the largest diameter; the last is closed."""
    members, shapes = alike(footprints)
    hits = in_boxes(places(craters.where("diameter_km is not null"), "diameter_km"), shapes)
    stats = hits.groupBy("product_id").agg(F.min("diameter_km").alias("lo"), F.max("diameter_km").alias("hi"), F.sum("n_here").alias("total"))
    bins = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("total") / 3)))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("diameter_km") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1)).otherwise(0)
    joined = hits.select("product_id", "diameter_km", "n_here").join(stats.withColumn("bins", bins).hint("merge"), "product_id")
    return _for_all(members, joined.groupBy("product_id", "bins", at.cast("long").alias("bin")).agg(F.sum("n_here").alias("n")))


def footprint_stats(craters: DataFrame, footprints: DataFrame) -> DataFrame:
    """Count, diameters and density of craters in each box; boxes without one stay."""
    members, shapes = alike(footprints)
    hits = in_boxes(places(craters, "diameter_km"), shapes)
    known = F.when(F.col("diameter_km").isNotNull(), F.col("n_here"))
    sums = hits.groupBy("product_id").agg(
        F.sum("n_here").alias("n"), F.min("diameter_km").alias("min_d"), F.max("diameter_km").alias("max_d"), (F.sum(F.col("diameter_km") * known) / F.sum(known)).alias("mean_d")
    )
    area = (lon_end("lon0", "lon1") - F.col("lon0")) * (F.col("lat1") - F.col("lat0")) * KM_PER_DEG**2 * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return footprints.select("product_id", area.alias("area_km2")).join(_for_all(members, sums).hint("merge"), "product_id", "left").select("product_id", "area_km2", n.alias("n"), "min_d", "max_d", "mean_d", (n / F.col("area_km2")).alias("density"))


def top_named(features: DataFrame, footprints: DataFrame, limit: int = 20) -> DataFrame:
    """The largest named features of each box, without a diameter last, and how many there are in all."""
    hits = in_boxes(features, footprints)
    order = Window.partitionBy("product_id").orderBy(F.coalesce("diameter_km", F.lit(0.0)).desc(), "feature_id")
    counts = hits.groupBy("product_id").agg(F.count("*").alias("total"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).join(counts.hint("merge"), "product_id")


def nearest_feature(points: DataFrame, features: DataFrame, half_span: float = 5.0) -> DataFrame:
    """For each point, the nearest feature within +-half_span degrees in both directions, by great-circle distance; ties to
    the smaller id; none: nulls and available false. Longitudes meet across 0/360. Points of one place ask once, and of
    features of one place only the least id counts."""
    size = half_span
    around = int(360 / size)
    p = points.select(F.col("lon").alias("px"), F.col("lat").alias("py")).distinct()
    features = features.groupBy("lon", "lat").agg(F.min(F.struct("feature_id", "name")).alias("f")).select("f.*", "lon", "lat")
    near = p.select("*", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("i")).select("*", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("j"))
    near = near.select("px", "py", F.pmod(F.floor(F.col("px") / size) + F.col("i"), F.lit(around)).alias("cell_x"), (F.floor(F.col("py") / size) + F.col("j")).alias("cell_y"))
    f = features.select("feature_id", "name", "lon", "lat", F.pmod(F.floor(F.col("lon") / size), F.lit(around)).alias("cell_x"), F.floor(F.col("lat") / size).alias("cell_y"))
    hits = near.hint("merge").join(f, ["cell_x", "cell_y"])
    apart = F.abs(F.pmod(F.col("lon") - F.col("px") + 180, F.lit(360.0)) - 180)
    hits = hits.where((apart <= half_span) & (F.abs(F.col("lat") - F.col("py")) <= half_span)).withColumn("km", haversine_km("py", "px", "lat", "lon"))
    best = hits.groupBy("px", "py").agg(F.min(F.struct("km", "feature_id", "name")).alias("b"))
    return points.select("point_id", F.col("lon").alias("px"), F.col("lat").alias("py")).join(best.hint("merge"), ["px", "py"], "left").select("point_id", F.col("b.feature_id").alias("feature_id"), F.col("b.name").alias("name"), F.col("b.km").alias("km"), F.col("b").isNotNull().alias("available"))


def candidates(features: DataFrame, massifs: DataFrame, least_km: float = 50.0) -> DataFrame:
    """Places worth a closer look: named craters of at least ``least_km``, and massifs, which have no diameter."""
    large = features.where(F.col("name").isNotNull() & (F.col("diameter_km") >= least_km)).withColumn("kind", F.lit("crater"))
    return large.unionByName(massifs.withColumn("kind", F.lit("massif")), allowMissingColumns=True).select("kind", "name", "lat", "lon", "diameter_km")


def allowed(rows: DataFrame, allow_list: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows whose id is on a list."""
    return rows.join(allow_list.select(key).distinct().hint("merge"), key, "left_semi")


def in_reading_order(cells: DataFrame, keys: tuple = ("row", "col")) -> DataFrame:
    """Cells row by row: a range-partitioned sort."""
    return cells.orderBy(*keys)


def replace_sources(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Results of re-run sources replace the old ones; others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
