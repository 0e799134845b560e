"""Raster jobs on pixel tables ``(raster_id, row, col, value)``.

Neighbourhoods are worked on as array tiles with borders (:mod:`tessella.operators.tiles`), so rasters of any number and size
spread over tasks. Sums over rows and columns run in two levels, blocks first, so no task needs a whole line of a raster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.transforms import inverse
from tessella.operators import tiles
from tessella.operators.graph import connected_components
from tessella.operators.order import quantiles
from tessella.session import Tables

KEY = ["raster_id", "row", "col"]


def stretch_bounds(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Exact percentiles per raster, of one raster in many tasks."""
    return quantiles(pixels, ["raster_id"], "value", [low, high]).select("raster_id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def adaptive_bounds(pixels: DataFrame, low: float = 0.02, high: float = 0.98, spread: float = 3.0) -> DataFrame:
    """Median +- spread times the interquartile range, within the low and high percentiles; the percentiles alone without a
    range, the extremes if that leaves nothing."""
    p = quantiles(pixels, ["raster_id"], "value", [low, 0.25, 0.5, 0.75, high, 0.0, 1.0]).withColumns({"least": F.col("p")[5], "most": F.col("p")[6]})
    iqr, mid = F.col("p")[3] - F.col("p")[1], F.col("p")[2]
    lo = F.when(iqr <= 0, F.col("p")[0]).otherwise(F.greatest(F.col("p")[0], mid - spread * iqr))
    hi = F.when(iqr <= 0, F.col("p")[4]).otherwise(F.least(F.col("p")[4], mid + spread * iqr))
    most = F.when(F.col("most") == 0, 1.0).otherwise(F.col("most"))
    return p.select("raster_id", F.when(hi <= lo, F.col("least")).otherwise(lo).alias("lo"), F.when(hi <= lo, most).otherwise(hi).alias("hi"), lo.alias("dark"))


def stretch(pixels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Linear stretch between bounds to 0-255, cut to whole numbers."""
    j = pixels.join(bounds.select("raster_id", "lo", "hi"), "raster_id")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))))
    return j.select(*KEY, F.floor(t * 255).cast("int").alias("value"))


def shadow_mask(pixels: DataFrame) -> DataFrame:
    """Pixels below the dark end of the adaptive bounds."""
    b = adaptive_bounds(pixels).select("raster_id", F.col("dark").alias("threshold"))
    return pixels.join(b, "raster_id").select(*KEY, "threshold", (F.col("value") < F.col("threshold")).alias("shadow"))


def shadow_summary(mask: DataFrame) -> DataFrame:
    return mask.groupBy("raster_id").agg(F.first("threshold").alias("threshold"), F.count_if("shadow").alias("n_shadow"), F.avg(F.col("shadow").cast("double")).alias("fraction"))


def contrast_recovery(before: DataFrame, after: DataFrame) -> DataFrame:
    s = lambda df, n: df.groupBy("raster_id").agg(F.stddev_pop("value").alias(n))
    return s(before, "b").join(s(after, "a"), "raster_id").select("raster_id", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(1.0).alias("recovery"))


def block_mean(pixels: DataFrame, factor: int) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return pixels.groupBy("raster_id", at("row"), at("col")).agg(F.avg("value").alias("value"))


def pyramid(pixels: DataFrame, height: int, width: int, least: int = 32) -> DataFrame:
    """Levels halved until a side would fall below ``least``; level 0 is the raster itself."""
    out, level, cur = pixels.withColumn("level", F.lit(0)), 0, pixels
    while min(height, width) // 2 >= least:
        height, width, level = height // 2, width // 2, level + 1
        cur = block_mean(cur, 2)
        out = out.unionByName(cur.withColumn("level", F.lit(level)))
    return out


def band_mean(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*KEY).agg(F.avg("value").alias("value"))


def integral(pixels: DataFrame, block: int = 1024, **values) -> DataFrame:
    """Summed-area tables of one or more values (sat=value by default), in one pass. Along each axis: running sums inside blocks of ``block``, plus the running sum of block totals."""
    values = values or {"sat": F.col("value")}
    df = pixels.select(*KEY, *[v.cast("double").alias(k) for k, v in values.items()])
    for line, along in (("row", "col"), ("col", "row")):
        df = df.withColumn("b", F.floor(F.col(along) / block))
        inside = Window.partitionBy("raster_id", line, "b").orderBy(along)
        before = Window.partitionBy("raster_id", line).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        totals = df.groupBy("raster_id", line, "b").agg(*[F.sum(k).alias(k) for k in values])
        carry = totals.select("raster_id", line, "b", *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(f"carry_{k}") for k in values])
        sums = df.select(*KEY, "b", *[F.sum(k).over(inside).alias(k) for k in values])
        df = sums.join(carry.hint("merge"), ["raster_id", line, "b"]).select(*KEY, *[(F.col(k) + F.col(f"carry_{k}")).alias(k) for k in values])
    return df


def shifted(pixels: DataFrame, offsets: list[tuple[int, int, float]], name: str = "value") -> DataFrame:
    """Per pixel the weighted sum of neighbours at (row, col) offsets and the weight found: each pixel is sent to those that need it, and sums are partial."""
    o = F.explode(F.array(*[F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(float(w)).alias("w")) for r, c, w in offsets]))
    sent = pixels.select("raster_id", "row", "col", "value", o.alias("o"))
    sent = sent.select("raster_id", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), (F.col("value") * F.col("o.w")).alias("x"), F.col("o.w").alias("w"))
    sums = sent.groupBy(*KEY).agg(F.sum("x").alias(name), F.sum("w").alias("weight"), F.count("*").alias("found"))
    return sums


def gradients(pixels: DataFrame) -> DataFrame:
    """Central differences along both axes, one-sided at the edges; 0 for a single line."""
    return tiles.to_pixels(tiles.neighbourhood(tiles.to_tiles(pixels), 1, tiles.gradients, ["values", "gx", "gy"]), "values", "gx", "gy")


def sobel(pixels: DataFrame) -> DataFrame:
    """3 x 3 Sobel gradients of pixels with all eight neighbours."""
    return tiles.to_pixels(tiles.neighbourhood(tiles.to_tiles(pixels), 1, tiles.sobel, ["gx", "gy"]), "gx", "gy")


def cast_shadow(dem: DataFrame, elevation_deg: float, azimuth_deg: float, cell_m: float = 1.0, eps: float = 1e-6, block: int = 1024) -> DataFrame:
    """Adds ``shadow``: cast shadows of a sun at an elevation (0.5 degrees at least) and any azimuth, clockwise from north; rows run
    south. Every pixel is on one scanline away from the sun, skewed by whole pixels of the axis that the light crosses slower.
    With g = height + way along the light * tan(elevation), a pixel is in shadow if its g falls below the largest g before it on
    its line. The running maximum works in two levels, within blocks of a line and over their maxima. A null height casts none.
    """
    # light goes from the sun: east and south parts of its way
    ux, uy = (round(f(math.radians(azimuth_deg)), 15) for f in (lambda a: -math.sin(a), math.cos))
    along, across, u, v = ("col", "row", ux, uy) if abs(ux) >= abs(uy) else ("row", "col", uy, ux)
    line = F.floor(F.col(across) - F.col(along) * F.lit(v / u) + 0.5)
    step = F.col(along) if u > 0 else -F.col(along)
    g = F.col("value") + (F.col("col") * F.lit(ux) + F.col("row") * F.lit(uy)) * (cell_m * math.tan(math.radians(max(elevation_deg, 0.5))))
    rows = dem.withColumns({"__line": line, "__at": step, "__g": g}).withColumn("__block", F.floor(F.col("__at") / block))
    key = ["raster_id", "__line", "__block"]
    before = Window.partitionBy("raster_id", "__line").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*key).agg(F.max("__g").alias("__top")).select(*key, F.max("__top").over(before).alias("__carry"))
    inside = Window.partitionBy(*key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("__own", F.max("__g").over(inside)).join(carry.hint("merge"), key)
    shadow = F.coalesce(F.col("__g") < F.greatest("__own", "__carry") - eps, F.lit(False))
    return both.select(*dem.columns, shadow.alias("shadow"))


def horizon_shadow(dem: DataFrame, elevation_deg: float, cell_m: float = 1.0, east: bool = True, eps: float = 1e-6) -> DataFrame:
    """:func:`cast_shadow` of a sun over the west end of the rows, so that light goes east, or over their east end."""
    return cast_shadow(dem, elevation_deg, 270.0 if east else 90.0, cell_m, eps)


def local_stats(pixels: DataFrame, radius: int, width: int, wrap: bool = True) -> DataFrame:
    """Mean and population variance in the square of ``radius`` around each pixel; columns wrap around if asked. Pixels that are
    missing don't count."""
    made = tiles.neighbourhood(tiles.to_tiles(pixels), radius, tiles.window_stats(radius), ["mean", "variance"], width=width if wrap else None)
    return tiles.to_pixels(made, "mean", "variance")


def top_variance(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("variance"), "raster_id", "row", "col").limit(k)


def difference(a: DataFrame, b: DataFrame, mode: str = "abs") -> DataFrame:
    """Pixel difference of aligned rasters; missing and NaN stay missing."""
    x, y = F.nanvl(F.col("a").cast("double"), F.lit(None)), F.nanvl(F.col("b").cast("double"), F.lit(None))
    d = x - y if mode == "signed" else F.abs(x - y)
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), KEY).select(*KEY, d.alias("value"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels only in a, only in b, and in both: aligned means none is alone."""
    j = a.select(*KEY, F.lit(1).alias("a")).join(b.select(*KEY, F.lit(1).alias("b")), KEY, "full_outer")
    out = j.groupBy("raster_id").agg(F.sum(F.expr("int(a is not null and b is null)")).alias("only_a"), F.sum(F.expr("int(a is null and b is not null)")).alias("only_b"), F.sum(F.expr("int(a is not null and b is not null)")).alias("both"))
    return out.withColumn("aligned", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def grid_compatible(meta_a: DataFrame, meta_b: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Whether resolution, shape and origin of two rasters agree, from their metadata rows."""
    cols = ("height", "width", "res_x", "res_y", "x0", "y0")
    j = meta_a.select("raster_id", *[F.col(c).alias(f"{c}_a") for c in cols]).join(meta_b.select("raster_id", *[F.col(c).alias(f"{c}_b") for c in cols]), "raster_id")
    same = lambda *cs: F.forall(F.array(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= tol for c in cs]), lambda x: x)
    return j.select("raster_id", same("res_x", "res_y").alias("resolution"), same("height", "width").alias("shape"), same("x0", "y0").alias("origin"), same(*cols).alias("compatible"))


def sample_bilinear(points: DataFrame, pixels: DataFrame, x: str = "x", y: str = "y", fill: float | None = None, nearest: bool = False) -> DataFrame:
    """Raster values at fractional places ``(point_id, raster_id, x, y)``: four neighbours a point (one if nearest) met on equal
    keys. A place any of whose weighted neighbours is missing gets ``fill``."""
    fx, fy = F.floor(F.col(x)), F.floor(F.col(y))
    if nearest:
        taps = [F.struct(F.bround(F.col(y)).cast("long").alias("row"), F.bround(F.col(x)).cast("long").alias("col"), F.lit(1.0).alias("w"))]
    else:
        dx, dy = F.col(x) - fx, F.col(y) - fy
        taps = [F.struct((fy + i).alias("row"), (fx + j).alias("col"), ((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    asked = points.select("point_id", "raster_id", F.explode(F.array(*taps)).alias("t")).where("t.w > 0").select("point_id", "raster_id", "t.*")
    got = asked.join(pixels.hint("merge"), KEY, "left").groupBy("point_id", "raster_id").agg(F.sum(F.col("w") * F.col("value")).alias("v"), F.sum(F.when(F.col("value").isNotNull(), F.col("w")).otherwise(0.0)).alias("found"))
    value = F.when(F.col("found") > 1 - 1e-9, F.col("v"))
    return points.join(got.hint("merge"), ["point_id", "raster_id"], "left").select(*points.columns, (F.coalesce(value, F.lit(fill)) if fill is not None else value).alias("value"))


def warp(pixels: DataFrame, homographies: DataFrame, height: int, width: int) -> DataFrame:
    """Source rasters on the reference grid: every target pixel asks the source where the inverse transform puts it; outside: 0, valid false."""
    inverses = homographies.select("raster_id", inverse("h").alias("inv"))
    made = tiles.warp(tiles.to_tiles(pixels), inverses, height, width, fill=float("inf"))  # marks what is outside
    valid = ~F.col("value").isin(float("inf"))
    return tiles.to_pixels(made).select(*KEY, F.when(valid, F.col("value")).otherwise(0.0).alias("value"), valid.alias("valid"))


def resample(pixels: DataFrame, factor_y: float, factor_x: float, height: int, width: int, nearest: bool = False) -> DataFrame:
    """Onto a grid whose pixel centres lie ``factor`` source pixels apart."""
    grid = pixels.select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    pts = grid.select((F.col("row") * F.lit(width) + F.col("col")).cast("long").alias("point_id"), "raster_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), ((F.col("col") + 0.5) * factor_x - 0.5).alias("x"), ((F.col("row") + 0.5) * factor_y - 0.5).alias("y"))
    return sample_bilinear(pts, pixels, nearest=nearest).select(*KEY, "value")


def hillshade(dem: DataFrame, elevation_deg: float, azimuth_deg: float, cell_m: float = 1.0) -> DataFrame:
    """Lambert shading of the surface under a sun at (elevation, azimuth clockwise from north); rows run south."""
    el, az = math.radians(elevation_deg), math.radians(azimuth_deg)
    light = (math.cos(el) * math.sin(az), math.cos(el) * math.cos(az), math.sin(el))
    return tiles.to_pixels(tiles.neighbourhood(tiles.to_tiles(dem), 1, tiles.hillshade(light, cell_m), ["shade"]), "shade")


def ssim(a: DataFrame, b: DataFrame, window: int = 7, span: float = 255.0) -> DataFrame:
    """Structural similarity in windows that fit both rasters, from box sums about a centre; sample covariances."""
    made = tiles.neighbourhood(tiles.to_tiles(a), window // 2, tiles.ssim(window, span), ["ssim", "dissimilarity"], other=tiles.to_tiles(b))
    return tiles.to_pixels(made, "ssim", "dissimilarity")


def ssim_summary(s: DataFrame, valid: DataFrame) -> DataFrame:
    j = s.join(valid.select(*KEY, "valid").hint("merge"), KEY, "left")
    ok = F.coalesce("valid", F.lit(False))
    return j.groupBy("raster_id").agg(F.avg("ssim").alias("mean"), F.avg(F.when(ok, F.col("ssim"))).alias("valid_mean"), F.avg(ok.cast("double")).alias("valid_fraction"))


def summary_grid(s: DataFrame, valid: DataFrame, height: int, width: int, most: int = 320) -> DataFrame:
    """At most ``most`` blocks a side: mean, centre, and whether more than half of the block is valid."""
    f = max(1, -(-max(height, width) // most))
    j = s.join(valid.select(*KEY, "valid").hint("merge"), KEY, "left")
    at = lambda c: F.floor(F.col(c) / f)
    return j.groupBy("raster_id", at("row").alias("gy"), at("col").alias("gx")).agg(F.avg("ssim").alias("ssim"), (F.avg(F.coalesce(F.col("valid"), F.lit(False)).cast("double")) > 0.5).alias("valid")).select(
        "raster_id", "gy", "gx", ((F.col("gx") + 0.5) * f).alias("x"), ((F.col("gy") + 0.5) * f).alias("y"), "ssim", "valid"
    )


def crop_stretch(pixels: DataFrame, row: int, col: int, half: int) -> DataFrame:
    """The window around a centre, stretched between its least and largest value."""
    cut = pixels.where(F.col("row").between(row - half, row + half) & F.col("col").between(col - half, col + half))
    ends = cut.groupBy("raster_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return cut.join(ends.hint("merge"), "raster_id").select(*KEY, F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"))


def flat_field(pixels: DataFrame, height: int, width: int, factor: int = 4) -> DataFrame:
    """Pixel - lowpass + 128, cut to 0-255. The lowpass is a Gaussian of sigma max(3, 0.06 of the short side) on block means,
    along rows and then columns, and read back between blocks."""
    sigma = max(3.0, 0.06 * min(height, width)) / factor
    reach = int(math.ceil(3 * sigma))
    low = block_mean(pixels, factor)
    for axis in (0, 1):
        taps = [(i if axis == 0 else 0, 0 if axis == 0 else i, math.exp(-i * i / (2 * sigma * sigma))) for i in range(-reach, reach + 1)]
        inside = low.select(*KEY)
        low = inside.join(shifted(low, taps).select(*KEY, (F.col("value") / F.col("weight")).alias("value")).hint("merge"), KEY)
    nh, nw = -(-height // factor), -(-width // factor)
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least((F.col(c) + 0.5) / factor - 0.5, F.lit(float(n - 1))))
    pts = pixels.select((F.col("row") * width + F.col("col")).alias("point_id"), "raster_id", "row", "col", F.col("value").alias("v"), clamp("col", nw).alias("x"), clamp("row", nh).alias("y"))
    out = sample_bilinear(pts.drop("v"), low)
    return out.withColumnRenamed("value", "low").join(pixels.hint("merge"), KEY).select(*KEY, F.greatest(F.lit(0.0), F.least(F.col("value") - F.col("low") + 128, F.lit(255.0))).alias("value"))


def tile_equalise(pixels: DataFrame, height: int, width: int, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Contrast-limited equalisation of 0-255 rasters: per tile a clipped histogram, its running sum as a lookup table, and each pixel between the tables of its four nearest tiles."""
    th, tw = height / tiles, width / tiles
    at = lambda c, s: F.least(F.floor(F.col(c) / s), F.lit(tiles - 1)).cast("int")
    p = pixels.withColumn("dn", F.greatest(F.lit(0), F.least(F.floor("value"), F.lit(255))).cast("int"))
    counts = p.groupBy("raster_id", at("row", th).alias("ty"), at("col", tw).alias("tx"), "dn").agg(F.count("*").alias("n"))
    packed = counts.groupBy("raster_id", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("dn", "n"))).alias("h"), F.sum("n").alias("total"))
    limit = F.greatest(F.lit(1.0), clip * F.col("total") / 256)
    hist = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("h", i), F.lit(0)).cast("double"))
    packed = packed.withColumn("hist", hist).withColumn("limit", limit)
    packed = packed.withColumn("extra", F.aggregate("hist", F.lit(0.0), lambda s, x: s + F.greatest(x - F.col("limit"), F.lit(0.0))) / 256)
    lut = packed.select("raster_id", "ty", "tx", "total", F.posexplode(F.transform("hist", lambda x: F.least(x, F.col("limit")) + F.col("extra"))).alias("dn", "n"))
    w = Window.partitionBy("raster_id", "ty", "tx").orderBy("dn")
    lut = lut.select("raster_id", "ty", "tx", "dn", (F.sum("n").over(w) / F.col("total") * 255).alias("out"))
    fy, fx = (F.col("row") + 0.5) / th - 0.5, (F.col("col") + 0.5) / tw - 0.5
    dy, dx = fy - F.floor(fy), fx - F.floor(fx)
    clamp = lambda v: F.greatest(F.lit(0), F.least(v, F.lit(tiles - 1))).cast("int")
    taps = F.array(*[F.struct(clamp(F.floor(fy) + i).alias("ty"), clamp(F.floor(fx) + j).alias("tx"), ((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = p.select(*KEY, "dn", F.explode(taps).alias("t")).select(*KEY, "dn", "t.*")
    return asked.join(lut.hint("merge"), ["raster_id", "ty", "tx", "dn"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("out")).alias("value"))


def normalise_light(pixels: DataFrame, mode: str, height: int, width: int) -> DataFrame:
    """none, gradient (flat field), clahe (tile equalisation), or both in that order."""
    if mode not in ("none", "gradient", "clahe", "both"):
        raise ValueError(f"unknown mode {mode}")
    out = flat_field(pixels, height, width) if mode in ("gradient", "both") else pixels
    return tile_equalise(out, height, width) if mode in ("clahe", "both") else out


def regions(mask: DataFrame, flag: str = "shadow", least: int = 30, top: int = 60) -> DataFrame:
    """Eight-connected regions of flagged pixels with area, centroid and box: the ``top`` largest of at least ``least`` pixels
    per raster, ties to the region that begins first. Tiles find their parts by a sweep over runs; parts that touch over a border
    are linked. Any raster, row and column goes."""
    tables = Tables(mask.sparkSession)
    marks = tables.keep(tiles.to_tiles(mask.where(flag).select(*KEY, F.lit(1.0).alias("value"))))
    parts, labels = tiles.label_regions(marks)
    comp = connected_components(tiles.region_links(labels), tables=tables)
    r = parts.join(comp.hint("merge"), "node", "left").withColumn("region", F.coalesce("component", "node"))
    area = F.sum("area")
    out = r.groupBy("raster_id", "region").agg(
        area.alias("area"), (F.sum("sum_col") / area).alias("x"), (F.sum("sum_row") / area).alias("y"),
        F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.min("col0").alias("col0"), F.max("col1").alias("col1"),
    )
    order = Window.partitionBy("raster_id").orderBy(F.desc("area"), "region")
    best = out.where(F.col("area") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return tables.done(best.drop("region"))
