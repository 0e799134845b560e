"""Column functions on longitudes, latitudes, rings, boxes and vectors. Angles in degrees, lengths in km on the Moon."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius and length of a degree.
RADIUS_KM = 1737.4
KM_PER_DEG = 2 * math.pi * RADIUS_KM / 360


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lon360(lon) -> Column:
    return F.pmod(col(lon), F.lit(360.0))


def unwrap_lon(lon, ref) -> Column:
    """The longitude equal to ``lon`` that lies within 180 degrees of ``ref``."""
    lon, ref = col(lon), col(ref)
    return ref + F.pmod(lon - ref + 180, F.lit(360.0)) - 180


def lon_end(lo, hi) -> Column:
    """The east end of a range of longitudes, not below its west end: a range that ends below its start runs over 0/360."""
    lo, hi = col(lo), col(hi)
    return F.when(hi < lo, hi + 360).otherwise(hi)


def lon_cells(lo, hi, cell: float) -> Column:
    """Numbers modulo 360 / ``cell`` of the cells that the longitudes lo to hi touch, each once. A range may lie over 0/360."""
    n, lo = round(360 / cell), col(lo)
    if abs(n * cell - 360) > 1e-9:
        raise ValueError("cells must divide 360 degrees")
    start = lon360(lo)
    first, last = F.floor(start / cell), F.floor((lon_end(lo, hi) - (lo - start)) / cell)
    return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda x: F.pmod(x, F.lit(n)))


def lon_cell(lon, cell: float) -> Column:
    return F.pmod(F.floor(lon360(lon) / cell), F.lit(round(360 / cell)))


def near_lon(lon, ref) -> Column:
    """``lon`` by whole turns as near to ``ref`` as may be; as it is if it is near already."""
    lon, ref = col(lon), col(ref)
    return lon + 360 * F.round((ref - lon) / 360)


def angular_diff(a, b) -> Column:
    return F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180)


def wrapped_diff(a, b) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180


def haversine_km(lat1, lon1, lat2, lon2, radius: float = RADIUS_KM) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = F.radians(col(lat2) - col(lat1)), F.radians(col(lon2) - col(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def to_xyz(lat, lon, alt=0.0, radius: float = RADIUS_KM) -> Column:
    r, a, o = col(alt) + radius, F.radians(col(lat)), F.radians(col(lon))
    return F.array(r * F.cos(a) * F.cos(o), r * F.cos(a) * F.sin(o), r * F.sin(a))


def from_xyz(v, radius: float = RADIUS_KM) -> Column:
    v = col(v)
    n = norm(v)
    return F.struct(F.degrees(F.asin(v[2] / n)).alias("lat"), F.pmod(F.degrees(F.atan2(v[1], v[0])), F.lit(360.0)).alias("lon"), (n - radius).alias("alt"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def rotate(m, v) -> Column:
    """A 3 x 3 row-major matrix (9 values) times a vector."""
    m, v = col(m), col(v)
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def view_divergence(target, observer1, observer2) -> Column:
    """The angle at a target between two observers; null if either is missing."""
    a = F.zip_with(col(observer1), col(target), lambda x, t: x - t)
    b = F.zip_with(col(observer2), col(target), lambda x, t: x - t)
    c = dot(a, b) / (norm(a) * norm(b))
    return F.when(c.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))  # greatest and least skip nulls


def solar_incidence(lat, lon, sun_lat, sun_lon) -> Column:
    a, b, d = F.radians(col(lat)), F.radians(col(sun_lat)), F.radians(col(sun_lon) - col(lon))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def solar_azimuth(lat, lon, sun_lat, sun_lon) -> Column:
    """Clockwise from north, 0 to 360."""
    a, b, d = F.radians(col(lat)), F.radians(col(sun_lat)), F.radians(col(sun_lon) - col(lon))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def incidence_from_elevation(elevation) -> Column:
    return 90 - col(elevation)


def light_vector(elevation, azimuth) -> Column:
    e, a = F.radians(col(elevation)), F.radians(col(azimuth))
    return F.array(F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e))


def lambert(nx, ny, nz, light) -> Column:
    light = col(light)
    n = F.sqrt(col(nx) * col(nx) + col(ny) * col(ny) + col(nz) * col(nz))
    return F.greatest((col(nx) * light[0] + col(ny) * light[1] + col(nz) * light[2]) / n, F.lit(0.0))


# rings are array<struct<lat: double, lon: double>>


def open_ring(ring) -> Column:
    """Without a closing vertex that repeats the first."""
    r = col(ring)
    return F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def ring_centroid(ring, drop_closing: bool = True) -> Column:
    """The mean vertex, longitudes unwrapped to the first one."""
    def of(r: Column) -> Column:
        lon = F.transform(r, lambda p: unwrap_lon(p["lon"], r[0]["lon"]))
        return F.struct(_mean(F.transform(r, lambda p: p["lat"])).alias("lat"), lon360(_mean(lon)).alias("lon"))

    return let(open_ring(ring) if drop_closing else col(ring), of)


def to_local_km(ring, ref_lat, ref_lon) -> Column:
    """A ring on the tangent plane at a point: array<struct<x, y>> in km."""
    lat0, lon0 = col(ref_lat), col(ref_lon)
    return F.transform(
        col(ring),
        lambda p: F.struct(
            ((unwrap_lon(p["lon"], lon0) - lon0) * F.cos(F.radians(lat0)) * KM_PER_DEG).alias("x"), ((p["lat"] - lat0) * KM_PER_DEG).alias("y")
        ),
    )


def ring_area_km2(ring) -> Column:
    """Shoelace area on the tangent plane at the mean vertex; null below 3 vertices."""
    def of(p: Column) -> Column:
        following = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        twice = F.aggregate(F.zip_with(p, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(p) >= 3, F.abs(twice) / 2)

    return let(ring_centroid(ring), lambda c: let(to_local_km(open_ring(ring), c["lat"], c["lon"]), of))


def ring_bbox(ring) -> Column:
    r = col(ring)
    lat, lon = F.transform(r, lambda p: p["lat"]), F.transform(r, lambda p: p["lon"])
    return F.struct(F.array_min(lon).alias("lon0"), F.array_max(lon).alias("lon1"), F.array_min(lat).alias("lat0"), F.array_max(lat).alias("lat1"))


def frame_extent_km(corners) -> Column:
    """(along, cross) of a frame from its four corners (0,0), (0,last), (last,0), (last,last) as lat/lon structs."""
    c = col(corners)

    def far(a, b):
        mid = (c[a]["lat"] + c[b]["lat"]) / 2
        dx = (unwrap_lon(c[b]["lon"], c[a]["lon"]) - c[a]["lon"]) * F.cos(F.radians(mid))
        return F.hypot(dx, c[b]["lat"] - c[a]["lat"]) * KM_PER_DEG

    return F.struct(far(0, 2).alias("along"), far(0, 1).alias("cross"))


def bilinear_lonlat(corners, line, sample, lines, samples) -> Column:
    c, u, v = col(corners), col(line) / (col(lines) - 1), col(sample) / (col(samples) - 1)
    mix = lambda k: (1 - u) * ((1 - v) * c[0][k] + v * c[1][k]) + u * ((1 - v) * c[2][k] + v * c[3][k])
    return F.struct(mix("lon").alias("lon"), mix("lat").alias("lat"))


def inverse_bilinear(corners, lon, lat, lines, samples) -> Column:
    """(line, sample, residual): where in a frame a place lies, clamped to the frame, and the squared distance in degrees
    that the clamped place misses it by. Closed form: the bilinear map is quadratic in the line fraction."""
    def parts(c: Column) -> Column:
        at = {"lon": col(lon), "lat": col(lat)}
        both = [(k, i, f) for i, f in enumerate("xy") for k in ("lon", "lat") if (k == "lon") == (i == 0)]
        vals = []
        for k, _, f in both:
            vals += [(c[2][k] - c[0][k]).alias(f"e{f}"), (c[1][k] - c[0][k]).alias(f"f{f}"), (c[0][k] - c[1][k] - c[2][k] + c[3][k]).alias(f"g{f}"), (at[k] - c[0][k]).alias(f"h{f}")]
        return F.struct(*vals)

    def cross(q: Column, a: str, b: str) -> Column:
        return q[f"{a}x"] * q[f"{b}y"] - q[f"{a}y"] * q[f"{b}x"]

    def roots(q: Column) -> Column:
        def solve(k: Column) -> Column:
            root = F.sqrt(F.greatest(k["k1"] * k["k1"] - 4 * k["k0"] * k["k2"], F.lit(0.0)))
            flat = F.abs(k["k2"]) < 1e-12
            return F.array(*[F.when(flat, -k["k0"] / k["k1"]).otherwise((-k["k1"] + sign * root) / (2 * k["k2"])) for sign in (-1, 1)])

        return let(F.struct(cross(q, "g", "f").alias("k2"), (cross(q, "e", "f") + cross(q, "h", "g")).alias("k1"), cross(q, "h", "e").alias("k0")), solve)

    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))

    def place(q: Column, v: Column) -> Column:
        def at(d: Column) -> Column:
            u = F.when(F.abs(d["x"]) > F.abs(d["y"]), (q["hx"] - q["fx"] * v) / d["x"]).otherwise((q["hy"] - q["fy"] * v) / d["y"])
            return F.struct(clamp(u).alias("u"), clamp(v).alias("w"))

        def miss(t: Column) -> Column:
            mx, my = (q[f"e{k}"] * t["u"] + q[f"f{k}"] * t["w"] + q[f"g{k}"] * t["u"] * t["w"] - q[f"h{k}"] for k in "xy")
            return F.struct((mx * mx + my * my).alias("residual"), (t["u"] * (col(lines) - 1)).alias("line"), (t["w"] * (col(samples) - 1)).alias("sample"))

        d = F.struct((q["ex"] + q["gx"] * v).alias("x"), (q["ey"] + q["gy"] * v).alias("y"))
        return let(let(d, at), miss)

    return let(let(col(corners), parts), lambda q: F.array_min(F.transform(roots(q), lambda v: place(q, v))))


def line_fraction(lat, lat_first, lat_last) -> Column:
    return (col(lat) - col(lat_first)) / (col(lat_last) - col(lat_first))


def dem_row(lat, per_deg: float = 64.0) -> Column:
    return F.floor((90 - col(lat)) * per_deg).cast("long")


def dem_col(lon, per_deg: float = 64.0) -> Column:
    return F.pmod(F.floor(col(lon) * per_deg), F.lit(int(360 * per_deg))).cast("long")


def dem_pixels_per_cell(lat0, lat1, lon0, lon1, cells: int, per_deg: float = 64.0, least: float = 4.0) -> Column:
    """DEM pixels along each side of a grid cell, and whether there are enough of them."""
    h, w = F.abs(col(lat1) - col(lat0)) / cells * per_deg, F.abs(col(lon1) - col(lon0)) / cells * per_deg
    return F.struct(h.alias("rows"), w.alias("cols"), (F.least(h, w) >= least).alias("sufficient"))


def gsd_from_area(area_km2, lines, samples) -> Column:
    """Metres a pixel from a footprint's area."""
    return F.sqrt(col(area_km2) * 1e6 / (col(lines) * col(samples)))


# boxes


def box_overlap(a: tuple, b: tuple) -> Column:
    """Overlap of two (x0, x1, y0, y1) boxes as a share of the smaller one, 0 when they only touch."""
    ax0, ax1, ay0, ay1 = (col(v) for v in a)
    bx0, bx1, by0, by1 = (col(v) for v in b)
    w, h = F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ay1, by1) - F.greatest(ay0, by0)
    small = F.least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0))
    return F.when((w > 0) & (h > 0) & (small > 0), w * h / small).otherwise(0.0)


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes given as (centre x, centre y, width, height)."""
    ax, ay, aw, ah = (col(v) for v in a)
    bx, by, bw, bh = (col(v) for v in b)
    w = F.greatest(F.least(ax + aw / 2, bx + bw / 2) - F.greatest(ax - aw / 2, bx - bw / 2), F.lit(0.0))
    h = F.greatest(F.least(ay + ah / 2, by + bh / 2) - F.greatest(ay - ah / 2, by - bh / 2), F.lit(0.0))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def quadrant(row, column, n: int) -> Column:
    ns = F.when(col(row) < n / 2, "north").otherwise("south")
    we = F.when(col(column) < n / 2, "west").otherwise("east")
    return F.concat(ns, we)
