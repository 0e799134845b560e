"""Column functions on 3 x 3 plane transforms, stored as ``array<double>`` of 9 values, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geo import col


def project(h, x, y) -> Column:
    """(x, y) of a point under a transform; null where it goes to infinity."""
    h, x, y = col(h), col(x), col(y)
    w = h[6] * x + h[7] * y + h[8]
    return F.when(w != 0, F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y")))


def reprojection_error(h, src_x, src_y, ref_x, ref_y) -> Column:
    p = project(h, src_x, src_y)
    return F.hypot(p["x"] - col(ref_x), p["y"] - col(ref_y))


def decompose(h) -> Column:
    h = col(h)
    return F.struct(F.degrees(F.atan2(h[3], h[0])).alias("rotation_deg"), F.hypot(h[0], h[3]).alias("scale"), h[2].alias("tx"), h[5].alias("ty"))


def singular_values(h) -> Column:
    """(largest, smallest) of the upper left 2 x 2 block, in closed form."""
    h = col(h)
    a, b, c, d = h[0], h[1], h[3], h[4]
    p, q = F.hypot(a + d, b - c), F.hypot(a - d, b + c)
    return F.struct(((p + q) / 2).alias("s1"), (F.abs(p - q) / 2).alias("s2"))


def condition_ratio(h, floor: float = 1e-9) -> Column:
    """Largest over smallest singular value; infinite without a transform. Above 5 counts as degenerate."""
    s = singular_values(h)
    return F.when(col(h).isNull(), F.lit(math.inf)).otherwise(s["s1"] / F.greatest(s["s2"], F.lit(floor)))


def mean_scale(h) -> Column:
    s = singular_values(h)
    return (s["s1"] + s["s2"]) / 2


def scale_disagreement(a, b) -> Column:
    """How many times the larger scale is the smaller; infinite if one is null or not positive. Above 3 is flagged."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.greatest(a / b, b / a)).otherwise(F.lit(math.inf))


def dimension_scale(src_h, src_w, ref_h, ref_w) -> Column:
    return (col(ref_h) / col(src_h) + col(ref_w) / col(src_w)) / 2


def levelling(scale, trigger: float = 1.8) -> Column:
    """Which side to shrink before matching, and by how much."""
    s = col(scale)
    side = F.when(s >= trigger, "reference").when(s <= 1 / trigger, "source").otherwise("none")
    return F.struct(side.alias("side"), F.when(s <= 1 / trigger, 1 / s).otherwise(1.0).alias("src_factor"), F.when(s >= trigger, s).otherwise(1.0).alias("ref_factor"))


def multiply(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def inverse(h) -> Column:
    """By the adjugate; null where the determinant is 0."""
    h = col(h)
    m = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    adj = [m(4, 5, 7, 8), -m(1, 2, 7, 8), m(1, 2, 4, 5), -m(3, 5, 6, 8), m(0, 2, 6, 8), -m(0, 2, 3, 5), m(3, 4, 6, 7), -m(0, 1, 6, 7), m(0, 1, 3, 4)]
    det = h[0] * adj[0] + h[1] * adj[3] + h[2] * adj[6]
    return F.when(det != 0, F.array(*[x / det for x in adj]))


def scaling(sx, sy) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(col(sx), zero, zero, zero, col(sy), zero, zero, zero, one)


def rescale(h, src_factor, ref_factor) -> Column:
    """A transform found between shrunk images, for the full-size ones."""
    return multiply(scaling(ref_factor, ref_factor), multiply(h, scaling(1 / col(src_factor), 1 / col(src_factor))))


def corner_errors(h_est, h_true, height, width) -> Column:
    """Mean and largest distance between where two transforms put a frame's corners."""
    h, w = col(height), col(width)
    zero = F.lit(0.0)
    far = []
    for x, y in ((zero, zero), (w, zero), (zero, h), (w, h)):
        p, q = project(h_est, x, y), project(h_true, x, y)
        far.append(F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.struct(((far[0] + far[1] + far[2] + far[3]) / 4).alias("mean_px"), F.greatest(*far).alias("max_px"))


def variant_transform(scale, angle_deg, height, width) -> Column:
    """The exact transform of a variant image scaled and turned about its centre onto a canvas that holds all of it."""
    s, a, h, w = col(scale), F.radians(col(angle_deg)), col(height), col(width)
    c, d = s * F.cos(a), s * F.sin(a)
    new_w, new_h = F.bround(h * F.abs(d) + w * F.abs(c)), F.bround(h * F.abs(c) + w * F.abs(d))
    tx, ty = (1 - c) * w / 2 - d * h / 2 + (new_w - w) / 2, d * w / 2 + (1 - c) * h / 2 + (new_h - h) / 2
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = F.array(c, d, tx, -d, c, ty, zero, zero, one)
    return F.when((s == 1) & (col(angle_deg) == 0), F.array(one, zero, zero, zero, one, zero, zero, zero, one)).otherwise(turned)


def is_identity(h, atol: float = 1e-6) -> Column:
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    return F.forall(F.zip_with(col(h), eye, lambda a, b: F.abs(a - b) <= atol), lambda ok: ok)
