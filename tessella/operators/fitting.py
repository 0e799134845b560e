"""Transforms fitted per run: least squares in one aggregation, robust fits and patch refinement per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.transforms import inverse, mean_scale, project
from tessella.operators import tiles
from tessella.operators.matches import interleave
from tessella.session import Tables


def fit_affine(points: DataFrame) -> DataFrame:
    """Per run, the affine transform of least squared error from source to reference: sums of the normal equations in one
    aggregation (partial sums, no groups), and a closed-form solution about the means. Null with fewer than 3 points or points on a line."""
    m = {k: F.avg(k).alias(f"m_{k}") for k in ("src_x", "src_y", "ref_x", "ref_y")}
    s = [("xx", "src_x", "src_x"), ("xy", "src_x", "src_y"), ("yy", "src_y", "src_y"), ("xu", "src_x", "ref_x"), ("yu", "src_y", "ref_x"), ("xv", "src_x", "ref_y"), ("yv", "src_y", "ref_y")]
    sums = points.groupBy("run_id").agg(F.count("*").alias("n"), *m.values(), *[F.covar_pop(a, b).alias(k) for k, a, b in s])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda u, v: ((F.col(u) * F.col("yy") - F.col(v) * F.col("xy")) / det, (F.col(v) * F.col("xx") - F.col(u) * F.col("xy")) / det)
    (a, b), (c, d) = solve("xu", "yu"), solve("xv", "yv")
    e, f = F.col("m_ref_x") - a * F.col("m_src_x") - b * F.col("m_src_y"), F.col("m_ref_y") - c * F.col("m_src_x") - d * F.col("m_src_y")
    h = F.array(a, b, e, c, d, f, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return sums.select("run_id", F.col("n").alias("n_points"), F.when((F.col("n") >= 3) & (F.abs(det) > 1e-9), h).alias("h"))


def _dlt(src: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Homographies by direct linear transform on normalised coordinates, of many sets of points ``(sets, points, 2)`` at once; NaN
    where there is none."""
    def normal(p):
        c = p.mean(axis=1)
        s = np.sqrt(2) / np.maximum(1e-12, np.sqrt(((p - c[:, None]) ** 2).sum(axis=2)).mean(axis=1))
        m = np.zeros((len(p), 3, 3))
        m[:, 0, 0] = m[:, 1, 1] = s
        m[:, :2, 2] = -s[:, None] * c
        m[:, 2, 2] = 1
        return m

    out = np.full((len(src), 3, 3), np.nan)
    fine = np.flatnonzero(np.isfinite(src).all(axis=(1, 2)) & np.isfinite(ref).all(axis=(1, 2)))
    src, ref = src[fine], ref[fine]
    a, b, one = normal(src), normal(ref), np.ones((*src.shape[:2], 1))
    x = np.concatenate([src, one], axis=2) @ a.transpose(0, 2, 1)
    u = np.concatenate([ref, one], axis=2) @ b.transpose(0, 2, 1)
    zero = np.zeros_like(x)
    rows = np.concatenate([np.concatenate([x, zero, -u[:, :, :1] * x], axis=2), np.concatenate([zero, x, -u[:, :, 1:2] * x], axis=2)], axis=1)
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3) @ a
    ok = np.abs(h[:, 2, 2]) > 1e-12
    out[fine[ok]] = h[ok] / h[ok, 2:, 2:]
    return out


def _errors(h: np.ndarray, src: np.ndarray, ref: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.hypot(p[:, 0] / p[:, 2] - ref[:, 0], p[:, 1] / p[:, 2] - ref[:, 1]), nan=np.inf)


def _picked(block: int):
    """Of one block of a run's points, those that the run's draws ask for, with the numbers of the draws."""

    def run(batches):
        for pdf in batches:
            t, xy = [], []
            for b, pts, draws in zip(pdf["b"], pdf["pts"], pdf["draws"]):
                at = np.asarray(draws, np.int64)
                here = np.flatnonzero(at // block == b)
                t.append(here.astype(np.int32))
                xy.append(_points(pts)[at[here] % block].ravel())
            yield pd.DataFrame({"run_id": pdf["run_id"], "t": t, "xy": xy})

    return run


def _hypotheses(batches):
    """Four-point fits of each run's draws: the first four make the first fit, and so on."""
    for pdf in batches:
        out = []
        for t, xy in zip(pdf["t"], pdf["xy"]):
            p = np.asarray(xy, float).reshape(-1, 4)[np.argsort(np.asarray(t))].reshape(-1, 4, 4)
            src, ref = p[:, :, :2], p[:, :, 2:]
            h = _dlt(src, ref)
            same = [(src[:, i] == src[:, j]).all(axis=1) for i in range(4) for j in range(i)]
            h[np.any(same, axis=0)] = np.nan  # a point may be drawn twice
            out.append(h.ravel())
        yield pd.DataFrame({"run_id": pdf["run_id"], "hs": out})


def _points(pts) -> np.ndarray:
    """A block's ``src_x, src_y, ref_x, ref_y``, one row a point in order of its number."""
    p = np.asarray(pts, float).reshape(-1, 5)
    return p[np.argsort(p[:, 0]), 1:]


def _votes(threshold: float, part: int = 32):
    """Of one block of points, how many each transform fits; ``part`` transforms at once."""

    def run(batches):
        for pdf in batches:
            out = []
            for pts, hs in zip(pdf["pts"], pdf["hs"]):
                p = _points(pts)
                x, hs = np.c_[p[:, :2], np.ones(len(p))].T, np.asarray(hs, float).reshape(-1, 3, 3)
                votes = []
                with np.errstate(all="ignore"):  # NaN fits nothing
                    for i in range(0, len(hs), part):
                        q = hs[i : i + part] @ x
                        votes.append((np.hypot(q[:, 0] / q[:, 2] - p[:, 2], q[:, 1] / q[:, 2] - p[:, 3]) <= threshold).sum(axis=1))
                out.append(np.concatenate(votes))
            yield pd.DataFrame({"run_id": pdf["run_id"], "votes": out})

    return run


def _normal_sums(threshold: float):
    """Of one block of points, the sums of the linear system over those that a transform fits."""

    def run(batches):
        for pdf in batches:
            out = []
            for pts, h, (cx, cy, cs, ux, uy, us) in zip(pdf["pts"], pdf["hs"], pdf["norm"]):
                src, ref = np.hsplit(_points(pts), 2)
                ok = _errors(np.asarray(h, float).reshape(3, 3), src, ref) <= threshold
                x = np.c_[(src[ok] - (cx, cy)) / cs, np.ones(ok.sum())]
                u = (ref[ok] - (ux, uy)) / us
                zero = np.zeros_like(x)
                rows = np.vstack([np.hstack([x, zero, -u[:, :1] * x]), np.hstack([zero, x, -u[:, 1:] * x])])
                out.append((rows.T @ rows).ravel().tolist())
            yield pd.DataFrame({"run_id": pdf["run_id"], "sums": out})

    return run


def _solve(batches):
    for pdf in batches:
        out = []
        for sums, (cx, cy, cs, ux, uy, us) in zip(pdf["sums"], pdf["norm"]):
            v = np.linalg.eigh(np.asarray(sums, float).reshape(9, 9))[1][:, 0].reshape(3, 3)
            h = np.array([[us, 0, ux], [0, us, uy], [0, 0, 1]]) @ v @ np.array([[1 / cs, 0, -cx / cs], [0, 1 / cs, -cy / cs], [0, 0, 1]])
            out.append((h / h[2, 2]).ravel().tolist() if abs(h[2, 2]) > 1e-12 else None)
        yield pd.DataFrame({"run_id": pdf["run_id"], "hs": out})


def fit_robust(points: DataFrame, threshold: float = 3.0, tries: int = 300, block: int = 1024) -> DataFrame:
    """Per run, a homography by consensus of four-point fits, refitted on its inliers. Below 4 points, or without 4 inliers: null.

    Four-point fits are drawn from all points of a run: points are numbered in order of ``match_idx`` (in ranges, then over
    ranges), and draws are numbers by a hash of the run and the draw. All points vote on every fit and enter the refit as sums,
    in blocks of at most ``block`` successive points of a run, so a large run spreads over many tasks. A block gives the points drawn
    of it, so draws and points meet block by block.
    """
    tables = Tables(points.sparkSession)
    kind = points.schema["run_id"].dataType.simpleString()
    xy = ["src_x", "src_y", "ref_x", "ref_y"]
    cols = tables.keep(points.select("run_id", "match_idx", *[F.col(c).cast("double").alias(c) for c in xy]))
    totals = tables.keep(cols.groupBy("run_id").agg(F.count("*").alias("total"), *[f(c).alias(f"{n}_{c}") for c in xy for n, f in (("m", F.avg), ("s", F.stddev_pop))]))
    numbered = interleave(cols.withColumnsRenamed({"run_id": "lane", "match_idx": "task"}), tables).select(F.col("lane").alias("run_id"), (F.col("turn") - 1).alias("at"), *xy)
    number = F.struct((F.col("at") % block).cast("double").alias("at"), *xy)
    flat = F.flatten(F.transform(F.collect_list(number), lambda p: F.array(p["at"], *[p[c] for c in xy])))
    blocks = tables.keep(numbered.groupBy("run_id", F.expr(f"at div {block}").alias("b")).agg(flat.alias("pts")))
    draws = F.transform(F.sequence(F.lit(0), F.lit(4 * tries - 1)), lambda t: F.pmod(F.xxhash64("run_id", t), F.col("total")))
    asked = blocks.join(totals.where("total >= 4").select("run_id", draws.alias("draws")).hint("merge"), "run_id")
    drawn = asked.select("run_id", "b", "pts", "draws").mapInPandas(_picked(block), f"run_id {kind}, t array<int>, xy array<double>")
    drawn = drawn.groupBy("run_id").agg(F.flatten(F.collect_list("t")).alias("t"), F.flatten(F.collect_list("xy")).alias("xy"))
    fits = tables.keep(drawn.mapInPandas(_hypotheses, f"run_id {kind}, hs array<double>"))
    size = lambda a, b: F.greatest(F.lit(1e-12), F.sqrt((F.col(f"s_{a}") ** 2 + F.col(f"s_{b}") ** 2 + ((F.col(f"m_{a}") - F.col(f"m_{b}")) / 2) ** 2 * 2) / 2))
    norm = F.array("m_src_x", "m_src_y", size("src_x", "src_y"), "m_ref_x", "m_ref_y", size("ref_x", "ref_y"))
    fits = fits.join(totals.select("run_id", norm.alias("norm")).hint("merge"), "run_id")

    def voted(h: DataFrame) -> DataFrame:
        both = blocks.join(h.where("hs is not null").select("run_id", "hs").hint("merge"), "run_id").select("run_id", "pts", "hs")
        each = both.mapInPandas(_votes(threshold), f"run_id {kind}, votes array<long>").select("run_id", F.posexplode("votes").alias("t", "n"))
        return each.groupBy("run_id", "t").agg(F.sum("n").alias("n"))

    best = voted(fits).groupBy("run_id").agg(F.max(F.struct("n", (-F.col("t")).alias("t"))).alias("b")).where("b.n >= 4")
    best = tables.keep(fits.join(best.hint("merge"), "run_id").select("run_id", F.slice("hs", 1 - F.col("b.t") * 9, F.lit(9)).alias("hs"), "norm"))
    parts = blocks.join(best.hint("merge"), "run_id").select("run_id", "pts", "hs", "norm").mapInPandas(_normal_sums(threshold), f"run_id {kind}, sums array<double>")
    sums = parts.groupBy("run_id").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(81)]).alias("sums"))
    refit = tables.keep(sums.join(best.select("run_id", "norm").hint("merge"), "run_id").mapInPandas(_solve, f"run_id {kind}, hs array<double>"))
    found = refit.join(voted(refit).select("run_id", "n").hint("merge"), "run_id").select("run_id", F.col("hs").alias("h"), F.col("n").alias("inliers"))
    out = totals.select("run_id", "total").join(found.hint("merge"), "run_id", "left")
    return tables.done(out.select("run_id", "h", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), "total"))


def phase_shift(a: np.ndarray, b: np.ndarray, upsample: int = 50) -> tuple[float, float]:
    """(dy, dx) that moves patch b onto patch a, to 1/upsample of a pixel: the peak of the cross-power spectrum, then a matrix DFT around it."""
    cross = np.fft.fft2(a - a.mean()) * np.conj(np.fft.fft2(b - b.mean()))
    size = np.abs(cross)
    cross /= size + 1e-4 * max(size.max(), 1e-12)  # phases of frequencies that a patch hardly has are noise
    peak = np.array(np.unravel_index(np.abs(np.fft.ifft2(cross)).argmax(), a.shape), float)
    shape = np.array(a.shape)
    peak = np.where(peak > shape // 2, peak - shape, peak)
    half = 1.5
    steps = np.arange(-half, half + 1e-9, 1 / upsample)
    fy, fx = np.fft.fftfreq(shape[0]), np.fft.fftfreq(shape[1])
    ky, kx = np.exp(2j * np.pi * np.outer(peak[0] + steps, fy)), np.exp(2j * np.pi * np.outer(peak[1] + steps, fx))
    fine = np.abs(ky @ cross @ kx.T)
    i, j = np.unravel_index(fine.argmax(), fine.shape)
    return float(peak[0] + steps[i]), float(peak[1] + steps[j])


def shift_of(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[float, float, str]:
    """Shift of two patches and its outcome: patches with missing pixels are ``outside``, those without contrast ``flat``."""
    if np.isnan(a).any() or np.isnan(b).any():
        return 0.0, 0.0, "outside"
    if a.std() < 1e-6 or b.std() < 1e-6:
        return 0.0, 0.0, "flat"
    y, x = phase_shift(a, b)
    return (y, x, "refined") if np.hypot(x, y) <= limit else (0.0, 0.0, "too_far")


def _refine(limit: float):
    def run(batches):
        for pdf in batches:
            whole = lambda p, n: np.asarray(p, float).reshape(n, n) if p is not None and len(p) == n * n else np.full((n, n), np.nan)
            made = [shift_of(whole(a, n), whole(b, n), limit) for a, b, n in zip(pdf["src_patch"], pdf["ref_patch"], pdf["size"], strict=True)]
            dy, dx, outcome = zip(*made, strict=True) if made else ((), (), ())
            yield pdf[["run_id", "match_idx"]].assign(dy=dy, dx=dx, outcome=outcome)

    return run


def refine_points(patches: DataFrame, limit: float = 5.0) -> DataFrame:
    """Sub-pixel shifts by phase correlation of two patches a point: ``patches(run_id, match_idx, size, src_patch, ref_patch)``. Points are independent, so any partitioning serves."""
    kind = patches.schema["run_id"].dataType.simpleString()
    return patches.select("run_id", "match_idx", "size", "src_patch", "ref_patch").mapInPandas(_refine(limit), f"run_id {kind}, match_idx long, dy double, dx double, outcome string")


def patches_at(points: DataFrame, pixels: DataFrame, x: str, y: str, name: str, size: int = 48) -> DataFrame:
    """The size x size pixels around each point, row by row; points whose patch leaves the raster have a shorter array."""
    asked = points.select("run_id", "match_idx", "raster_id", F.col(x).alias("x"), F.col(y).alias("y"))
    return tiles.at_points(asked, [tiles.to_tiles(pixels)], size // 2, lambda a: {name: a[~np.isnan(a)].tolist()}, {name: "array<double>"}, ["run_id", "match_idx"])


def outcome_counts(refined: DataFrame) -> DataFrame:
    return refined.groupBy("run_id").pivot("outcome", ["refined", "flat", "too_far", "outside", "scale_guard"]).count().na.fill(0)


def refine_matches(points: DataFrame, src: DataFrame, ref: DataFrame, homographies: DataFrame, height: int, width: int, size: int = 48, max_scale: float = 2.5) -> DataFrame:
    """Sub-pixel source places of match points ``(run_id, match_idx, src_x, src_y, ref_x, ref_y)``: ``src_x, src_y, outcome``.

    Each run's source raster is warped onto its reference grid (rasters have their run's id), patches around the reference
    place are compared, and the shifted place is mapped back by the inverse transform. Only ``refined`` points move. A run
    whose transform scales by more than ``max_scale`` either way, or that has none, is left alone as ``scale_guard``.
    """
    scale = mean_scale("h")
    fine = homographies.where(F.col("h").isNotNull() & (scale > 0) & (F.greatest(scale, 1 / scale) <= max_scale)).select("run_id", "h")
    grid = tiles.warp(tiles.to_tiles(src), fine.select(F.col("run_id").alias("raster_id"), inverse("h").alias("inv")), height, width, fill=0.0)
    asked = points.join(fine.select("run_id").hint("merge"), "run_id", "left_semi").select("run_id", "match_idx", F.col("run_id").alias("raster_id"), F.col("ref_x").alias("x"), F.col("ref_y").alias("y"))
    compare = lambda a, b: dict(zip(("dy", "dx", "outcome"), shift_of(a, b, size / 2), strict=True))
    shifts = tiles.at_points(asked, [tiles.to_tiles(ref), grid], size // 2, compare, {"dy": "double", "dx": "double", "outcome": "string"}, ["run_id", "match_idx"])
    out = points.join(fine.hint("merge"), "run_id", "left").join(shifts.hint("merge"), ["run_id", "match_idx"], "left")
    out = out.withColumn("outcome", F.coalesce("outcome", F.lit("scale_guard")))
    out = out.withColumn("inv", inverse("h"))
    out = out.withColumn("back", project("inv", F.col("ref_x") + F.col("dx"), F.col("ref_y") + F.col("dy")))
    back, moved = F.col("back"), F.col("outcome") == "refined"
    return out.select("run_id", "match_idx", F.when(moved, back["x"]).otherwise(F.col("src_x")).alias("src_x"), F.when(moved, back["y"]).otherwise(F.col("src_y")).alias("src_y"), "ref_x", "ref_y", "outcome")
