"""Parameter sweeps: plans, truth errors, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geo import angular_diff
from tessella.functions.transforms import corner_errors, decompose, project, variant_transform

#: Fixed values of the plans.
SUN_DELTAS = (0, 15, 30, 45)
SCALES = (0.5, 0.7, 1.0, 1.5, 2.0)
ROTATIONS = (0, 15, 30, 45, 90)
HARD = ((30, 1.5, 30), (45, 2.0, 45))
LIVE_COMPOUND = ((0, 1.0, 30), (15, 1.5, 30), (30, 0.7, 30), (45, 2.0, 30))
RELIGHT_ELEVATION = (-10, -15, -20, -25, -30, -35, -40, -45)
RELIGHT_AZIMUTH = (45, 90, 135)


def _variants(live: bool) -> list[tuple[str, int, float, int]]:
    out = [("sun_only", d, 1.0, 0) for d in SUN_DELTAS] + [("scale_only", 0, s, 0) for s in SCALES] + [("rotation_only", 0, 1.0, r) for r in ROTATIONS]
    if live:
        return out + [("compound", *c) for c in LIVE_COMPOUND]
    return out + [("compound_hard", *c) for c in HARD] + [("compound_grid", d, s, 30) for d in SUN_DELTAS for s in SCALES]


def plan(sources: DataFrame, live: bool = False) -> DataFrame:
    """All variants of each source; those that change the sun only for sources with sun telemetry."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("category"), F.lit(d).alias("sun_delta"), F.lit(float(s)).alias("scale"), F.lit(r).alias("rotation_deg")) for c, d, s, r in _variants(live)])
    )
    out = sources.select("source_id", "has_sun", rows.alias("v")).select("source_id", "has_sun", "v.*")
    return out.where("has_sun or category not in ('sun_only', 'compound', 'compound_hard', 'compound_grid')").drop("has_sun")


def relight_plan(frames: DataFrame) -> DataFrame:
    steps = [(e, 0) for e in RELIGHT_ELEVATION] + [(0, a) for a in RELIGHT_AZIMUTH]
    return frames.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("elevation_delta"), F.lit(a).alias("azimuth_delta")) for e, a in steps])).alias("v")).select(*frames.columns, "v.*")


def new_elevation(elevation, delta, least: float = 2.0):
    return F.greatest(F.lit(least), F.col(elevation) - F.abs(F.col(delta)))


def identity_records(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known results, to run): variants that change nothing are validated with no error and needn't be run."""
    same = "sun_delta = 0 and scale = 1.0 and rotation_deg = 0"
    known = planned.where(same).withColumn("validated", F.lit(True)).withColumn("error_px", F.lit(0.0)).withColumn("status", F.lit("identity"))
    return known, planned.where(f"not ({same})")


def truth_errors(results: DataFrame) -> DataFrame:
    """Errors of an estimated transform ``h`` against the variant's exact one; nulls where the fit failed. Needs height, width, gsd_m."""
    df = results.withColumn("h_true", variant_transform("scale", "rotation_deg", "height", "width"))
    est, true = decompose("h"), decompose("h_true")
    far = corner_errors("h", "h_true", "height", "width")
    have = F.col("h").isNotNull()
    return df.select(
        *results.columns,
        F.when(have, angular_diff(est["rotation_deg"], true["rotation_deg"])).alias("rotation_error_deg"),
        F.when(have, F.abs(est["scale"] / true["scale"] - 1)).alias("scale_error"),
        F.when(have, F.hypot(est["tx"] - true["tx"], est["ty"] - true["ty"])).alias("translation_error_px"),
        F.when(have, far["mean_px"]).alias("mean_error_px"), F.when(have, far["max_px"]).alias("max_error_px"), F.when(have, far["mean_px"] * F.col("gsd_m")).alias("mean_error_m"),
    )


def pass_rates(results: DataFrame) -> DataFrame:
    rate = F.avg(F.when(F.col("validated"), 100.0).otherwise(0.0))
    return results.groupBy("category", "x").agg(rate.alias("pass_rate"), F.avg("err_m").alias("mean_err"), F.count("*").alias("n"))


def thresholds(rates: DataFrame) -> DataFrame:
    """Per category the first x (0 aside) below a full pass rate, and the first without any pass."""
    x = F.when(F.col("x") != 0, F.col("x"))
    return rates.groupBy("category").agg(F.min(F.when(F.col("pass_rate") < 100, x)).alias("first_degraded"), F.min(F.when(F.col("pass_rate") <= 0, x)).alias("first_failed"))


def pass_matrix(results: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    return results.groupBy(rows).pivot(cols, values).agg(F.avg(F.when(F.col("validated"), 100.0).otherwise(0.0)))


def progress(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    both = planned.select(*keys).join(done.select(*keys, "status").dropDuplicates(keys).hint("merge"), keys, "left")
    total, completed = F.count("*"), F.count("status")
    state = F.when(completed == 0, "pending").when(completed < total, "running").otherwise("complete")
    return both.groupBy(keys[0]).agg(completed.alias("completed"), total.alias("total"), state.alias("state"))


def coarse_targets(frames: DataFrame, step: int = 8) -> DataFrame:
    """For every cell of a 1/step grid of the source, the flat index of the reference cell its centre maps to, or -100 outside."""
    rows = frames.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("height") / step) - 1)).alias("i"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("width") / step) - 1)).alias("j"))
    centre = lambda c: F.col(c) * step + step / 2
    cells = cells.withColumn("p", project("h", centre("j"), centre("i")))
    at = lambda c: F.bround((F.col(c) - step / 2) / step)
    x, y = at("p.x"), at("p.y")
    w, h = F.floor(F.col("width") / step), F.floor(F.col("height") / step)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return cells.select("frame_id", (F.col("i") * w + F.col("j")).alias("cell"), F.when(inside, (y * w + x).cast("long")).otherwise(F.lit(-100).cast("long")).alias("target"))
