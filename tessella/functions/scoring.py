"""Column functions that judge a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geo import col

#: Thresholds of the verdict and of the radar axes.
MIN_INLIERS, MIN_RATIO, MAX_ROTATION_STD, MAX_RMSE, MAX_CONDITION = 20, 0.5, 15.0, 3.0, 5.0
#: What a reason that holds a keyword suggests to do next; in order.
NEXT_STEPS = (
    ("inlier ratio", "restrict candidate matches to the ground that both footprints cover"),
    ("rotation-consistency", "match crater neighbourhoods instead of single appearances"),
    ("rmse", "doubt the correspondences themselves before refining the fit further"),
    ("only", "adapt the matcher to this terrain so that more matches are found"),
)
DEFAULT_STEP = "no rule fits these reasons: read them"
NO_STEP = "passes every threshold: nothing to correct"


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def verdict(total, inliers, ratio, rmse, rotation_std, min_inliers=MIN_INLIERS, min_ratio=MIN_RATIO, max_rotation_std=MAX_ROTATION_STD, max_rmse=MAX_RMSE) -> Column:
    """(validated, label, reasons): five rules, reasons in rule order. A missing rmse and a missing spread are reasons too."""
    total, inliers, ratio = col(total), col(inliers), col(ratio)
    rmse, spread = col(rmse).cast("double"), col(rotation_std).cast("double")
    reasons = F.array_compact(
        F.array(
            F.when((total < min_inliers) | (inliers < min_inliers), F.format_string(f"only %d inliers of %d matches, %d needed", inliers.cast("long"), total.cast("long"), F.lit(min_inliers))),
            F.when(ratio < min_ratio, F.format_string("inlier ratio %.2f below %.2f", ratio.cast("double"), F.lit(float(min_ratio)))),
            F.when(_missing(rmse), F.lit("no valid rmse after refinement")).when(rmse >= max_rmse, F.format_string("rmse after refinement %.2f px, limit %.2f px", rmse, F.lit(float(max_rmse)))),
            F.when(_missing(spread), F.lit("rotation-consistency unknown: too few points")).when(spread > max_rotation_std, F.format_string("rotation-consistency spread %.1f deg, limit %.1f deg", spread, F.lit(float(max_rotation_std)))),
        )
    )
    ok = F.size(reasons) == 0
    return F.struct(ok.alias("validated"), F.when(ok, "validated").otherwise("exploratory").alias("label"), reasons.alias("reasons"))


def next_steps(validated, reasons) -> Column:
    text = F.lower(F.array_join(col(reasons), " "))
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in NEXT_STEPS]))
    return F.when(col(validated), F.array(F.lit(NO_STEP))).when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_STEP)))


def higher_is_better(value, threshold: float) -> Column:
    return col(value) / threshold * 100


def lower_is_better(value, threshold: float) -> Column:
    v = col(value)
    return F.when(v == 0, 999.0).when(v > 0, threshold / v * 100)


def radar(inliers, ratio, rotation_std, rmse, condition, cap: float = 160.0) -> Column:
    """Array of (axis, pct, available): each axis as a percentage of its threshold, capped; 0 where unavailable."""
    axes = [
        ("inlier_count", higher_is_better(inliers, MIN_INLIERS)),
        ("inlier_ratio", higher_is_better(ratio, MIN_RATIO)),
        ("rotation_consistency", lower_is_better(rotation_std, MAX_ROTATION_STD)),
        ("rmse", lower_is_better(rmse, MAX_RMSE)),
        ("condition_ratio", lower_is_better(condition, MAX_CONDITION)),
    ]
    return F.array(*[F.struct(F.lit(n).alias("axis"), F.coalesce(F.least(p, F.lit(cap)), F.lit(0.0)).alias("pct"), p.isNotNull().alias("available")) for n, p in axes])


def improvement_pct(before, after) -> Column:
    """How much smaller an error got, in percent; null without a positive error before or an error after."""
    return F.when((col(before) > 0) & col(after).isNotNull(), (col(before) - col(after)) / col(before) * 100)


def availability(value, reason: str) -> Column:
    """A value with a flag, and a reason where it is missing."""
    v = col(value)
    return F.struct(v.isNotNull().alias("available"), v.alias("value"), F.when(v.isNull(), F.lit(reason)).alias("reason"))


def finite(x) -> Column:
    """Null for NaN: Spark orders NaN above all numbers, and averages spread it."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))
