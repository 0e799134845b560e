"""Descriptor matching and statistics over match points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import Tables, materialize


def l2(a, b):
    """Distance of two descriptors."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def hamming(a, b):
    """Distance of two binary descriptors kept as arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; what it may be off is a 1e-12th of the squares."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _two_of(d: np.ndarray, ids: np.ndarray, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row of ``d`` its two least, ties to the smaller id: row numbers, ids and distances. ``exact(rows, columns)`` gives
    the distances of those that the product can't tell apart."""
    k = min(2, d.shape[1])
    cut = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(d <= (cut + 1e-9 * (1 + cut) + 1e-11 * d.max(initial=0))[:, None])
    far = exact(row, col)
    order = np.lexsort((ids[col], far, row))
    row, col, far = row[order], col[order], far[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], ids[col[rank < k]], far[rank < k]


def _cell_matches(binary: bool, back: bool):
    """Two nearest of a cell's queries among its train descriptors, and the other way if asked (``way`` 1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            x, y = (np.array(t["descriptor"].to_pylist(), np.int64 if binary else np.float64) for t in (left, right))
            qi, ti = left["kp_id"].to_numpy(), right["kp_id"].to_numpy()
            for start in range(0, len(x), 1000):
                part = x[start : start + 1000]
                if binary:
                    d = sum(np.bitwise_count((part[:, None, i] ^ y[None, :, i]).view(np.uint64)).astype(np.float64) for i in range(y.shape[1]))
                    exact = lambda r, c, d=d: d[r, c]
                else:
                    d, exact = _far(part, y), lambda r, c, p=part: np.sqrt(((p[r] - y[c]) ** 2).sum(axis=1))
                ways = [(0, qi[start : start + 1000], *_two_of(d, ti, exact))]
                if back:
                    ways.append((1, ti, *_two_of(d.T, qi[start : start + 1000], lambda r, c, e=exact: e(c, r))))
                for way, own, row, other, far in ways:
                    for k, v in zip(out, (np.full(len(row), way), own[row], other, far), strict=True):
                        k.append(v)
        made = [np.concatenate(v) if v else np.zeros(0) for v in out]
        key = (left if left.num_rows else right)["key"]
        keys = key.slice(0, 1).take(pa.array(np.zeros(len(made[0]), np.int64))) if key.length() else key
        return pa.table({"key": keys, "way": pa.array(made[0].astype(np.int32)), "q": pa.array(made[1].astype(np.int64)), "t": pa.array(made[2].astype(np.int64)), "dist": pa.array(made[3].astype(np.float64))})

    return run


def two_nearest(queries: DataFrame, train: DataFrame, block: str = "block", distance=l2, back: bool = False, rows: int = 4000) -> DataFrame:
    """``(block, way, q, t, dist, r)``: each query's two nearest train descriptors of its block, r 1 and 2, ties to the smaller id; with
    ``back`` also each train descriptor's two nearest queries, as ``way`` 1. ``distance`` is :func:`l2` over numbers or
    :func:`hamming` over longs. A null block or descriptor takes no part; descriptors of a block have one length.

    Exact: both sides of a block are dealt into matrices of about ``rows`` descriptors; pairs of matrices are the cells of a
    grid, each a matrix product that leaves two rows a query. So a block of very many descriptors spreads over many tasks.
    """
    kind = queries.schema[block].dataType.simpleString()
    clean = lambda df: df.where(F.col(block).isNotNull() & F.col("descriptor").isNotNull()).select(F.col(block).alias("key"), F.col("kp_id").cast("long").alias("kp_id"), "descriptor")
    a, b = clean(queries), clean(train)
    count = lambda df, n: df.groupBy("key").agg(F.ceil(F.count("*") / rows).cast("int").alias(n))
    parts = materialize(count(a, "na").join(count(b, "nb").hint("merge"), "key"))  # a row a block
    deal = lambda df, own, other, na, nb: df.join(parts.hint("merge"), "key").select("key", F.pmod(F.hash("kp_id"), F.col(na)).alias(own), F.explode(F.sequence(F.lit(0), F.col(nb) - 1)).alias(other), "kp_id", "descriptor")
    cell = ["key", "qa", "tb"]
    left, right = deal(a, "qa", "tb", "na", "nb"), deal(b, "tb", "qa", "nb", "na")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell_matches(distance is hamming, back), f"key {kind}, way int, q long, t long, dist double")
    best = F.row_number().over(Window.partitionBy("key", "way", "q").orderBy("dist", "t"))
    return found.withColumn("r", best).where("r <= 2").withColumnRenamed("key", block)


def _passing(two: DataFrame, ratio: float, block: str) -> DataFrame:
    best = two.groupBy(block, "way", "q").agg(F.min(F.struct("r", "dist", "t")).alias("a"), F.max(F.struct("r", "dist")).alias("z"))
    return best.where((F.col("z.r") == 2) & (F.col("a.dist") < ratio * F.col("z.dist"))).select(block, "way", "q", F.col("a.t").alias("t"), F.col("a.dist").alias("dist"))


def ratio_matches(queries: DataFrame, train: DataFrame, ratio: float = 0.75, block: str = "block", distance=l2) -> DataFrame:
    """(block, q, t, dist) of each query's nearest train descriptor in its block that beats the second nearest by Lowe's ratio."""
    return _passing(two_nearest(queries, train, block, distance), ratio, block).drop("way")


def mutual_matches(src: DataFrame, ref: DataFrame, ratio: float = 0.75, block: str = "block", distance=l2) -> DataFrame:
    """Pairs that choose each other, each passing the ratio test in its direction; distances are worked out once."""
    both = _passing(two_nearest(src, ref, block, distance, back=True), ratio, block)
    there, back = both.where("way = 0").drop("way"), both.where("way = 1").select(block, F.col("q").alias("t"), F.col("t").alias("q"))
    return there.join(back.hint("merge"), [block, "q", "t"])


def match_confidence(matches: DataFrame, key: str = "block") -> DataFrame:
    """1 - distance over the pair's largest distance."""
    top = F.max("dist").over(Window.partitionBy(key))
    return matches.withColumn("confidence", F.when(top > 0, 1 - F.col("dist") / top).otherwise(1.0))


def filter_confident(points: DataFrame, floor: float) -> DataFrame:
    return points.where(F.col("confidence") >= floor)


def with_errors(points: DataFrame, homographies: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Adds each point's reprojection error under its run's transform, and whether it is an inlier."""
    from tessella.functions.transforms import reprojection_error

    joined = points.join(homographies.select("run_id", "h"), "run_id", "left")
    out = joined.withColumn("reproj_error_px", reprojection_error("h", "src_x", "src_y", "ref_x", "ref_y")).drop("h")
    return out.withColumn("inlier", F.coalesce(F.col("reproj_error_px") <= threshold, F.lit(False)))


def run_rmse(points: DataFrame) -> DataFrame:
    return points.groupBy("run_id").agg(F.sqrt(F.avg(F.col("reproj_error_px") * F.col("reproj_error_px"))).alias("rmse"))


def direct_rmse(points: DataFrame) -> DataFrame:
    """Root mean square of plain coordinate differences."""
    d = F.pow(F.col("src_x") - F.col("ref_x"), 2) + F.pow(F.col("src_y") - F.col("ref_y"), 2)
    return points.groupBy("run_id").agg(F.sqrt(F.avg(d)).alias("rmse"))


def inlier_stats(points: DataFrame) -> DataFrame:
    inliers = F.count_if("inlier")
    return points.groupBy("run_id").agg(
        F.count("*").alias("total"), inliers.alias("inliers"), (inliers / F.count("*")).alias("ratio"), F.avg("reproj_error_px").alias("mean_error"), F.max("reproj_error_px").alias("max_error")
    )


def inliers_at(points: DataFrame, thresholds: list[float]) -> DataFrame:
    """Inliers, ratio and rmse of each run at several thresholds, in one pass over the points."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = points.select("run_id", "reproj_error_px", at.alias("threshold"))
    own = F.when(F.col("reproj_error_px") <= F.col("threshold"), F.col("reproj_error_px"))
    return rows.groupBy("run_id", "threshold").agg(F.count(own).alias("inliers"), (F.count(own) / F.count("*")).alias("ratio"), F.sqrt(F.avg(own * own)).alias("rmse"))


def _cell(v: str, size: float, n: int):
    """Only the top edge is clamped: negative coordinates keep negative cells."""
    return F.least(F.floor(F.col(v) / (size / n)), F.lit(n - 1)).cast("long")


def uniformity(points: DataFrame, width: float, height: float, n: int = 6) -> DataFrame:
    """Spread over mean of the counts in all n x n cells of the reference frame, empty ones too. 0 is even; null without points in the frame."""
    inside = points.withColumn("cx", _cell("ref_x", width, n)).withColumn("cy", _cell("ref_y", height, n)).where(f"cx between 0 and {n - 1} and cy between 0 and {n - 1}")
    counts = inside.groupBy("run_id", "cx", "cy").agg(F.count("*").alias("c"))
    sums = counts.groupBy("run_id").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    mean = F.col("s") / (n * n)
    return sums.select("run_id", (F.sqrt(F.greatest(F.col("s2") / (n * n) - mean * mean, F.lit(0.0))) / mean).alias("uniformity"))


def heatmap(points: DataFrame, width: float, height: float, n: int = 4) -> DataFrame:
    """Counts per cell of the source frame; both edges are clamped."""
    cell = lambda v, size: F.greatest(F.lit(0), F.least(F.floor(F.col(v) / (size / n)), F.lit(n - 1))).cast("long")
    return points.groupBy("run_id", cell("src_y", height).alias("row"), cell("src_x", width).alias("col")).agg(F.count("*").alias("n"))


def spatial_cap(points: DataFrame, width: float, height: float, n: int = 6, most: int = 12) -> DataFrame:
    """The first ``most`` points, by match order, of each cell of the reference frame."""
    df = points.withColumn("cell_x", _cell("ref_x", width, n)).withColumn("cell_y", _cell("ref_y", height, n))
    order = Window.partitionBy("run_id", "cell_x", "cell_y").orderBy("match_idx")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _turns(least: float):
    """Number, mean and sum of squared deviations of the turns of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        run_id, b1, b2 = (table.column(c)[:1] for c in ("run_id", "b1", "b2"))
        at = {c: table.column(c).to_numpy() for c in ("b", "match_idx", "src_x", "src_y", "ref_x", "ref_y")}
        order = np.argsort(at["match_idx"], kind="stable")
        i, j = (order[at["b"][order] == b[0].as_py()] for b in (b1, b2))
        same, turns = b1[0].as_py() == b2[0].as_py(), [np.zeros(0)]
        for start in range(0, len(i), 64):  # some rows of the pairs at a time stay in the cache
            rows, cols = i[start : start + 64, None], j[None, start if same else 0 :]
            sx, sy, rx, ry = (at[c][cols] - at[c][rows] for c in ("src_x", "src_y", "ref_x", "ref_y"))
            good = (sx * sx + sy * sy > least * least) & (rx * rx + ry * ry > least * least)
            if same:
                good &= at["match_idx"][rows] < at["match_idx"][cols]
            if not good.all():
                sx, sy, rx, ry = (v[good] for v in (sx, sy, rx, ry))
            turns.append(np.arctan2(sx * ry - sy * rx, sx * rx + sy * ry).ravel())
        d = np.degrees(np.concatenate(turns))
        d[d == 180] = -180
        mean = d.mean() if len(d) else 0.0
        return pa.table({"run_id": run_id, "n": pa.array([len(d)], pa.int64()), "m": [float(mean)], "q": [float(np.square(d - mean).sum())]})

    return run


def rotation_consistency(points: DataFrame, least: float = 1e-3, block: int = 512) -> DataFrame:
    """Population spread of the wrapped angle differences between source and reference vectors over all pairs i < j of a run;
    pairs with a vector of ``least`` or shorter don't count.

    All pairs of a run are what the figure is defined over. Points of a run are cut into blocks; a point goes to the pairs of
    blocks that its own is in, and each pair of blocks is one row of moments, so no row a pair is made and a run spreads over many tasks.
    """
    names = ["match_idx", "src_x", "src_y", "ref_x", "ref_y"]
    p = points.select("run_id", *names).where(" and ".join(f"{c} is not null" for c in names)).withColumn("b", F.floor(F.col("match_idx") / block))
    p = p.select("run_id", "b", "match_idx", *[F.col(c).cast("double").alias(c) for c in names[1:]])
    blocks = materialize(p.select("run_id", "b").distinct())
    grid = blocks.withColumnRenamed("b", "b1").join(blocks.withColumnRenamed("b", "b2").hint("merge"), "run_id").where("b1 <= b2")
    grid = grid.select("run_id", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("b"))
    dealt = p.hint("merge").join(grid, ["run_id", "b"])
    parts = dealt.groupBy("run_id", "b1", "b2").applyInArrow(_turns(least), f"run_id {points.schema['run_id'].dataType.simpleString()}, n long, m double, q double").where("n > 0")
    n, own = F.sum("n"), Window.partitionBy("run_id")
    centre = F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own)
    off = F.col("m") - F.col("c")
    return parts.withColumn("c", centre).groupBy("run_id").agg(F.sqrt(F.sum(F.col("q") + F.col("n") * off * off) / n).alias("rotation_std"), F.first("c").alias("mean_rotation"), n.alias("n_pairs"))


def best_matcher(candidates: DataFrame, least_points: int = 4, scorer=None) -> DataFrame:
    """Per pair the matcher of the highest score (inlier ratio unless ``scorer`` gives another Column); ties to the first in order. All scores are kept."""
    score = scorer() if scorer else F.col("inlier_ratio")
    rows = candidates.withColumn("score", F.when(F.col("n_points") >= least_points, score).otherwise(0.0))
    return rows.groupBy("pair_id").agg(
        F.max_by("matcher", F.struct("score", (-F.col("ord")).alias("o"))).alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("matcher", "score")))).alias("scores"),
    )


def confidence_histogram(points: DataFrame, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long")
    return points.groupBy("run_id", at.alias("bin")).agg(F.count_if("inlier").alias("inliers"), F.count_if(~F.col("inlier")).alias("outliers"))


def confidence_density(points: DataFrame, steps: int = 50, bandwidth: float = 0.08, digits: int = 4) -> DataFrame:
    """Gaussian kernel density of confidence on ``steps`` places from 0 to 1, for inliers and outliers. Equal confidences (to
    ``digits``) are counted first, so the sum runs over distinct values, not over points."""
    counted = points.groupBy("inlier", F.round("confidence", digits).alias("c")).agg(F.count("*").alias("n"))
    grid = counted.select("inlier", "c", "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    x = F.col("i") / (steps - 1)
    u = (x - F.col("c")) / bandwidth
    return grid.groupBy("inlier", "i").agg((F.sum(F.col("n") * F.exp(-u * u / 2)) / (F.sum("n") * bandwidth * 2.5066282746310002)).alias("density"))


def confidence_by_class(points: DataFrame) -> DataFrame:
    return points.groupBy("run_id").agg(F.avg(F.when(F.col("inlier"), F.col("confidence"))).alias("inlier_mean"), F.avg(F.when(~F.col("inlier"), F.col("confidence"))).alias("outlier_mean"))


def display_sample(points: DataFrame, most: int) -> DataFrame:
    """About ``most`` inliers of each run at even steps of match order, for drawing. A run is numbered in ranges, then over ranges."""
    lanes = points.where("inlier").withColumnsRenamed({"run_id": "lane", "match_idx": "task"})
    df = interleave(lanes).withColumnsRenamed({"lane": "run_id", "task": "match_idx"}).withColumn("r", F.col("turn") - 1).drop("turn")
    counts = df.groupBy("run_id").agg(F.count("*").alias("n"))
    return df.join(counts.hint("merge"), "run_id").where(F.col("r") % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0).drop("n")


def check_seeds(seeds: DataFrame, least: int = 4) -> DataFrame:
    """Manual seed pairs ``(run_id, src, ref, src_w, src_h, ref_w, ref_h)``: usable if there are enough and all lie in their frames."""
    inside = lambda p, w, h: (F.col(p)[0] >= 0) & (F.col(p)[0] < F.col(w)) & (F.col(p)[1] >= 0) & (F.col(p)[1] < F.col(h))
    ok = inside("src", "src_w", "src_h") & inside("ref", "ref_w", "ref_h")
    out = seeds.groupBy("run_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("inside"))
    reason = F.when(F.col("n") < least, F.format_string("%d seed pairs, %d needed", "n", F.lit(least))).when(~F.col("inside"), "a seed lies outside its frame")
    return out.withColumn("reason", reason).withColumn("usable", reason.isNull())


def interleave(lanes: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Round robin over lanes: first tasks of all lanes, then second ones. Lanes are dealt by ranges of tasks; a task's turn is
    its place in the range after those of its lane's earlier ranges, so a lane can be larger than a Spark task. The dealt table is
    one of ``tables``, if given."""
    dealt = (tables.keep if tables else materialize)(lanes.repartitionByRange("lane", "task").withColumn("__p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("lane", "__p").orderBy("task"))
    before = Window.partitionBy("lane").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("lane", "__p").agg(F.count("*").alias("n"))
    carry = counts.select(F.col("lane").alias("__l"), F.col("__p").alias("__q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__c"))
    both = dealt.withColumn("__r", inside).join(carry.hint("merge"), F.col("lane").eqNullSafe(F.col("__l")) & (F.col("__p") == F.col("__q")))
    return both.select(*lanes.columns, (F.col("__r") + F.col("__c")).alias("turn"))
