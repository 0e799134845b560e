"""Run history: baselines, anomaly flags, summaries."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scoring import finite, next_steps, verdict
from tessella.session import create_once, discard, listed, materialize, move_files, read_text


def sensor_baseline(runs: DataFrame) -> DataFrame:
    """Mean and sample spread of rmse per sensor; NaN doesn't count; null below two runs."""
    x = finite("rmse")
    n = F.count(x)
    return runs.groupBy("sensor_type").agg(n.alias("n_runs"), F.when(n >= 2, F.avg(x)).alias("mean"), F.when(n >= 2, F.stddev_samp(x)).alias("std"))


def _sums_before(rows: DataFrame, keys: tuple, order: str, x: Column, block: int) -> DataFrame:
    """Adds ``__n, __s, __q``: how many values of ``x`` earlier rows of the same keys have, their sum and sum of squares.

    Two levels, so that no task gets all rows of a key: sums inside ranges of ``block`` numbers of ``order``, and running sums
    of range totals.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = rows.withColumn("__x", x).withColumn("__k", key).withColumn("__b", F.floor(F.col(order) / block))
    parts = {"n": F.count("__x"), "s": F.sum("__x"), "q": F.sum(F.col("__x") * F.col("__x"))}
    inside = Window.partitionBy("__k", "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__k", "__b").agg(*[v.alias(k) for k, v in parts.items()])
    carry = totals.select("__k", "__b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__c{k}") for k in parts])
    out = rows
    for k, v in parts.items():
        out = out.withColumn(f"__{k}", F.coalesce(v.over(inside), F.lit(0)))
    out = out.join(carry.hint("merge"), ["__k", "__b"])
    for k in parts:
        out = out.withColumn(f"__{k}", F.col(f"__{k}") + F.col(f"__c{k}"))
    return out.select(*rows.drop("__k", "__b").columns, *[f"__{k}" for k in parts])


def _apart(a: Column, b: Column) -> Column:
    """a - b, but 0 if they differ by rounding alone: the means of equal values have no spread."""
    return F.when(F.abs(a - b) > 1e-13 * F.greatest(F.abs(a), F.abs(b)), a - b).otherwise(0.0)


def _merged(one: tuple, two: tuple) -> tuple:
    """Count, mean and sum of squared deviations of two groups together."""
    (n1, a1, q1), (n2, a2, q2) = one, two
    d = _apart(a2, a1)
    share = n2 / F.greatest(n1 + n2, F.lit(1))
    return n1 + n2, F.when(n1 == 0, a2).otherwise(a1 + d * share), q1 + q2 + d * d * n1 * share


def _moments(x: Column) -> tuple:
    return F.count(x), F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))


def moments(rows: DataFrame, keys: tuple, x: Column, start: DataFrame | None = None) -> DataFrame:
    """``keys, n, mean, m2`` of the values of ``x`` (null doesn't count), on top of a table ``start`` of the same form."""
    n, a, q = _moments(x)
    out = rows.groupBy(*keys).agg(n.alias("n"), a.alias("mean"), q.alias("m2"))
    if start is None:
        return out
    both = out.withColumn("__k", F.struct(*keys)).alias("new").join(start.withColumn("__k", F.struct(*keys)).alias("old").hint("merge"), "__k", "full")
    sides = [tuple(F.coalesce(f"{side}.{c}", F.lit(0)) for c in ("n", "mean", "m2")) for side in ("old", "new")]
    return both.select(*[F.col(f"__k.{k}") for k in keys], *[c.alias(name) for c, name in zip(_merged(*sides), ("n", "mean", "m2"))])


def _moments_before(rows: DataFrame, keys: tuple, order: str, x: Column, block: int, start: DataFrame | None) -> DataFrame:
    """Adds ``__n, __mean, __m2``: count, mean and sum of squared deviations of ``x`` over ``start`` and earlier rows of the same keys.

    Two levels, so that no task gets all rows of a key: moments inside ranges of ``block`` numbers of ``order``, and those of
    all ranges before, about the key's first mean so that they keep their digits. A null of a key is a value like others.
    """
    k, b = F.struct(*keys), F.floor(F.col(order) / block)
    rows = rows.withColumn("__x", x).withColumn("__k", F.struct(k.alias("k"), b.alias("b")))
    totals = rows.groupBy("__k").agg(*[m.alias(name) for m, name in zip(_moments(F.col("__x")), "naq")]).select(F.col("__k").alias("__r"), "n", "a", "q")
    by = Window.partitionBy("__r.k").orderBy("__r.b")
    centre = F.coalesce(F.first(F.when(F.col("n") > 0, F.col("a")), True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    total = lambda v: F.coalesce(F.sum(v).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = _apart(F.col("a"), F.col("c"))
    carry = totals.withColumn("c", centre).select("__r", "c", total("n").alias("n"), total(F.col("n") * off).alias("s"), total(F.col("q") + F.col("n") * off * off).alias("t"))
    n, s, t = F.col("n"), F.col("s"), F.col("t")
    some = F.greatest(n, F.lit(1))
    earlier = (n, F.when(n > 0, F.col("c") + s / some).otherwise(0.0), F.greatest(t - s * s / some, F.lit(0.0)))
    carry = carry.select("__r", *[c.alias(f"__c{i}") for i, c in enumerate(earlier)])
    if start is not None:
        old = start.select(F.struct(*keys).alias("__s"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(("n", "mean", "m2"))])
        carry = carry.join(old.hint("merge"), F.col("__r.k") == F.col("__s"), "left")
        both = _merged(tuple(F.coalesce(f"__o{i}", F.lit(0)) for i in range(3)), tuple(F.col(f"__c{i}") for i in range(3)))
        carry = carry.select("__r", *[c.alias(f"__c{i}") for i, c in enumerate(both)])
    inside = Window.partitionBy("__k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, a, q = (f(F.col("__x")).over(inside) for f in (F.count, F.avg, F.var_pop))
    out = rows.select("*", n.alias("__i0"), F.coalesce(a, F.lit(0.0)).alias("__i1"), F.coalesce(q, F.lit(0.0)).alias("__i2"))
    out = out.withColumn("__i2", F.col("__i2") * F.col("__i0")).join(carry.hint("merge"), F.col("__k") == F.col("__r"))
    both = _merged(tuple(F.col(f"__c{i}") for i in range(3)), tuple(F.col(f"__i{i}") for i in range(3)))
    return out.select(*[f"`{c}`" for c in rows.drop("__k", "__x").columns], *[c.alias(name) for c, name in zip(both, ("__n", "__mean", "__m2"))])


def flag_anomalies(runs: DataFrame, limit: float = 2.0, keys: tuple = ("sensor_type",), block: int = 1 << 16, start: DataFrame | None = None) -> DataFrame:
    """Each run against earlier runs (by id) of its sensor only: anomalous if more than ``limit`` spreads from their mean.

    Below two earlier runs, without spread, or with a NaN or null rmse a run is never anomalous. A null sensor is a sensor, and a
    null id comes before all others. ``start`` holds the
    :func:`moments` of runs that are earlier than all of these.
    """
    x = finite("rmse")
    out = _moments_before(runs, keys, "id", x, block, start)
    n, known = F.col("__n"), F.col("__n") >= 2
    out = out.withColumn("n_prior", n).withColumn("baseline_mean", F.when(known, F.col("__mean"))).withColumn("baseline_std", F.when(known, F.sqrt(F.col("__m2") / (n - 1))))
    far = F.when(F.col("baseline_std") > 0, F.abs(x - F.col("baseline_mean")) / F.col("baseline_std") > limit)
    return out.withColumn("anomalous", F.coalesce(far, F.lit(False))).drop("__n", "__mean", "__m2")


def sensor_summary(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("sensor_type").agg(
        F.count("*").alias("n_runs"),
        F.avg(finite("rmse")).alias("mean_rmse"),
        F.avg("inlier_ratio").alias("mean_inlier_ratio"),
        F.avg("uniformity").alias("mean_uniformity"),
        F.count_if("anomalous").alias("n_anomalous"),
    )


def same_sensor_baseline(runs: DataFrame, pattern: str = "%self_pair%") -> DataFrame:
    """Range of inlier ratios over runs whose source path matches, case aside (``_`` stands for any character)."""
    hit = runs.where(F.col("src_path").ilike(pattern) & finite("inlier_ratio").isNotNull())
    return hit.groupBy("sensor_type").agg(F.min("inlier_ratio").alias("min_ratio"), F.max("inlier_ratio").alias("max_ratio"), F.count("*").alias("n")).withColumn("available", F.col("n") > 0)


def latest_runs(runs: DataFrame, limit: int = 200, sensor: str | None = None) -> DataFrame:
    return (runs.where(F.col("sensor_type") == sensor) if sensor else runs).orderBy(F.desc("id")).limit(limit)


def rmse_trend(runs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Running mean of rmse over each sensor's runs."""
    out = _sums_before(runs, ("sensor_type",), "id", finite("rmse"), block)
    n, s = F.col("__n") + F.col("__x").isNotNull().cast("int"), F.col("__s") + F.coalesce("__x", F.lit(0.0))
    return out.withColumn("trend", F.when(n > 0, s / n)).drop("__x", "__n", "__s", "__q")


def result_field(runs: DataFrame, path: str, name: str) -> DataFrame:
    return runs.withColumn(name, F.get_json_object("result_json", path))


def _grams(c: str, q: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(F.col(c), i, F.lit(q))))


def _frequent_grams(paths: DataFrame, q: int) -> DataFrame:
    """``(gram, shares)`` of substrings that a thousandth of the paths or more hold, in the measure of about 100,000 sampled ones: by how
    many keys their rows are dealt, so that a key has about a thousandth of the paths. What matches doesn't depend on it."""
    part = min(1.0, 100_000 / max(1, paths.count()))
    seen = materialize(paths.sample(part, seed=1).select("src_path"))
    least = max(1.0, seen.count() / 1000)
    counts = seen.where(F.length("src_path") >= q).select(F.explode(_grams("src_path", q)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return materialize(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(10_000).select("gram", F.ceil(F.col("n") / least).cast("int").alias("shares")))


def _gram_matches(paths: DataFrame, ids: DataFrame, q: int, small: bool) -> DataFrame:
    """Products are listed under the substring of q code points that the fewest of them have, under a frequent one of the paths only if they
    have no other; a small list goes to the paths, else both are dealt by substring."""
    own = materialize(ids.select("product_id", "ord", F.explode(_grams("product_id", q)).alias("gram")))
    rare = own.groupBy("gram").agg(F.count("*").alias("n"))
    asked = paths.where(F.length("src_path") >= q).select("id", "src_path", F.explode(_grams("src_path", q)).alias("gram"))
    if small:
        index = materialize(own.join(rare.hint("merge"), "gram").groupBy("product_id", "ord").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")))
        hits = asked.join(F.broadcast(index), "gram")
    else:
        hot = _frequent_grams(paths, q)
        choice = own.join(rare.hint("merge"), "gram").join(F.broadcast(hot), "gram", "left")
        index = materialize(choice.groupBy("product_id", "ord").agg(F.min(F.struct(F.coalesce("shares", F.lit(0)).alias("shares"), "n", "gram")).alias("g")).select("product_id", "ord", "g.gram", "g.shares"))
        used = index.where("shares > 0").select("gram", F.lit(True).alias("used")).distinct()
        hot = materialize(hot.join(used.hint("merge"), "gram", "left").select("gram", "shares", F.coalesce("used", F.lit(False)).alias("used")))
        index = index.select("product_id", "ord", "gram", F.explode(F.sequence(F.lit(0), F.greatest(F.col("shares"), F.lit(1)) - 1)).alias("share"))
        asked = asked.join(F.broadcast(hot), "gram", "left").where("used is null or used")
        asked = asked.select("id", "src_path", "gram", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")), F.lit(0)).cast("int").alias("share"))
        hits = asked.join(index.hint("merge"), ["gram", "share"])
    return hits.where(F.contains("src_path", "product_id")).select("id", "product_id", "ord")


def product_matches(paths: DataFrame, products: DataFrame, gram: int = 8, small: int = 10_000) -> DataFrame:
    """``(id, product_id, ord)`` of every product whose id occurs in a path of ``paths(id, src_path)``, through indexes of q-grams.

    Each product is listed under one of its substrings of ``gram`` code points; ids shorter than that have an index of their own, of
    substrings as long as the shortest. Paths are probed with all theirs, and a hit counts if the whole id is there. An index of up to
    ``small`` products is broadcast. Empty and null ids never match.
    """
    ids = materialize(products.where("length(product_id) > 0").select("product_id", "ord").distinct())
    short = F.length("product_id") < gram
    found = []
    for own in (ids.where(short), ids.where(~short)):
        n, q = own.agg(F.count("*"), F.min(F.length("product_id"))).first()
        if n:
            found.append(_gram_matches(paths, own, min(gram, q), n <= small))
    if not found:
        return paths.limit(0).join(F.broadcast(ids), F.contains("src_path", "product_id")).select("id", "product_id", "ord")
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0]


def enrich_with_products(runs: DataFrame, products: DataFrame, gram: int = 8, small: int = 10_000) -> DataFrame:
    """Adds the first product (by ``ord``, then by id) whose id occurs in a run's source path; runs without one stay."""
    hit = product_matches(runs.select("id", "src_path"), products, gram, small)
    best = hit.groupBy("id").agg(F.min(F.struct("ord", "product_id"))["product_id"].alias("product_id"))
    return runs.join(best.hint("merge"), "id", "left")


def _reserve(spark, path: str, count: int) -> int:
    """Reserves ``count`` ids after all that are taken and gives the last id before them. The log is a folder of numbered files, each
    with the last id taken then; a number can be created once only, so of two writers one tries again with the next."""
    log = f"{path.rstrip('/')}/_ids"
    while True:
        taken = [(int(name), at) for name, at in listed(spark, log) if name.isdigit()]
        if taken:
            version, at = max(taken)
            top = int(read_text(spark, at))
        else:  # a history from before the log, or none
            version = 0
            try:
                top = spark.read.option("mergeSchema", "true").parquet(path).agg(F.max("id")).first()[0] or 0
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                top = 0
        if create_once(spark, f"{log}/{version + 1:020d}", str(top + count)):
            return top


def append_runs(new: DataFrame, path: str) -> None:
    """Appends runs, numbered by sensor, time and path after all ids taken so far, to a table partitioned by sensor. Writers may
    append at once: each reserves its ids first. Files come to the table when all are written; a writer that fails leaves a gap
    in the ids and no rows. An empty table appends nothing."""
    spark = new.sparkSession
    # sorted rows get a partition and a place in it; the row counts of earlier partitions make that a number
    rows = materialize(new.drop("id").orderBy("sensor_type", "ts", "src_path").withColumn("__m", F.monotonically_increasing_id()))
    count = rows.count()
    if count:
        top = _reserve(spark, path, count)
        placed = rows.withColumn("__p", F.shiftright("__m", 33))
        before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        starts = placed.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
        numbered = placed.join(starts.hint("merge"), "__p").withColumn("id", F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1 + top)
        # two jobs can't write to one folder at once, so each has its own, hidden from readers
        hidden = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
        numbered.drop("__p", "__m", "__s").write.partitionBy("sensor_type").parquet(hidden)
        move_files(spark, hidden, path)
    discard(rows)


def read_history(spark, path: str) -> DataFrame:
    """All runs; files of older, narrower schemas give nulls for later columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def compute_missing(features: DataFrame, cache: DataFrame, compute, params: str) -> DataFrame:
    """Rows of the feature cache for every input: keys are hashes of file fingerprint and sorted parameters; only missing ones are computed."""
    key = F.substring(F.sha1(F.concat(F.col("file_hash"), F.lit(params))), 1, 20)
    wanted = features.withColumn("key", key)
    fresh = compute(wanted.join(cache.select("key").hint("merge"), "key", "left_anti"))
    return cache.join(wanted.select("key").distinct().hint("merge"), "key", "left_semi").unionByName(fresh, allowMissingColumns=True)


def run_reports(runs: DataFrame, craters: DataFrame, nearest: DataFrame, geometry: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One wide row a run: its verdict, reasons and next steps, what is known of its product's ground, of the nearest named
    feature, of both observers and of the sun. ``runs(run_id, product_id, total, inliers, ratio, rmse, rotation_std, ...)``; the
    other tables have a row a product or a run, and what they lack is null."""
    judged = runs.withColumn("v", verdict("total", "inliers", "ratio", "rmse", "rotation_std"))
    judged = judged.select(*runs.columns, "v.validated", "v.label", "v.reasons", next_steps("v.validated", "v.reasons").alias("next_steps"))
    ground = craters.select("product_id", "area_km2", F.col("n").alias("n_craters"), "min_d", "max_d", "mean_d", "density")
    near = nearest.select(F.col("point_id").alias("product_id"), F.col("name").alias("nearest_name"), F.col("km").alias("nearest_km"))
    seen = geometry.select("run_id", "divergence_deg", F.col("reason").alias("geometry_reason"))
    sun = telemetry.select("product_id", F.col("n").alias("n_records"), "mean_incidence")
    out = judged
    for table, key in ((ground, "product_id"), (near, "product_id"), (seen, "run_id"), (sun, "product_id")):
        out = out.join(table.hint("merge"), key, "left")
    return out
