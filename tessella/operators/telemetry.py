"""Telemetry, as-of joins and orbital geometry of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geo import incidence_from_elevation, view_divergence


def telemetry_summary(records: DataFrame, key: str = "product_id") -> DataFrame:
    """Count, first and last by record number, means."""
    by = lambda f, c: f(c, "record_num")
    return records.groupBy(key).agg(
        F.count("*").alias("n"), by(F.min_by, "elevation").alias("first_elevation"), by(F.max_by, "elevation").alias("last_elevation"), F.avg("elevation").alias("mean_elevation"),
        by(F.min_by, "azimuth").alias("first_azimuth"), by(F.max_by, "azimuth").alias("last_azimuth"), F.avg(incidence_from_elevation("elevation")).alias("mean_incidence"),
    )


def nearest_record(acquisitions: DataFrame, records: DataFrame, tolerance_s: int = 60) -> DataFrame:
    """As-of join both ways: each acquisition with the record nearest in time within the tolerance, ties to the smaller record
    number; without one: nulls. Times fall into buckets of the tolerance's length; an acquisition asks its own and both
    neighbours, so the join is on equal keys, and the nearest is a partial minimum. Acquisitions of one time ask once, and of records
    of one time only the least number counts."""
    size = tolerance_s * 1_000_000
    asked = acquisitions.withColumn("us", F.unix_micros("ts"))
    a = asked.select("us").distinct().withColumn("bucket", F.explode(F.array(*[F.floor(F.col("us") / size) + i for i in (-1, 0, 1)])))
    others = [c for c in records.columns if c not in ("ts", "record_num")]
    r = records.select(F.unix_micros("ts").alias("rus"), "record_num", F.struct(*others).alias("rec") if others else F.lit(None).alias("rec"))
    r = r.groupBy("rus").agg(F.min_by("rec", "record_num").alias("rec"), F.min("record_num").alias("record_num")).withColumn("bucket", F.floor(F.col("rus") / size))
    gap = F.abs(F.col("us") - F.col("rus"))
    hits = a.hint("merge").join(r, "bucket").where(gap <= size)
    best = hits.groupBy("us").agg(F.min_by(F.struct("record_num", "rec", (gap / 1e6).alias("gap_s")), F.struct(gap.alias("g"), "record_num")).alias("b"))
    out = asked.join(best.hint("merge"), "us", "left").select(*acquisitions.columns, F.col("b.record_num").alias("record_num"), F.col("b.gap_s").alias("gap_s"), F.col("b.rec").alias("rec"))
    return out


#: Each level of buckets is so many times as wide as the one below, from a microsecond up.
_FAN, _LEVELS = 4, 31
# an interval [a, z) as whole buckets: at each level those that the next wider ones don't hold
_CUT = f"""aggregate(sequence(0, {_LEVELS - 1}), named_struct('a', a, 'z', z + 1, 'out', cast(array() as array<struct<level:int,bucket:bigint>>)), (st, l) ->
 if(st.a >= st.z, st, transform(array(named_struct('up', least((st.a + {_FAN - 1}) div {_FAN} * {_FAN}, st.z), 'down', (st.z div {_FAN}) * {_FAN})), k -> named_struct('a', (st.a + {_FAN - 1}) div {_FAN}, 'z', st.z div {_FAN}, 'out', concat(st.out,
  transform(filter(sequence(st.a, st.a + {_FAN}), x -> x < k.up), x -> named_struct('level', l, 'bucket', x)),
  transform(filter(sequence(st.z - {_FAN}, st.z), x -> x < st.z and x >= greatest(k.down, k.up)), x -> named_struct('level', l, 'bucket', x)))))[0])).out"""


def covering_file(times: DataFrame, coverage: DataFrame) -> DataFrame:
    """The first file by name whose interval [start, stop] holds a time.

    An interval is cut into whole buckets of microseconds, each level of buckets four times as wide, and only the first file
    of a bucket counts; a time asks its bucket at every level. Both are a bounded number of rows, however many intervals
    hold a time. Equal intervals are cut once and equal times ask once. Times before 1970 are moved up by a multiple of all widths.
    """
    shift = 1 << 2 * _LEVELS - 3
    c = coverage.select("file", (F.unix_micros("start") + shift).alias("a"), (F.unix_micros("stop") + shift).alias("z")).where("z >= a")
    c = c.groupBy("a", "z").agg(F.min("file").alias("file"))
    first = c.select("file", F.explode(F.expr(_CUT)).alias("c")).groupBy("c.level", "c.bucket").agg(F.min("file").alias("file"))
    levels = first.select("level").distinct()
    known = sorted(r.level for r in levels.collect())  # at most _LEVELS rows
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.expr(f"(unix_micros(ts) + {shift}L) div {_FAN**n}L").alias("bucket")) for n in known])) if known else F.explode(F.expr("cast(array() as array<struct<level:int,bucket:bigint>>)"))
    t = times.select("ts").distinct().select("ts", each.alias("c")).select("ts", "c.level", "c.bucket")
    best = t.join(first.hint("merge"), ["level", "bucket"]).groupBy("ts").agg(F.min("file").alias("file"))
    return times.join(best.hint("merge"), "ts", "left").select(*times.columns, "file")


def run_geometry(runs: DataFrame, acquisitions: DataFrame, telemetry: DataFrame, footprints: DataFrame) -> DataFrame:
    """Where both observers of a run were and the angle between their lines of sight. ``runs(run_id, src_id, ref_id)``,
    ``acquisitions(acq_id, ts)``, ``telemetry(ts, record_num, pos)``, ``footprints(product_id, target)``; the target comes from
    the source's footprint, else the reference's."""
    at = nearest_record(acquisitions, telemetry.where("pos is not null").select("ts", "record_num", "pos")).select("acq_id", F.col("rec.pos").alias("pos"))
    side = lambda s: at.select(F.col("acq_id").alias(f"{s}_id"), F.col("pos").alias(f"{s}_pos"))
    mark = lambda s: footprints.select(F.col("product_id").alias(f"{s}_id"), F.col("target").alias(f"{s}_target"))
    out = runs
    for s in ("src", "ref"):
        out = out.join(side(s).hint("merge"), f"{s}_id", "left").join(mark(s).hint("merge"), f"{s}_id", "left")
    out = out.withColumn("target", F.coalesce("src_target", "ref_target"))
    out = out.withColumn("divergence_deg", view_divergence("target", "src_pos", "ref_pos"))
    reason = F.when(F.col("target").isNull(), "no footprint").when(F.col("src_pos").isNull() | F.col("ref_pos").isNull(), "no position near the acquisition")
    return out.select("run_id", "src_pos", "ref_pos", "target", "divergence_deg", F.col("divergence_deg").isNotNull().alias("available"), reason.alias("reason"))
