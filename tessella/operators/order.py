"""Exact order statistics of large groups by refined histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import Tables

#: Bins of a round, a power of two.
BINS = 64


def _bin(value: Column, cuts: Column) -> Column:
    """How many of the BINS - 1 sorted cuts are at most the value, by binary search."""
    at, step = F.lit(0), BINS // 2
    while step:
        at = at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0)
        step //= 2
    return at


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], limit: int = 50_000) -> DataFrame:
    """``(*keys, p)``: exact quantiles of ``value`` per group, between order statistics by linear interpolation. Nulls and NaN don't
    count; a group of nothing else, like an empty table, has no row.

    Sketched cuts make bins of each group, bins are counted exactly (partial sums first), and the bin that holds a wanted rank is
    looked into further, as distinct values with their counts. Below ``limit`` rows a bin is ranked outright. So no task ever holds
    more than one bin of a group, however large the group.
    """
    tables = Tables(df.sparkSession)
    x = F.col(value).cast("double")
    live = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("__v"), F.lit(1).cast("long").alias("__n"))
    sizes = tables.keep(live.groupBy(*keys).agg(F.count("*").alias("__size")))
    at = [F.lit(float(f)) * (F.col("__size") - 1) for f in fractions]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    asked = tables.keep(sizes.select(*keys, F.explode(ranks).alias("__rank")).withColumn("__k", F.col("__rank")))  # at most two rows a fraction and group
    group, most = list(keys), sizes.agg(F.max("__size")).first()[0] or 0
    while most > limit:
        cuts = F.percentile_approx("__v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(10_000))
        split = tables.keep(live.groupBy(*group).agg(F.array_sort(cuts).alias("__cuts")))
        placed = live.join(split.hint("merge"), group).select(*live.columns, _bin(F.col("__v"), F.col("__cuts")).alias("__bin"))
        counts = tables.keep(placed.groupBy(*group, "__bin").agg(F.sum("__n").alias("__in")))  # at most BINS rows a group
        before = F.coalesce(F.sum("__in").over(Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("__before", before)
        fits = (F.col("__before") <= F.col("__k")) & (F.col("__k") < F.col("__before") + F.col("__in"))
        picked = asked.join(counts.hint("merge"), group).where(fits).select(*keys, "__rank", (F.col("__k") - F.col("__before")).alias("__k"), "__bin")
        asked = tables.keep(picked)
        on = [*keys, "__bin"] if group == list(keys) else [*group, "__bin"]
        inside = placed.join(asked.drop("__k").hint("merge"), on)
        group = [*keys, "__rank"]
        live = tables.keep(inside.groupBy(*group, "__v").agg(F.sum("__n").alias("__n")))
        asked = asked.drop("__bin")
        most = live.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if group == list(keys):
        live = live.groupBy(*keys, "__v").agg(F.sum("__n").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__v"))
    ranked = live.withColumn("__upto", upto)
    hit = asked.join(ranked.hint("merge"), group).where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__n") <= F.col("__k")))
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m")).join(sizes.hint("merge"), keys)
    out = []
    for a in at:
        lo, hi = F.floor(a), F.ceil(a)
        v = lambda r: F.element_at("__m", r)
        out.append(F.when(lo == hi, v(lo)).otherwise((hi - a) * v(lo) + (a - lo) * v(hi)))
    return tables.done(found.select(*keys, F.array(*out).alias("p")))
