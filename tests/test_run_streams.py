"""Runs that come out of order: held until the watermark has reached them, and scored as in one batch."""

import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import history
from tessella.streaming import runs as streams

SCHEMA = "id long, sensor_type string, rmse double"


def _runs(n: int) -> list[tuple]:
    """One sensor has nearly all runs, one name is null, some values are NaN or null."""
    rng = np.random.default_rng(3)
    kinds = ["hot"] * 8 + ["b", None]
    return [(i, kinds[i % 10], None if i % 23 == 0 else math.nan if i % 17 == 0 else float(v)) for i, v in enumerate(rng.normal(1e6, 1e-2, n))]


def _plain(rows: list[tuple]) -> dict:
    seen, out = {}, {}
    for i, sensor, x in sorted(rows):
        prior = seen.setdefault(sensor, [])
        centre = [p - 1e6 for p in prior]
        enough = len(prior) >= 2
        out[i] = (len(prior), statistics.fmean(centre) if enough else None, statistics.stdev(centre) if enough else None)
        if x is not None and not math.isnan(x):
            prior.append(x)
    return out


def _check(got, want: dict) -> None:
    assert len(got) == len(want)
    for r in got:
        n, mean, std = want[r.id]
        assert r.n_prior == n
        assert (r.baseline_mean is None) == (mean is None)
        if mean is not None:
            assert r.baseline_mean - 1e6 == pytest.approx(mean, abs=1e-8) and r.baseline_std == pytest.approx(std, rel=1e-5)


def test_batch_in_blocks(spark):
    """Ranges of 16 ids; values of a million that differ by hundredths keep their spread."""
    rows = _runs(400)
    frame = spark.createDataFrame(rows, SCHEMA)
    _check(history.flag_anomalies(frame, block=16).collect(), _plain(rows))
    start = history.moments(frame.where("id < 150"), ("sensor_type",), F.when(~F.isnan("rmse"), F.col("rmse")))
    rest = history.flag_anomalies(frame.where("id >= 150"), block=16, start=start).collect()
    _check(rest, {i: w for i, w in _plain(rows).items() if i >= 150})
    assert history.flag_anomalies(frame.where("id < 0")).count() == 0


def test_equal_values_have_no_spread(spark):
    rows = [(i, "s", 0.1) for i in range(300)]
    got = history.flag_anomalies(spark.createDataFrame(rows, SCHEMA), block=7).collect()
    assert not any(r.anomalous for r in got) and all(r.baseline_std == 0 for r in got if r.n_prior >= 2)


def _files(spark, rows: list[tuple], at: str, cuts: list[list[int]]) -> None:
    """A file a trigger with the runs of the given ids; the time of a run is its id in minutes."""
    by_id = {r[0]: r for r in rows}
    for k, ids in enumerate(cuts):
        frame = spark.createDataFrame([by_id[i] for i in ids], SCHEMA).withColumn("time", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000))
        frame.coalesce(1).write.mode("append").parquet(at)
        for name in os.listdir(at):
            if name.endswith(".parquet") and not os.path.exists(f"{at}/.{name}.seen"):
                os.utime(f"{at}/{name}", (1_600_000_000 + k, 1_600_000_000 + k))
                open(f"{at}/.{name}.seen", "w").close()


def _run(spark, at: str, out: str, delay: str) -> None:
    stream = spark.readStream.schema(f"{SCHEMA}, time timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    q = streams.score_to(streams.in_order(stream, "time", delay, parts=4), out, block=16)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)


def test_out_of_order_runs(spark, tmp_path):
    """Neighbouring triggers hold each other's runs; the scores are those of the order of ids. The last runs wait for later ones."""
    rows = _runs(240)
    src, out = str(tmp_path / "runs"), str(tmp_path / "out")
    cuts = [[i for i in range(240) if (i + (i * 7) % 30) // 80 == k] for k in range(4)]
    assert sorted(sum(cuts, [])) == list(range(240)) and max(cuts[0]) > min(cuts[1])
    _files(spark, rows, src, [c for c in cuts if c])
    _run(spark, src, out, "40 minutes")
    got = streams.scored_runs(spark, out).collect()
    assert sorted(r.id for r in got) == list(range(240 - 40))
    _check(got, {i: w for i, w in _plain(rows).items() if i < 200})
    kept = sorted(int(d) for d in os.listdir(f"{out}/state") if d.isdigit())
    assert len(kept) <= 2
    # the query goes on where it ended: a run far later lets the others go
    rows.append((100_000, "b", 1e6))
    _files(spark, rows, src, [[100_000]])
    _run(spark, src, out, "40 minutes")
    _check(streams.scored_runs(spark, out).collect(), {i: w for i, w in _plain(rows).items() if i < 240})


def test_late_runs_stay(spark, tmp_path):
    """A run that comes after the watermark is scored against all that was scored before; nothing is dropped."""
    rows = [(i, "s", float(i)) for i in range(60)]
    src, out = str(tmp_path / "runs"), str(tmp_path / "out")
    _files(spark, rows, src, [[*range(5), *range(6, 30)], [*range(30, 50)], [5, *range(50, 60)]])
    _run(spark, src, out, "0 seconds")
    got = {r.id: r.n_prior for r in streams.scored_runs(spark, out).collect()}
    assert sorted(got) == list(range(60)) and got[6] == 5 and got[5] >= 28 and got[59] == 59


def test_trigger_run_again(spark, tmp_path):
    """A trigger that failed after writing its rows replaces them and counts once."""
    rows, out = _runs(60), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = {}

    class Fake:  # takes the function that a writer would call
        def foreachBatch(self, f):
            kept["f"] = f

    class Stream:
        writeStream = Fake()

    streams.score_to(Stream(), out)
    for batch, part in ((0, "id < 30"), (1, "id >= 30"), (1, "id >= 30")):
        kept["f"](frame.where(part), batch)
    _check(streams.scored_runs(spark, out).collect(), _plain(rows))
