"""Run history as streams."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.functions.scoring import finite
from tessella.operators.history import flag_anomalies, moments
from tessella.session import discard, listed, materialize, new_folder, remove, settings
from tessella.sources.labels import pds4_fields, telemetry

#: Endings of the files that Spark's text reader unpacks.
_PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")

SCORED = "id long, sensor_type string, rmse double, n_prior long, baseline_mean double, baseline_std double, anomalous boolean"


def _score(limit: float):
    def step(key: tuple, batches, state: GroupState):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("id")
        out = []
        for r in rows.itertuples():
            x = r.rmse
            std = math.sqrt(m2 / (n - 1)) if n >= 2 else None
            known = x is not None and not math.isnan(x)
            odd = bool(known and std and std > 0 and abs(x - mean) / std > limit)
            out.append((r.id, key[0], x, n, mean if n >= 2 else None, std, odd))
            if known:  # Welford's update, after the run was scored
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=["id", "sensor_type", "rmse", "n_prior", "baseline_mean", "baseline_std", "anomalous"])

    return step


def score_stream(runs: DataFrame, limit: float = 2.0) -> DataFrame:
    """Each arriving run against the running count, mean and spread of its sensor's earlier runs: the streaming twin of
    ``history.flag_anomalies``. Runs of one trigger are taken in order of id. State is three numbers a sensor."""
    return runs.select("id", "sensor_type", "rmse").groupBy("sensor_type").applyInPandasWithState(
        _score(limit), SCORED, "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout
    )


class _Hold(StatefulProcessor):
    """Keeps rows until the watermark has come to their time. One timer a key, for the earliest row that waits."""

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t long, row string")
        self.next = handle.getValueState("next", "t long")

    def _wake(self, t: int) -> None:
        if self.next.exists():
            old = self.next.get()[0]
            if old <= t:
                return
            self.handle.deleteTimer(old - 1)
        self.handle.registerTimer(t - 1)  # a timer goes off when the watermark is past it
        self.next.update((t,))

    def handleInputRows(self, key, rows, timerValues):
        now, least = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            due = part["t"].isna() | (part["t"] <= now)
            if due.any():
                yield part.loc[due, ["row"]]
            waits = [(int(t), row) for t, row in zip(part["t"][~due], part["row"][~due])]
            if waits:
                self.rows.appendList(waits)
                first = min(t for t, _ in waits)
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due, waits = [], []
        for t, row in self.rows.get():
            if t <= now:
                due.append(row)
            else:
                waits.append((t, row))
        self.next.clear()
        self.rows.clear()
        if waits:
            self.rows.put(waits)
            self._wake(min(t for t, _ in waits))
        yield pd.DataFrame({"row": due}, dtype=object)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, time: str, delay: str = "10 minutes", parts: int = 64) -> DataFrame:
    """The rows of a stream, held back until the watermark (latest ``time`` less ``delay``) has reached them, so that rows of one
    trigger are never earlier than rows of triggers before. Rows that come later than that, or without a time, pass at once;
    none is dropped. The last rows of a stream wait until later ones come.

    State lies with ``parts`` keys by a hash of the row, so no key of the data gets a task of its own. Sets the RocksDB state
    store, which keyed state with timers needs, for queries that the session starts from now on.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), micros)
    # the time goes on as a number: rows with a watermark column would be dropped when late
    marked = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay).select(F.unix_millis("__at").alias("t"), row.alias("row"))
    held = marked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).groupBy("part").transformWithStateInPandas(_Hold(), "row string", "append", "eventTime")
    return held.select(F.from_json("row", stream.schema, micros).alias("r")).select("r.*")


def score_to(runs: DataFrame, folder: str, limit: float = 2.0, block: int = 1 << 16) -> DataStreamWriter:
    """Scores a stream of runs like ``history.flag_anomalies`` into ``folder/scored``, whatever share of the runs one sensor has.

    A trigger's runs are scored by two-level windows on top of each sensor's count, mean and squared deviations, and the sums
    after it are written to ``folder/state``, a table a trigger, the last two of which stay. A trigger that is run again reads
    the table before its own and replaces its rows, so every run is scored once. Put :func:`in_order` before it if runs come
    out of order; runs of one trigger are taken in order of id. Start what is returned, with a checkpoint location.
    """

    def score(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = materialize(rows.select("id", "sensor_type", "rmse"))
        made = sorted(int(name) for name, _ in listed(spark, f"{folder}/state") if name.isdigit() and int(name) < batch)
        start = spark.read.schema("sensor_type string, n long, mean double, m2 double").parquet(f"{folder}/state/{made[-1]}") if made else None
        scored = flag_anomalies(rows, limit, block=block, start=start)
        scored.select("id", "sensor_type", "rmse", "n_prior", "baseline_mean", "baseline_std", "anomalous").write.mode("overwrite").parquet(f"{folder}/scored/trigger={batch}")
        moments(rows, ("sensor_type",), finite("rmse"), start).write.mode("overwrite").parquet(f"{folder}/state/{batch}")
        for old in made[:-1]:
            remove(spark, f"{folder}/state/{old}")
        discard(rows)

    return runs.writeStream.foreachBatch(score)


def scored_runs(spark, folder: str) -> DataFrame:
    """What :func:`score_to` has written so far."""
    return spark.read.schema(f"{SCORED}, trigger long").parquet(f"{folder}/scored").drop("trigger")


def summary_stream(scored: DataFrame) -> DataFrame:
    """Running summary per sensor; write it in update or complete mode."""
    return scored.groupBy("sensor_type").agg(F.count("*").alias("n_runs"), F.avg(finite("rmse")).alias("mean_rmse"))


def telemetry_stream(spark, path: str) -> DataFrame:
    """New telemetry files of a folder as records."""
    lines = spark.readStream.format("text").load(path)
    return telemetry(lines.select("value", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.[^.]*)?$", 1).alias("product_id")))


def label_stream(spark, path: str, fields: Callable[[DataFrame], DataFrame] = pds4_fields, per_trigger: int = 20_000) -> DataFrame:
    """New label files of a folder, each a whole text, as rows of ``fields``: ``labels.pds4_fields``, ``labels.pds3_fields`` for
    detached keyword labels, or ``labels.footprint_rings``. None is left out, whatever fields it lacks. A trigger takes up to
    ``per_trigger`` files, so the plan of one stays small; :func:`drain` takes all."""
    # the binary reader opens a file without a copy of the whole Hadoop configuration, which takes the text reader most of its time;
    # but only the text reader unpacks
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(path)
    plain = files.where(~F.col("path").rlike(rf"\.({'|'.join(_PACKED)})$")).select("path", F.col("content").cast("string").alias("value"))
    packed = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{{{','.join(_PACKED)}}}").option("maxFilesPerTrigger", per_trigger).load(path)
    return fields(plain.unionByName(packed.select(F.col("_metadata.file_path").alias("path"), "value")))


def results_stream(spark, path: str, schema: str) -> DataFrame:
    """New JSON-lines result files of a folder."""
    return spark.readStream.schema(schema).json(path)


def enrich_stream(runs: DataFrame, products: DataFrame) -> DataFrame:
    """Stream of runs with the static product catalog; runs of unknown products stay."""
    return runs.join(products, "product_id", "left")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now and gives the rows it wrote: those of every trigger in append mode, those
    of the last one in complete mode. State and rows are in the shared folder.

    While it runs, a task takes as many small files as large ones by their bytes, and the files of a trigger are looked up by a few
    tasks; as Spark is set, that is a task for 32 files, and up to 10,000 tasks a trigger."""
    spark = stream.sparkSession
    at = new_folder(spark)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{at}/rows")
    else:
        w = w.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows"))
    with settings(spark, {"spark.sql.files.openCostInBytes": 1 << 14, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 2 * spark.sparkContext.defaultParallelism}):
        w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
