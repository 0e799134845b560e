"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's own settings stay in force."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of a session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a fresh local one only if it is unset."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = context.getCheckpointDir()
    return path


def new_folder(spark: SparkSession) -> str:
    """Path of a new folder in the shared one; it goes with the session at the latest."""
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts lineage, survives lost executors, and gives later joins true
    sizes."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`materialize` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getName().startswith("table-"):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Names and paths in a folder; none if there is no such folder."""
    system, at = _at(spark, folder)
    return [(f.getPath().getName(), f.getPath().toString()) for f in system.listStatus(at)] if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with what is in it."""
    system, at = _at(spark, path)
    system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with its content, whole, unless there is one: of several at once one succeeds."""
    system, at = _at(spark, path)
    system.mkdirs(at.getParent())
    own = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(own, False)
    out.write(text.encode())
    out.close()
    try:
        if system.getUri().getScheme() == "file":  # a rename would replace the other's file here, a link does not
            os.link(own.toUri().getPath(), at.toUri().getPath())
            return True
        return system.rename(own, at)  # on shared file systems a rename to a name that is taken fails
    except FileExistsError:
        return False
    finally:
        system.delete(own, False)


def move_files(spark: SparkSession, folder: str, to: str) -> None:
    """Moves the data files of a written, partitioned table below another folder, partitions kept; then the first folder goes."""
    system, at = _at(spark, folder)
    root = system.makeQualified(at).toString().rstrip("/")
    files = system.listFiles(at, True)
    while files.hasNext():
        file = files.next().getPath()
        name = file.toString()[len(root) + 1 :]
        if file.getName()[0] not in "._":
            into = spark._jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/{name}")
            system.mkdirs(into.getParent())
            if not system.rename(file, into):
                raise OSError(f"{name} could not be moved")
    system.delete(at, True)


class Tables:
    """Intermediate tables of one job in the shared folder; all but its result are deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        self.kept.append(out)
        return out

    def done(self, result: DataFrame, *folders: str, keep: list | None = None) -> DataFrame:
        """The result, written; further ``folders`` named table-... are deleted with the kept tables, but not the tables in ``keep``."""
        result = materialize(result)
        for df in self.kept:
            if not any(df is k for k in keep or ()):
                discard(df)
        for folder in folders:
            _delete(self.spark, folder)
        self.kept = []
        return result
