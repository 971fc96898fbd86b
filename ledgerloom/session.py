"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when a later stage needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every query relies on; cheap enough to call per query."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder.
    """
    global _local_scratch
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="ledgerloom-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints of RDDs go to the scratch folder, if the application names no place for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared scratch folder and read it back.

    Used where a plan would otherwise be recomputed with a different outcome
    (range bounds) or grow without end (iterations). Survives executor loss.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like `stage`, with the path of the copy, for loops that discard it later."""
    path = scratch_path(df.sparkSession, name)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)  # whose shuffle files nothing else reads
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def present(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever file system the path names."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged copy that nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their functions import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Another value of a setting for the jobs started inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_rows(spark: SparkSession, rows: int):
    """Another size of Arrow batches for the jobs started inside, for tables of narrow rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
