"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every run wants. Shuffle partitions are left to the caller: the cluster sets a
# large number and adaptive execution merges the small ones.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "fleetloom", master: str | None = None, extra: dict | None = None) -> SparkSession:
    """Session with the library's defaults; ``master`` is only for local use, a cluster supplies its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can see, as the cluster names it in ``spark.checkpoint.dir``.

    A local session may lack the setting and gets a temporary folder; a cluster without it is an error,
    because a machine-local folder would lose data with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = getattr(spark, "_fleetloom_root", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="fleetloom-")
        spark._fleetloom_root = root
    return root


_FOLDERS: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession, label: str) -> str:
    """New, unused folder below the shared root. It belongs to this Python process and is removed when that ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark keeps it; one that is not there is fine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _FOLDERS.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application: functions that run there import it."""
    context = spark.sparkContext
    if getattr(context, "_fleetloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Built on the driver, which serves it to the executors.
    archive = os.path.join(tempfile.mkdtemp(prefix="fleetloom-package-"), "fleetloom")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
    context._fleetloom_shipped = True


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor cannot change rows already numbered."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
