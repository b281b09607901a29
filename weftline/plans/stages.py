"""Session settings, shared scratch tables and partition helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED_KEY = "spark.checkpoint.dir"


#: Shared folders made for applications without one, by application.
_made: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's spark.checkpoint.dir.

    Only where the setting is missing (local tests) a temporary folder is made,
    once per application, and removed at exit. A cluster without the setting is an error.
    """
    found = spark.conf.get(_SHARED_KEY, None) or spark.sparkContext.getConf().get(_SHARED_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{_SHARED_KEY} must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _made:
        folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _made[key] = f"file://{folder}"
    return _made[key]


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder, which is removed at its exit."""
    root = _scratch_root(spark)
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own folder that stays the same from call to call."""
    return f"{scratch_path(spark, 'x').rpartition('/')[0]}/kept-{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended before
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application: once its results are written, none is read again."""
    _remove(spark, _scratch_root(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a bare key up to which a table, once counted, is sent to all executors.
SMALL_KEYS = 250_000


def sent_if_small(keys: DataFrame, most: int = SMALL_KEYS) -> DataFrame:
    """A table of bare keys, marked for sending only if it has been counted to at most `most` rows; else it is joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done with; their results are tables by then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, whatever their search path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Removes a table written by materialize that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/weftline/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Round-robins df over the cores when its scan has fewer partitions than there are cores.

    Meant for Python-heavy maps over a table kept in few files; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
