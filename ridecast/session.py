"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    # Times in the data carry no zone; a fixed zone keeps casts to TIMESTAMP neutral.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # AQE sizes the shuffles, splits hot join keys and turns a sort-merge join into a
    # broadcast join once the measured side is small. No join here forces a broadcast
    # of data that grows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Where every partition of the smaller side measures below this, AQE hashes it and
    # spares the sort of the trips.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * 1024 * 1024),
}

# Paths below the shared folder that this process has handed out, by application.
_handed_out: dict[str, list[str]] = {}
# Tables that are written once and read by many jobs, by application and name.
_kept: dict[tuple, DataFrame | str] = {}
# Applications whose workers have this package.
_shipped: set[str] = set()


def build_session(app_name: str = "ridecast", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the library's defaults; `conf` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Where that is unset it is a folder in the warehouse, which the cluster shares as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ridecast"


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a written table or a stream's state."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address, or of a plain path."""
    return fs.FileSystem.from_uri(uri) if uri.startswith("file:") or "://" in uri else (fs.LocalFileSystem(), uri)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, so that they need no copy of their own."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    data, root = io.BytesIO(), Path(__file__).parent
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    address = f"{new_shared_path(spark, 'code')}.zip"
    system, path = file_system(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(address)
    _shipped.add(application)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a result that several jobs read: it is computed once, survives the loss of
    executors, and each reader scans only the columns it needs.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of an input, written at its first use in the application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _kept:
        _kept[key] = materialise(build(), name)
    return _kept[key]


def kept_path(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The same for something that is no table, a saved model say: `build` writes to the path."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _kept:
        path = new_shared_path(spark, name)
        build(path)
        _kept[key] = path
    return _kept[key]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it lies; nothing happens if it is absent."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession, written: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    handed_out = _handed_out.get(spark.sparkContext.applicationId, [])
    names = {path.rpartition("/")[2]: path for path in handed_out}
    for folder in {file.rpartition("/")[0].rpartition("/")[2] for file in written.inputFiles()}:
        if folder in names:
            delete_path(spark, names[folder])
            handed_out.remove(names[folder])


def clear_shared(spark: SparkSession) -> None:
    """Delete what this process has written below the shared folder; DataFrames that read it end."""
    application = spark.sparkContext.applicationId
    for path in _handed_out.pop(application, []):
        delete_path(spark, path)
    for key in [k for k in _kept if k[0] == application]:
        del _kept[key]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative fits a reliable place to cut their lineage."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
