"""The session settings that the operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, and those that large inputs need.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts are large rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "oreflow", **settings: str) -> SparkSession:
    """A session with SETTINGS, overridden by settings (dots in names as underscores twice)."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once for each application; executors may have no copy."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="oreflow-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


#: Folders made where spark.checkpoint.dir is unset, by application.
_own: dict[str, str] = {}
#: Intermediate tables that still stand.
_standing: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own:
            folder = tempfile.mkdtemp(prefix="oreflow-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[context.applicationId] = f"file://{folder}"
        found = _own[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    path = f"{shared_dir(spark)}/oreflow/{name}-{uuid.uuid4().hex}"
    _standing.add(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there: the lineage ends, lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._oreflow_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all tasks, for much work on each row: a file of few row groups is read by as few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of materialised() that nothing reads any more."""
    delete(df.sparkSession, df._oreflow_path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _standing.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process: for when every result has been written."""
    for path in list(_standing):
        delete(spark, path)


def standing() -> set[str]:
    """The paths of the intermediate tables that stand now."""
    return set(_standing)


def release(spark: SparkSession, before: set[str], kept: DataFrame) -> None:
    """Delete the tables made since `before` but the one behind kept, a written result that needs none of them."""
    for path in _standing - before - {kept._oreflow_path}:
        delete(spark, path)
