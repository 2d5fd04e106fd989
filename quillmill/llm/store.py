"""Intermediate tables in the folder that the driver and every executor share.

Iterative jobs cut their lineage by writing a table and reading it again: a
lost executor then costs at most the tasks of the step that is running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, plus a folder of this application.

    Only a local master without that setting gets a temporary folder (tests);
    on a cluster the missing setting is an error, as executors do not see the
    driver's disk.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quillmill-")
        _FOLDERS[app] = f"{base.rstrip('/')}/quillmill-{app}"
        atexit.register(release, spark, app)
    return _FOLDERS[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"quillmill-{spark.sparkContext.applicationId}/" in path:
            _delete(spark, path)


def release(spark: SparkSession, app: str) -> None:
    """Delete all of an application's intermediate tables, if it still runs."""
    folder = _FOLDERS.pop(app, None)
    try:
        if folder and spark.sparkContext._jsc is not None:
            _delete(spark, folder)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
