"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: a folder of our own where spark.checkpoint.dir is unset, and the tables written so far.
_folders: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where it is unset. The session's settings stay as they are."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (conf.get("spark.master", "local") + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-barloom-")
        path = _folders[app]
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/barloom-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive any executor.

    The table stays until `discard` or `release`, since results are read from it whenever they are asked for.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and that nothing will read again."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _written.get(table.sparkSession.sparkContext.applicationId, ()):
            _delete(table.sparkSession, path)
            _written[table.sparkSession.sparkContext.applicationId].discard(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that `cut` wrote in this application: once its results are saved."""
    for path in _written.pop(spark.sparkContext.applicationId, ()):
        _delete(spark, path)
