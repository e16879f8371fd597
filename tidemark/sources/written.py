"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage and survives the loss of executors. The cluster names the
folder in ``spark.checkpoint.dir``; only in one machine, as in tests, a local one is used where that is unset.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder. A local master gets a local one in its place; on a cluster, whose machines don't share one, an unset folder is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, deleted with this process's tables."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed at once (not when they are asked for) and read back from the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, "tables")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that nothing will read any more, such as those of the round before."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended, with it went the need
        return


@atexit.register
def drop_written() -> None:
    """Delete the tables of this process; results that read them must have been consumed."""
    while _written:
        _delete(*_written.pop())
