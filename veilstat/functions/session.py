"""What operators ask of a session: a folder that all executors share, and frames whose lineage is cut there."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. A local session without one gets a temporary folder, removed at exit."""
    named = spark.conf.get(KEY, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {KEY} to a folder that driver and executors share; a temporary folder is only seen by one machine")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="veilstat-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _store(spark: SparkSession, path: str):
    """(path, its file system) as Spark's own readers see them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where, store = _store(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths in a folder of the shared store, in order; none if it is not there."""
    where, store = _store(spark, path)
    return sorted(s.getPath().toString() for s in store.listStatus(where)) if store.exists(where) else []


def touched(spark: SparkSession, path: str) -> None:
    """Makes an empty file in the shared store."""
    where, store = _store(spark, path)
    store.create(where).close()
