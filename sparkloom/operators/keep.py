"""Tables that iterations read again and again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir: a folder that driver and executors share. Where that is unset and all tasks run on this machine,
    as in tests, a new local one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return _own["folder"]


def kept(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, which cuts its lineage; plans of iterations would grow with every round otherwise.
    Callers unpersist what they no longer read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """df as a table in the shared folder, for a state that each round of an iteration makes anew; `before`, the table of
    the last round, is deleted once this one is there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before is not None:
        discard(before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that written() gave."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
