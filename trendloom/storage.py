"""The folder that all executors share, and intermediates written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, with its file system's scheme.

    Only a session on one machine (a local master, as in tests) may have none: it gets a new folder under /tmp.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        there = context._jsc.sc().getCheckpointDir()
        if there.isDefined():
            found = there.get()
        elif not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="trendloom-")
            context.setCheckpointDir(found)
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trendloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate, in a folder of this application."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediates of this application; for a job's end, when no DataFrame of the library is read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: cuts the lineage, and
    later reads survive the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input a core up to which rows are dealt anew, if they lie in fewer files than there are cores.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores where it is a small table in few files, which one core or a few would read.

    For functions that take long a row. A table of more than SPREAD_BYTES a core is left alone, since its files give tasks enough; so
    what is shuffled here never grows with the data.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SPREAD_BYTES:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
