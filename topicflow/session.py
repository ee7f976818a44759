"""The shared folder and the materialising step every job uses."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session.

    Only a local session (tests, bench) may leave it unset; it then gets a folder
    of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="topicflow-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_dir(spark: SparkSession, name: str) -> str:
    """Path of a folder in the shared folder that does not exist yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once to the shared folder and go on from there.

    Used where a result is needed twice and must not be computed twice, or must
    not change between two uses; it survives the loss of executors.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*steps: DataFrame) -> None:
    """Delete what `materialize` wrote for these steps; nothing that reads them may run afterwards."""
    for step in steps:
        spark = step.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(step.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes the shuffle files of finished steps.

    Between long steps on much data; otherwise those files stay until the driver happens to need memory.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """A small scan dealt out to all cores; a large one as it is.

    Pattern search is heavy per row, and a small table may be one row group, which
    one task would read and search alone.  A scan with more splits than cores
    already keeps them all busy and is not shuffled; below that it is at most a
    file split per core.  Taking the rows out of a list again keeps later filters
    on this side of the shuffle, where the cores are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    rows = df.repartition(cores).select(F.explode(F.array(F.struct("*"))).alias("row"))
    return rows.select("row.*")
