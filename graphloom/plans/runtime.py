"""Session settings and the reliable lineage cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results depend on (text of timestamps) or that every plan wants.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime-changeable settings of SESSION_CONF on a session and return it."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    The folder named in spark.checkpoint.dir holds. Only a local-mode session without one gets a
    folder of its own; a cluster without one is refused, as a machine-local folder would be lost
    with its executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work row by row.

    Only an input that is too small to fill the cores is shuffled; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table of a scale folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
