"""Session helpers: where iterative jobs may cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The folder named in ``spark.checkpoint.dir`` is used as it is.  Only a
    session with a local master and nothing configured (tests) gets a folder
    of its own.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        wanted = tempfile.mkdtemp(prefix="leadloom-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and continue from there.

    One pass over ``df``; what follows reads columns it needs from files that
    outlive any executor, and sees their size when it chooses joins.  With
    columns ``by`` (few values) there is a folder for each of their values.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """One side of a join that is shuffled, never collected by the driver and sent to all executors.

    For a side whose rows grow with the input.  Spark tells a small side by
    the bytes of the files below it, which say little of its rows: keys that
    count up take few bytes, and rows that are unnested count as one.
    """
    return df.hint("merge")


def spread(df: DataFrame, rows: bool = False) -> DataFrame:
    """Give every core something to do when the input has fewer splits than there are cores.

    Large inputs come in more splits than cores and pass through untouched,
    so nothing is shuffled for them.  With ``rows`` (short rows that much is
    made of) the rows are always dealt out, to several tasks a core: a file is
    split between its row groups only, so that a compact one has splits
    without rows and one with all of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if rows:
        return df.repartition(max(4 * cores, splits))
    return df if splits >= cores else df.repartition(cores)


#: Rows in a batch handed to Python.  Documents can be very long, so a batch is kept to few of them.
BATCH_ROWS = 512


def narrow_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python small enough for long documents (a smaller user setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


# settings worth having in a session that runs these jobs
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # building long expressions is several times faster without a recorded call site for each operator
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
