"""Continuous runs: arriving record files, job states, and duplicates seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions import fixed
from leadloom.operators.resolve import exact_keys, merge_cluster
from leadloom.operators.serve import latest_per_key
from leadloom.plans.leads import prepared
from leadloom.schema import RECORD_SCHEMA
from leadloom.sources.buckets import change_table
from leadloom.sources.sinks import upsert_table

_KEYS = ["name_key", "site_key", "mail_key"]


def record_stream(spark: SparkSession, folder: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Record files as they arrive in a folder."""
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def merge_into_table(new: DataFrame, path: str, batch: int | None = None) -> None:
    """Merge prepared records into the stored table on the exact key.

    The table is bucketed by that key: only buckets that hold a key of the
    batch are read and rewritten, and there only stored rows whose key occurs
    in the batch are merged again.  The batch is prepared once and written.
    A batch that comes again changes nothing.
    """
    def merge(base: DataFrame, fresh: DataFrame) -> DataFrame:
        touched = fresh.select(*_KEYS).distinct()
        again = base.join(touched, _KEYS, "left_semi").unionByName(fresh.select(*base.columns))
        merged = merge_cluster(again, _KEYS).drop("n_records").select(*base.columns)
        return base.join(touched, _KEYS, "left_anti").unionByName(merged)

    change_table(new.withColumns(exact_keys()), path, _KEYS, merge, batch)


def stream_uploads(records: DataFrame, path: str, checkpoint: str, threshold: str = fixed.MIN_QUALITY) -> StreamingQuery:
    """Run every arriving batch through the record steps and merge it into the stored table."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_into_table(prepared(batch, threshold), path, batch_id)

    return (records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def job_states(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest update per job as a running aggregate: one row of state per job."""
    rest = [c for c in updates.columns if c != key]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return last.select(key, *[F.col(f"s.{c}") for c in rest])


def stream_job_state(updates: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table with the latest state of every job, bucketed by job: a batch rewrites the buckets of its jobs."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        upsert_table(latest_per_key(batch, key, order), path, [key], batch=batch_id)

    return (job_states(updates, key, order).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_dedupe(records: DataFrame, time: str, keys: list[str], horizon: str) -> DataFrame:
    """Drop rows whose key was seen within the horizon; state older than that is let go."""
    return records.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def new_records(records: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key the stored table does not have: no limit in time, no state."""
    fresh = records.dropDuplicates(keys)
    return fresh.join(stored.select(*keys).distinct(), keys, "left_anti")
