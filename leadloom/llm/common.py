"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.session import cut_lineage, narrow_batches

__all__ = ["cut_lineage", "fresh", "may_hold", "narrow_batches", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def fresh(wanted: str, taken: list[str]) -> str:
    """A column name like ``wanted`` that clashes with none of ``taken`` (names are compared without case)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def held(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def may_hold(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``df`` with a boolean ``may_hold``: false only where ``key`` is surely not among the keys of ``wanted``.

    A set of ``bits`` bits, one per hash value, goes to every executor: at most
    bits / 64 rows of 16 bytes, however many keys there are, so its size is
    bounded by the parameter (2^24 bits: 262,144 rows, 4 MB).  With more keys
    it only keeps more rows than needed.  A null key counts as a key.
    """
    word, mask, slot = fresh("word", df.columns), fresh("mask", df.columns), fresh("slot", df.columns)

    def slots(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(bits))

    words = (
        wanted.select(slots(key).alias(slot))
        .groupBy(F.floor(F.col(slot) / 64).cast("int").alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias(mask))
    )
    found = df.withColumn(slot, slots(key)).withColumn(word, F.floor(F.col(slot) / 64).cast("int"))
    found = found.join(F.broadcast(words), word, "left")
    bit = F.expr(f"coalesce(shiftrightunsigned({mask}, cast({slot} % 64 as int)) & 1L, 0L) = 1L")
    return found.withColumn("may_hold", bit).drop(word, mask, slot)


def arrow(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


Batches = Iterator[pa.RecordBatch]
