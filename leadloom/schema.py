"""Record layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadloom.functions import fixed

RECORD_FIELDS = fixed.RAW_FIELDS + fixed.EXTRA_FIELDS
RECORD_SCHEMA = T.StructType(
    [T.StructField("ord", T.LongType())] + [T.StructField(f, T.StringType()) for f in RECORD_FIELDS]
)


def as_records(df: DataFrame, ord: Column | str = "ord") -> DataFrame:
    """Project any frame to the record layout; missing fields become empty strings."""
    have = set(df.columns)
    order = F.col(ord) if isinstance(ord, str) else ord
    return df.select(
        order.cast("long").alias("ord"),
        *[(F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("")).alias(f) for f in RECORD_FIELDS],
    )


def record(**fields: Column) -> list[Column]:
    """Columns of a record in layout order, empty where nothing is given."""
    unknown = set(fields) - set(RECORD_FIELDS) - {"ord"}
    if unknown:
        raise ValueError(f"not record fields: {sorted(unknown)}")
    return [fields[f].cast("string" if f != "ord" else "long").alias(f) if f in fields else F.lit("").alias(f)
            for f in ["ord", *RECORD_FIELDS] if f != "ord" or "ord" in fields]
