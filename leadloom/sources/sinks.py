"""Sinks: files, appended and replaced tables, upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import fixed, text as t
from leadloom.operators.serve import serial_number
from leadloom.session import cut_lineage
from leadloom.sources.buckets import change_table, clear_table, read_table

OUTPUT_NAMES = [name for name, _ in fixed.OUTPUT_COLUMNS]


def to_output_schema(df: DataFrame, ord: str = "ord") -> DataFrame:
    """The 18 output columns, all text, numbered in ``ord`` order."""
    fallback = {"company_name": "name", "industry_type": "industry"}

    def value(field: str):
        options = [f for f in (field, fallback.get(field)) if f and f in df.columns]
        return t.first_filled(*[F.col(f).cast("string") for f in options]) if options else F.lit("")

    numbered = serial_number(df, ord, name="_serial")
    return numbered.select(*[
        (value(field) if field else F.col("_serial").cast("string")).alias(name) for name, field in fixed.OUTPUT_COLUMNS
    ])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; non-ASCII text is kept as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and the fixed columns; missing columns are blank."""
    have = set(df.columns)
    columns = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) if n in have else F.lit("").alias(n) for n in OUTPUT_NAMES]
    (df.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
            .csv(path).na.fill(""))


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_by_key(base: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key, one row per key.

    Of several new rows with a key the last by ``order`` stays (without an
    order, the one with the largest values).
    """
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("_last")).select(
        *keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest]) if rest else new.distinct()
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The served table as the last finished run left it; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_snapshot(df: DataFrame, path: str) -> None:
    """The rows of a finished run replace the served table; they are computed and staged first, and may come from it."""
    cut_lineage(df).write.mode("overwrite").parquet(path)


def upsert_table(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None, batch: int | None = None) -> None:
    """Rows of ``new`` replace stored rows with the same key; only their buckets are rewritten."""
    change_table(new, path, keys, lambda base, fresh: upsert_by_key(base, fresh, keys, order), batch)


def clear_jobs(spark: SparkSession, path: str) -> DataFrame | None:
    """Delete all job rows, on disk too; the empty table with its columns, None if there was no table."""
    columns = clear_table(spark, path)
    return None if columns is None else read_table(spark, path, columns)


def export_manifest(df: DataFrame) -> DataFrame:
    """Path, bytes and records of every file behind a file-based frame."""
    files = df.select("_metadata.file_path", "_metadata.file_size")
    return files.groupBy("file_path").agg(F.first("file_size").alias("bytes"), F.count("*").alias("records"))
