"""Serving queries over the finished table, and job history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.session import cut_lineage


def named(c: str, unknown: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", unknown).otherwise(F.col(c))


def kpis(companies: DataFrame, jobs: DataFrame, erp: str = "erp_software", status: str = "status") -> DataFrame:
    """One row: companies, companies with an ERP, jobs, jobs still running."""
    left = companies.agg(F.count("*").alias("total_companies"),
                         F.count_if(F.coalesce(F.col(erp), F.lit("")) != "").alias("companies_with_erp"))
    right = jobs.agg(F.count("*").alias("total_jobs"), F.count_if(F.col(status) == "Running").alias("active_jobs"))
    return left.join(right)  # one row on both sides


def count_by(df: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    return df.groupBy(named(column, unknown).alias("name")).agg(F.count("*").alias("value"))


def search_records(df: DataFrame, text: str = "", equal: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring over all values together, and equality filters ("all" means any)."""
    out = df
    for c, v in (equal or {}).items():
        if v != "all":
            out = out.filter(F.col(c) == v)
    if text:
        together = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns or df.columns])
        out = out.filter(F.contains(F.lower(together), F.lit(text.lower())))
    return out


def facets(df: DataFrame, column: str, ord: str = "ord") -> DataFrame:
    """Distinct non-empty values with the place where each is first seen."""
    filled = df.filter(F.coalesce(F.col(column), F.lit("")) != "")
    return filled.groupBy(F.col(column).alias("facet")).agg(F.min(ord).alias("first_seen"))


def sort_records(df: DataFrame, column: str, ascending: bool = True, tie: str = "ord") -> DataFrame:
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(key, F.col(tie).asc())


def page_of_records(df: DataFrame, page: int, size: int = 20, order: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(order or ["ord"])).offset(page * size).limit(size)


def page_after(df: DataFrame, last: int | str | None, size: int = 20, key: str = "ord") -> DataFrame:
    """The page after a key value: deep pages cost as much as the first one."""
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(key).limit(size)


def record_by_id(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.col(f"`{c}`").cast("string") == value)
    return df.filter(hit).orderBy(*[f"`{c}`" for c in columns]).limit(1)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest state of every job, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return last.select(key, *[f"s.{c}" for c in rest]).select(*df.columns)


def job_history(updates: DataFrame, key: str = "id", order: list[str] | None = None, start: str = "startTime") -> DataFrame:
    """Latest state per job, newest first."""
    return latest_per_key(updates, key, order or [start]).orderBy(F.col(start).desc(), F.col(key).asc())


def progress_percent(done: Column, total: Column) -> Column:
    return F.least(F.lit(15) + F.floor(done / total * 70), F.lit(84))


def job_progress(steps: DataFrame, job: str, ord: str) -> DataFrame:
    """Progress of a job after each of its steps (5 at the start, 85 scraped, 100 done are set by the caller)."""
    # written first: a join of plain shuffles can be split where a job is large
    totals = cut_lineage(steps.groupBy(job).agg(F.count("*").alias("total_steps")))
    counted = number_rows(steps, [job], ord, "steps_done").join(totals, job)
    return counted.withColumn("progress", progress_percent(F.col("steps_done"), F.col("total_steps")))


def source_yield(df: DataFrame, source: str, query: str, failed: Column) -> DataFrame:
    """Rows and errors per source and query, per source, and in total."""
    return df.rollup(F.col(source).alias("source"), F.col(query).alias("query")).agg(
        F.count("*").alias("n_rows"), F.count_if(failed).alias("n_errors"),
        F.grouping_id().cast("int").alias("level"))


_LOCAL_BITS = 33  # row ids hold the partition above and the row of the partition below this bit


def number_rows(df: DataFrame, by: list[str], ord: str, name: str) -> DataFrame:
    """1..n in ``ord`` order within each group, without one task per group.

    The rows are spread over sampled, equally filled ranges of (group, ord)
    and written once with their place in their range; the sizes of the
    ranges, one row per partition, turn that into places in the whole table.
    A group that holds most of the rows lies over many ranges.
    """
    c = F.col
    ranged = df.repartitionByRange(*by, ord).sortWithinPartitions(*by, ord)
    written = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    placed = written.withColumn("_part", F.shiftright("_row", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = c("_row").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", c("_offset") + local + 1)
    if by:
        starts = cut_lineage(numbered.groupBy(*by).agg(F.min("_rank").alias("_start")))
        numbered = numbered.join(starts, by).withColumn("_rank", c("_rank") - c("_start") + 1)
    return numbered.select(*df.columns, c("_rank").cast("long").alias(name))


def serial_number(df: DataFrame, ord: str = "ord", name: str = "serial") -> DataFrame:
    """1..n over the whole table in ``ord`` order."""
    return number_rows(df, [], ord, name)
