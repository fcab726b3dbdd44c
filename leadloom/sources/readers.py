"""Sources: parameter files, result files, record sources and the source registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.functions import text as t
from leadloom.operators import knowledge, listing
from leadloom.operators.params import params_from_table
from leadloom.schema import RECORD_FIELDS, as_records, record
from leadloom.session import cut_lineage


def _with_order(df: DataFrame) -> DataFrame:
    """Arrival order: file and place in it.  Increasing, not consecutive."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_params(spark: SparkSession, path: str, fmt: str = "csv", drop_nan: bool = False) -> DataFrame:
    """Search parameters from CSV (a byte order mark is ignored) or a JSON array."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif fmt == "json":
        raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    else:
        raise ValueError("only csv and json files are supported")
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return params_from_table(_with_order(clean), drop_nan=drop_nan)


def with_default_ids(df: DataFrame, position: Column) -> DataFrame:
    """``id`` and ``SL No.`` default to the 1-based position."""
    place = position.cast("string")
    out = df
    for c in ("id", "SL No."):
        out = out.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("string"), place) if c in df.columns else place)
    return out


def load_results(spark: SparkSession, path: str, table: DataFrame | None = None) -> DataFrame:
    """The stored table if it has rows, else the results file with default ids."""
    from leadloom.operators.serve import serial_number

    if table is not None and not table.isEmpty():
        return table
    raw = _with_order(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))
    return with_default_ids(serial_number(raw, name="_n"), F.col("_n")).drop("_n", "ord")


def union_sources(**sources: DataFrame) -> DataFrame:
    """Records of all sources in one layout; each source gives its name to the rows that have none."""
    if not sources:
        raise ValueError("no sources")
    parts = []
    for name, df in sources.items():
        rows = as_records(df)
        parts.append(rows.withColumn("source", t.first_filled(F.col("source"), F.lit(name))))
    return reduce(DataFrame.unionByName, parts)


def seeds_to_records(seeds: DataFrame) -> DataFrame:
    """Seeds as raw records: inline contacts, source note, website or profile link."""
    c = F.col
    site = c("source_name").isin("indiamart_website", "justdial_website")
    listed = c("source_name").contains("indiamart") | c("source_name").contains("justdial")
    note = F.concat(F.lit("Source: "), c("source_name"), F.lit(" | Confidence: "), c("confidence").cast("string"))
    empty = F.lit("")
    return seeds.select(*record(
        ord=c("ord"),
        phone=F.coalesce("inline_phone", empty), email=F.coalesce("inline_email", empty),
        address=F.coalesce("inline_address", empty), country=F.lit("India"), source=c("source_name"),
        source_url=c("url"), website=F.when(site, c("url")).otherwise(""),
        additional_info=F.when(~site & listed, F.concat(note, F.lit(" | Profile: "), c("url"))).otherwise(note),
    ))


# --- registry --------------------------------------------------------------

SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_source(name: str, mapper: Callable[[DataFrame], DataFrame]) -> None:
    """Add a source: a function from pages (page_id, query, url, html) to records."""
    SOURCES[name] = mapper


for _name, _mapper in {
    "discovery": listing.bing_records,
    "google": listing.web_records,
    "maps": listing.maps_records,
    "website": listing.website_records,
    "linkedin": listing.linkedin_records,
    "indiamart": lambda pages: listing.indiamart_records(listing.listing_seeds(pages, ["query"])),
    "tradeindia": lambda pages: listing.site_records(pages, "tradeindia"),
    "justdial": listing.card_records,
    "clutch": listing.clutch_records,
    "goodfirms": listing.goodfirms_records,
    "searx": listing.searx_records,
    "direct_website": lambda pages: listing.website_records(pages, "direct_website"),
    "google_places": lambda pages: knowledge.places_records(
        pages.select(F.col("page_id").alias("ord"), "query", F.col("html").alias("answer"))),
}.items():
    register_source(_name, _mapper)


def records_from_pages(pages: DataFrame, source: str) -> DataFrame:
    """Records of the pages fetched for one source."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    return as_records(SOURCES[source](pages))


def page_of(source: str) -> Column:
    """The page a record of a source was made from: its ``ord`` is the page, with the place in it below that."""
    return F.floor(F.col("ord") / 10) if source == "google_places" else F.shiftright("ord", 20)


def records_by_page(pages: DataFrame, sources: list[str], profiles: DataFrame | None = None) -> DataFrame:
    """Records of every listed source with source_pos (place in the list), page_id and their place ``ord``; written.

    The pages are read once and written by source; each source then reads and
    parses its own folder only.  ``profiles`` (page_id, url, html) completes
    the records from the pages they point to.
    """
    stored = cut_lineage(pages.filter(F.col("source").isin(*sources)), "source")
    parts = [
        records_from_pages(stored.filter(F.col("source") == s).drop("source"), s).withColumns(
            {"source_pos": F.lit(i), "page_id": page_of(s)})
        for i, s in enumerate(sources)
    ]
    whole = cut_lineage(reduce(DataFrame.unionByName, parts))
    return whole if profiles is None else cut_lineage(listing.with_profiles(whole, profiles))


def records_of_all(pages: DataFrame, sources: list[str], profiles: DataFrame | None = None) -> DataFrame:
    """Records of every listed source from pages that carry their source name, numbered by source, then by place.

    The records of all sources are written once and numbered, so that no two
    of them share an ``ord``.
    """
    from leadloom.operators.serve import serial_number

    place = F.struct("source_pos", "ord", F.xxhash64(*RECORD_FIELDS).alias("row"))
    whole = records_by_page(pages, sources, profiles).withColumn("_place", place).drop("ord")
    return serial_number(whole, "_place", "ord").select("ord", *RECORD_FIELDS)
