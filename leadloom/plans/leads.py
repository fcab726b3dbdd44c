"""Whole runs: from raw records to the finished lead table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leadloom.functions import fixed
from leadloom.operators.enrich import Lookups, enrich_company, enrich_location, enrich_lookup, enrich_text_only
from leadloom.operators.records import (
    clean_records, clean_records_basic, normalize_records, quality_filter, rename_long_names,
)
from leadloom.operators.resolve import dedupe, dedupe_exact
from leadloom.session import cut_lineage
from leadloom.sources.sinks import to_output_schema


def prepared(raw: DataFrame, threshold: str = fixed.MIN_QUALITY, lookups: Lookups | None = None) -> DataFrame:
    """Clean, filter, normalise, enrich and locate: one projection per step, no shuffle without lookups."""
    good = quality_filter(clean_records(raw), threshold)
    own = enrich_text_only(enrich_company(rename_long_names(normalize_records(good))))
    return enrich_location(own if lookups is None else enrich_lookup(own, lookups))


def lead_records(raw: DataFrame, threshold: str = fixed.MIN_QUALITY, lookups: Lookups | None = None,
                 prefix_rule: bool = True) -> DataFrame:
    """Prepared records with duplicates merged, in the record layout.

    The prepared records are read more than once by what follows; they are
    written once so that no text rule runs twice.
    """
    return dedupe(cut_lineage(prepared(raw, threshold, lookups)), prefix_rule)


def lead_table(raw: DataFrame, threshold: str = fixed.MIN_QUALITY, lookups: Lookups | None = None,
               prefix_rule: bool = True) -> DataFrame:
    """The finished table."""
    return to_output_schema(lead_records(raw, threshold, lookups, prefix_rule))


def lead_table_exact(raw: DataFrame, threshold: str = fixed.MIN_QUALITY) -> DataFrame:
    """The finished table with exact duplicates merged only: one shuffle and no rounds."""
    return to_output_schema(dedupe_exact(cut_lineage(prepared(raw, threshold))))


def lead_table_basic(raw: DataFrame, prefix_rule: bool = True) -> DataFrame:
    """The lighter run: basic cleaning, no quality filter, one enrichment pass."""
    own = enrich_location(enrich_company(normalize_records(clean_records_basic(raw))))
    return to_output_schema(dedupe(cut_lineage(own), prefix_rule))
