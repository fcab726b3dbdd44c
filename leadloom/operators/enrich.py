"""Filling gaps: from the record's own text, from lookup tables, from a second record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import facts, fixed, places
from leadloom.functions.text import bind, fill_missing, first_filled, norm_key
from leadloom.operators.records import _with
from leadloom.schema import RECORD_FIELDS
from leadloom.session import cut_lineage


def _text(*fields: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def enrich_company(df: DataFrame) -> DataFrame:
    """Industry, size, turnover, branches, contact and ERP from the record's own text.

    Software found in the text replaces what the record had.
    """
    c = F.col
    own = df.withColumn("_text", _text("company_name", "industry", "description", "additional_info", "address"))
    text = c("_text")
    own = own.withColumn("_kind", first_filled(c("industry_type"), c("industry"), facts.industry_of_text(text)))
    kind = c("_kind")
    info = F.substring(c("additional_info"), 1, 300)
    filled = _with(own, {
        "industry_type": kind,
        "industry": first_filled(c("industry"), kind),
        "employee_count": fill_missing(c("employee_count"), facts.employee_band(text)),
        "turnover": fill_missing(c("turnover"), facts.turnover(text)),
        "branch_count": fill_missing(c("branch_count"), facts.branch_count(text)),
        "contact_name": fill_missing(c("contact_name"), facts.contact_name(text)),
        "erp_software": first_filled(facts.detect_erp(text), c("erp_software")),
        "description": fill_missing(c("description"), F.when(F.length(info) > 20, info)),
    })
    return filled.drop("_text", "_kind")


def enrich_text_only(df: DataFrame) -> DataFrame:
    """Second, guarded pass over description, info and name."""
    c = F.col
    own = df.withColumn("_text", _text("description", "additional_info", "company_name"))
    text = c("_text")
    return _with(own, {
        "employee_count": fill_missing(c("employee_count"), facts.employee_band(text)),
        "turnover": fill_missing(c("turnover"), facts.turnover(text)),
        "erp_software": fill_missing(c("erp_software"), facts.erp_by_pattern(text)),
    }).drop("_text")


def enrich_location(df: DataFrame, word_bounded: bool = False, strict_codes: bool = False) -> DataFrame:
    """Fill city, state and country from the address, or from the text when there is neither address nor city."""
    c = F.col
    no_place = (F.coalesce(c("address"), F.lit("")) == "") & (F.coalesce(c("city"), F.lit("")) == "")
    from_text = places.location_in_text(_text("additional_info", "description"), strict_codes)
    from_address = places.full_address(c("address"), word_bounded=word_bounded, strict_codes=strict_codes)
    from_text = bind(from_text, lambda at: F.struct(at["city"].alias("city"), at["state"].alias("state"),
                                                    at["country"].alias("country"), F.lit("").alias("pincode")))
    found = F.when(no_place, from_text).otherwise(from_address)
    own = df.withColumn("_at", found)
    return _with(own, {
        "city": fill_missing(c("city"), c("_at.city")),
        "state": fill_missing(c("state"), c("_at.state")),
        "country": fill_missing(c("country"), c("_at.country")),
        "pincode": first_filled(c("_at.pincode"), c("pincode")),
    }).drop("_at")


def one_per_key(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``_key`` and one row of ``_x_`` fields per key: the first by ``ord`` where the table has it, then the smallest.

    Written out, so that what joins it joins two plain shuffles, which adaptive
    execution can split where many records ask for one key.
    """
    order = ["ord"] if "ord" in table.columns else []
    first = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.min(F.struct(*order, *fields)).alias("_first"))
    return cut_lineage(first.select("_key", *[F.col(f"_first.{f}").alias(f"_x_{f}") for f in fields]))


def merge_fill(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Fill the empty fields of ``base`` from the ``extra`` row of the same key; of several, from the first (``one_per_key``).

    Info texts of both sides are put side by side when both have one.
    """
    fields = [f for f in RECORD_FIELDS if f in base.columns and f in extra.columns and f != key]
    other = one_per_key(extra, key, fields).withColumnRenamed("_key", key)
    joined = base.join(other, key, "left")
    filled = {f: fill_missing(F.col(f), F.col(f"_x_{f}")) for f in fields}
    if "additional_info" in fields:
        both = (F.col("additional_info") != "") & (F.coalesce(F.col("_x_additional_info"), F.lit("")) != "")
        filled["additional_info"] = F.when(
            both, F.concat_ws(" | ", "additional_info", "_x_additional_info")
        ).otherwise(filled["additional_info"])
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in base.columns])


# --- lookups ---------------------------------------------------------------

class Lookups:
    """Lookup tables for ``enrich_lookup``; of rows with the same key the first is taken (``one_per_key``).

    ``directory1``, ``directory2``, ``panel``, ``encyclopedia`` and ``directors``
    are keyed by ``name_key`` (see ``lookup_key``), ``gst`` by ``gstin``;
    ``erp`` is keyed by ``name_key`` and holds ``erp_software``.
    """

    def __init__(self, **tables: DataFrame) -> None:
        known = {"directory1", "directory2", "gst", "panel", "encyclopedia", "directors", "erp"}
        if set(tables) - known:
            raise ValueError(f"unknown lookup tables: {sorted(set(tables) - known)}")
        self.tables = tables

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def lookup_key(name: Column) -> Column:
    return norm_key(F.trim(name))


def _asked_key(wanted: Column, key: str) -> Column:
    spread = F.pmod(F.xxhash64("ord"), F.lit(9973)).cast("string")
    return F.when(wanted, F.col(key)).otherwise(F.concat(F.lit("\x00"), spread))


def _fill(df: DataFrame, source: str, fields: list[str], key: str, guard: Column, append_info: bool = False) -> DataFrame:
    """Fill what is missing from the fields of the struct ``source`` where ``guard`` holds and the record has a key."""
    use = guard & (F.col(key) != "")
    found = {f: F.when(use, F.col(f"{source}.{f}")) for f in fields if f in df.columns}
    filled = {f: fill_missing(F.col(f), x) for f, x in found.items()}
    if append_info and "additional_info" in found:
        filled["additional_info"] = F.concat_ws(
            " | ", F.nullif(F.col("additional_info"), F.lit("")), F.nullif(found["additional_info"], F.lit(""))
        )
    return df.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def _fields(table: DataFrame) -> list[str]:
    return [f for f in RECORD_FIELDS if f in table.columns]


def _join_lookup(df: DataFrame, rows: DataFrame, key: str, guard: Column) -> DataFrame:
    """Left join with a lookup of one row per ``_key``.

    Rows that do not need the table ask for a key no table holds, one of many,
    so that they spread over the reducers instead of meeting in one.
    """
    asked = df.withColumn("_ask", _asked_key(guard & (F.col(key) != ""), key))
    return asked.join(rows, F.col("_ask") == F.col("_key"), "left").drop("_ask", "_key")


def _fill_from(df: DataFrame, table: DataFrame, key: str, guard: Column, append_info: bool = False) -> DataFrame:
    """Look one table up by ``key`` and fill what is missing where ``guard`` holds."""
    fields = _fields(table)
    rows = first_rows({"_from": table}, key, {"_from": fields})
    return _fill(_join_lookup(df, rows, key, guard), "_from", fields, key, guard, append_info).drop("_from")


def first_rows(tables: dict[str, DataFrame], key: str, fields: dict[str, list[str]]) -> DataFrame:
    """``_key`` and, per table, the struct of its first row with that key (by ``ord`` where it has one, then the smallest).

    All tables are reduced in one aggregation, combined before the shuffle, and
    written out, so that what joins the result joins two plain shuffles.
    """
    def rows(name: str, table: DataFrame) -> DataFrame:
        order = ["ord"] if "ord" in table.columns else []
        own = table.filter((F.col(key).isNotNull()) & (F.col(key) != ""))
        return own.select(F.col(key).alias("_key"), F.struct(*order, F.struct(*fields[name]).alias("_row")).alias(name))

    every = [rows(n, t) for n, t in tables.items() if fields[n]]
    together = every[0]
    for other in every[1:]:
        together = together.unionByName(other, allowMissingColumns=True)
    names = [n for n in tables if fields[n]]
    first = together.groupBy("_key").agg(*[F.min(n).alias(n) for n in names])
    return cut_lineage(first.select("_key", *[F.col(f"{n}._row").alias(n) for n in names]))


def enrich_lookup(df: DataFrame, lookups: Lookups) -> DataFrame:
    """Fill gaps from company tables in priority order; names under three characters are left alone.

    All tables keyed by name are one lookup, so a record is joined twice at
    most: by its name, and by the registration number that its own text or a
    directory's gives.  Which table may fill what is then decided in place.
    """
    c = F.col
    by_name = {n: lookups.get(n) for n in ("directory1", "directory2", "panel", "encyclopedia", "directors", "erp")}
    fields = {n: ["erp_software"] if n == "erp" else _fields(t) for n, t in by_name.items() if t is not None}
    by_name = {f"_{n}": by_name[n] for n, found in fields.items() if found}
    own = df.withColumn("_name_key", lookup_key(c("company_name")))
    named = F.length("company_name") >= 3
    incomplete = named & ((c("contact_name") == "") | (c("turnover") == ""))
    thin = named & (
        (c("contact_name") == "") | (c("turnover") == "") | (c("employee_count") == "") | (c("industry_type") == "")
    )
    if by_name:
        rows = first_rows({n: t.withColumnRenamed("name_key", "_name_key") for n, t in by_name.items()}, "_name_key",
                          {n: fields[n[1:]] for n in by_name})
        own = _join_lookup(own, rows, "_name_key", named)

    def fill(out: DataFrame, table: str, guard: Column, append_info: bool = False) -> DataFrame:
        return _fill(out, f"_{table}", fields[table], "_name_key", guard, append_info) if f"_{table}" in by_name else out

    out = fill(own, "directory1", incomplete, append_info=True)
    out = fill(out, "directory2", incomplete, append_info=True)
    gst = lookups.get("gst")
    if gst is not None:  # directory pages may have added a registration number
        out = out.withColumn("_gstin", facts.gstin(F.coalesce(c("additional_info"), F.lit(""))))
        out = _fill_from(out, gst.withColumnRenamed("gstin", "_gstin"), "_gstin", named, append_info=True).drop("_gstin")
    out = fill(out, "panel", named)
    out = fill(out, "encyclopedia", thin)
    out = fill(out, "directors", named & (c("contact_name") == ""))
    votes = [F.when(c("_name_key") != "", c("_erp.erp_software"))] if "_erp" in by_name else []
    found = first_filled(*votes, facts.erp_by_pattern(_text("description", "additional_info")))
    out = _with(out, {"erp_software": F.when(named & (c("erp_software") == ""), found).otherwise(c("erp_software"))})
    return out.drop("_name_key", *by_name)


def gst_registry(df: DataFrame) -> DataFrame:
    """Registry responses as a fill table.

    Input columns, all text: gstin, legal_name, trade_name, building,
    locality, city, district, state, constitution, business_type.
    """
    c = {f: F.coalesce(F.col(f), F.lit("")) for f in
         ["legal_name", "trade_name", "building", "locality", "city", "district", "state", "business_type"]}

    def some(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    place = F.when((c["locality"] != "") & (c["state"] != ""), F.concat_ws(", ", c["locality"], c["state"]))
    third = F.when(place.isNotNull(), place).otherwise(some(c["state"]))
    address = F.concat_ws(", ", some(c["locality"]), some(c["building"]), third, some(c["city"]),
                          some(c["district"]), some(c["state"]))
    return df.select(
        "gstin",
        first_filled(c["legal_name"], c["trade_name"]).alias("company_name"),
        address.alias("address"),
        first_filled(c["district"], c["city"]).alias("city"),
        c["state"].alias("state"),
        F.when(c["business_type"] != "", F.concat(F.lit("Business Type: "), c["business_type"])).otherwise("").alias(
            "additional_info"),
        F.coalesce(F.col("constitution"), F.lit("")).alias("constitution"),
    )


def gstin_join(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Find a registration number in info, description or address, and fill from the registry."""
    c = F.col
    number = first_filled(*[facts.gstin(F.coalesce(c(f), F.lit(""))) for f in
                            ("additional_info", "description", "address")])
    own = df.withColumn("gstin", number)
    return _fill_from(own, registry, "gstin", F.lit(True), append_info=True)


# --- votes -----------------------------------------------------------------

def erp_vote(titles: DataFrame, company: str, title: str) -> DataFrame:
    """Software named most often in the job titles of a company.

    Each title is reduced to its few hits before anything moves; the shuffle
    carries (company, software, hits) and is combined on the map side.
    """
    upper = F.upper(F.col(title))
    scores = F.array(*[
        F.struct(
            F.lit(rank).alias("rank"), F.lit(name).alias("erp"),
            sum((facts.count_phrase(upper, F.lit(k.upper())) for k in keywords[1:]),
                facts.count_phrase(upper, F.lit(keywords[0].upper()))).alias("hits"),
        )
        for rank, (name, keywords) in enumerate(fixed.ERP_JOB_KEYWORDS)
    ])
    hits = titles.select(F.col(company), F.explode(F.filter(scores, lambda s: s["hits"] > 0)).alias("s"))
    totals = hits.groupBy(company, "s.rank", "s.erp").agg(F.sum("s.hits").alias("score"))
    return totals.groupBy(company).agg(
        F.max_by("erp", F.struct(F.col("score"), -F.col("rank"))).alias("erp_software"),
        F.max("score").alias("score"),
    )


