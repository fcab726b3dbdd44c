"""Cleaning, scoring and normalising records: narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import contacts, fixed, names, text as t
from leadloom.schema import RECORD_FIELDS


def _keep(c: Column, condition: Column, otherwise: str = "") -> Column:
    return F.when(condition, c).otherwise(otherwise)


def _with(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Replace fields in place, keeping the column order."""
    return df.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in df.columns])


def _text_fields(df: DataFrame) -> list[str]:
    return [f for f in RECORD_FIELDS if f in df.columns]


def _clean_each(df: DataFrame, clean) -> DataFrame:
    """Apply one cleaning expression to all text fields at once, which keeps the plan small."""
    fields = _text_fields(df)
    values = F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])
    cleaned = df.withColumn("_clean", F.transform(values, lambda v: F.when(v != "", clean(v)).otherwise(v)))
    return _with(cleaned, {f: F.get("_clean", i) for i, f in enumerate(fields)}).drop("_clean")


def clean_records(df: DataFrame) -> DataFrame:
    """Clean every text field, then blank the fields that do not hold what they should."""
    cleaned = _clean_each(df, t.clean_text)
    c = {f: F.col(f) for f in _text_fields(df)}
    good_url = t.is_valid_url(c["website"])
    host = F.when(good_url, t.url_host(c["website"])).otherwise("")
    return _with(cleaned, {
        "company_name": _keep(c["company_name"], names.name_score(c["company_name"], host) >= 3),
        "website": _keep(F.lower(c["website"]), good_url),
        "email": _keep(F.lower(c["email"]), contacts.is_valid_email(c["email"])),
        "phone": contacts.plus_phone(c["phone"]),
        "description": _keep(F.substring(c["description"], 1, 1000), t.is_valid_description(c["description"])),
        "address": _keep(F.substring(c["address"], 1, 500), t.is_meaningful(c["address"])),
    })


def clean_records_basic(df: DataFrame) -> DataFrame:
    """The lighter rules: squeeze text, keep only plausible contacts, address and name."""
    cleaned = _clean_each(df, t.clean_text_basic)
    website, name = F.col("website"), F.col("company_name")
    return _with(cleaned, {
        "email": _keep(F.col("email"), contacts.is_valid_email(F.col("email"))),
        "phone": _keep(F.col("phone"), contacts.is_valid_phone(F.col("phone"))),
        "website": _keep(website, F.contains(t.url_host(website), F.lit("."))),
        "company_name": _keep(name, names.is_valid_name_basic(name)),
    })


def quality_points() -> Column:
    """Quality score of a cleaned record, exact to one tenth."""
    c = F.col

    def has(*fields: str) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | (F.coalesce(c(f), F.lit("")) != "")
        return out

    def points(condition: Column, tenths: int) -> Column:
        return F.when(condition, tenths).otherwise(0)

    # the whole website is handed over where a host is expected; it only relates to names inside "https://x"
    name = names.name_score(c("company_name"), c("website"))
    name_tenths = t.bind(name, lambda n: F.when(n >= 4, 32).when(n >= 3, 22).otherwise(0))
    industry = t.first_filled(c("industry"), c("industry_type"))
    good_industry = has("industry", "industry_type") & t.is_meaningful(industry)
    long_text = (F.length("description") > 50) & t.is_meaningful(c("description"))
    # a field with data earns its points plus two tenths for completeness
    tenths = (
        name_tenths
        + points(has("website"), 17)
        + F.when(~has("email"), 0).when(contacts.is_business_email(c("email")), 22).otherwise(17)
        + points(has("phone"), 17)
        + points(has("address", "city", "state"), 12)
        + points(has("city"), 5)
        + points(has("state"), 3)
        + points(good_industry, 7)
        + F.when(long_text, 12).when(F.length("description") > 20, 3).otherwise(0)
    )
    return (tenths.cast("decimal(5,1)") / 10).cast("decimal(4,2)")


def quality_score(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", quality_points())


def quality_filter(df: DataFrame, threshold: str = fixed.MIN_QUALITY) -> DataFrame:
    scored = df.withColumn("_quality", t.pinned(quality_points()))
    return scored.filter(F.col("_quality") >= F.lit(threshold).cast("decimal(4,2)")).drop("_quality")


def rejected_records(raw: DataFrame, threshold: str = fixed.MIN_QUALITY) -> DataFrame:
    """Records the cleaner and the quality filter remove, with the reasons.

    One pass: the raw fields travel next to the cleaned ones, no join.
    """
    watched = ["company_name", "website", "email", "phone", "description", "address"]
    carried = raw.withColumns({f"_raw_{f}": F.trim(F.coalesce(F.col(f), F.lit(""))) for f in watched})
    scored = quality_score(clean_records(carried))
    reasons = [F.when((F.col(f"_raw_{f}") != "") & (F.col(f) == ""), f"invalid {f}") for f in watched]
    below = F.when(F.col("quality") < F.lit(threshold).cast("decimal(4,2)"), "below threshold")
    return (
        scored.withColumn("reasons", t.pinned(F.array_compact(F.array(*reasons, below))))
        .filter(F.size("reasons") > 0)
        .drop(*[f"_raw_{f}" for f in watched])
    )


def rejection_counts(raw: DataFrame, threshold: str = fixed.MIN_QUALITY) -> DataFrame:
    found = rejected_records(raw, threshold).select(F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count("*").alias("n_records"))


def normalize_industry_name(c: Column) -> Column:
    from leadloom.functions.facts import lookup

    trimmed = F.trim(c)
    known = lookup(F.lower(trimmed), fixed.INDUSTRY_NAMES)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(known, t.py_title(trimmed)))


def normalize_records(df: DataFrame) -> DataFrame:
    c = F.col
    squeezed = ["company_name", "address", "description", "additional_info", "source", "employee_count",
                "branch_count", "turnover", "contact_name", "erp_software"]
    fields = {f: t.squeeze(F.coalesce(c(f), F.lit(""))) for f in squeezed}
    fields |= {f: t.py_title(t.squeeze(F.coalesce(c(f), F.lit("")))) for f in ("city", "state", "country")}
    fields |= {f: normalize_industry_name(c(f)) for f in ("industry", "industry_type")}
    fields["website"] = t.normalize_url(c("website"))
    fields["phone"] = contacts.normalize_phone(F.coalesce(c("phone"), F.lit("")))
    fields["email"] = F.lower(F.trim(F.coalesce(c("email"), F.lit(""))))
    return _with(df, fields)


def rename_long_names(df: DataFrame, longest: int = 60) -> DataFrame:
    """Replace over-long names by a better candidate from the text, if there is a shorter one.

    The text is handled as markup, like a page; after cleaning only the
    copyright line can give a name.
    """
    from leadloom.operators.pages import best_name_of_page

    c = F.col
    markup = F.concat(F.coalesce(c("description"), F.lit("")), F.coalesce(c("additional_info"), F.lit("")))
    # within the branch, not in its condition: the text of a record with a usual name is not read at all
    better = t.bind(best_name_of_page(markup), lambda b: F.when(
        (b != "") & (F.length(b) < longest), b).otherwise(c("company_name")))
    return _with(df, {"company_name": F.when(F.length("company_name") > longest, better).otherwise(c("company_name"))})
