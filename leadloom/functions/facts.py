"""Company facts found in free text: size, turnover, branches, people, software."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from leadloom.functions import fixed
from leadloom.functions.text import bind, extract, first_filled, holds_any, is_ascii, some, squeeze, unicode, unicode_i


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed dictionary, null when the key is unknown."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>"), c)


def band_of(n: Column) -> Column:
    out = F.lit(None).cast("string")
    ladder = F.when(n.isNull(), out)
    for top, label in fixed.EMPLOYEE_BANDS:
        ladder = ladder.when(n <= top, label)
    return ladder.otherwise(fixed.EMPLOYEE_TOP_BAND)


def as_count(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def believable_band(n: Column) -> Column:
    return F.when(n.between(1, fixed.MAX_EMPLOYEES), band_of(n))


# for each pattern of a list, in order, words of which any match holds one, in lower case: a text without them is not searched
_STAFF_WORDS = [["employees"], ["team"], ["workforce"], ["professionals"], ["people", "staff", "employees"], ["strong"],
                ["employ"], ["member", "associate", "colleague"]]
_TURNOVER_WORDS = [["turnover", "revenue", "sales"], ["rs", "₹"]]
_BRANCH_WORDS = [["branch", "warehouse", "location", "office", "store"], ["cities", "location", "market"]]
_CONTACT_WORDS = [["ceo", "chief executive"], ["director", "md"], ["founder", "proprietor", "owner"]]


def employee_band(text: Column) -> Column:
    """Band of the first pattern that gives a believable number."""
    def found(low: Column) -> Column:
        return F.coalesce(*[
            F.when(holds_any(low, words), bind(as_count(extract(text, unicode_i(p))), believable_band))
            for p, words in zip(fixed.EMPLOYEE_PATTERNS, _STAFF_WORDS, strict=True)], F.lit(""))

    return bind(F.lower(text), found)


def turnover(text: Column) -> Column:
    def amount(p: str) -> Column:
        unit = F.initcap(extract(text, p, 2))
        return F.concat(F.lit("₹"), some(extract(text, p, 1)), F.lit(" "), unit)

    def found(low: Column) -> Column:
        return F.coalesce(*[
            F.when(holds_any(low, words), amount(unicode_i(p)))
            for p, words in zip(fixed.TURNOVER_PATTERNS, _TURNOVER_WORDS, strict=True)], F.lit(""))

    return bind(F.lower(text), found)


def turnover_crore(raw: Column) -> Column:
    """Crore amounts as they are, lakh amounts converted, anything else trimmed."""
    crore = some(extract(raw, unicode_i(r"([\d.]+)\s*(?:Crore|Cr)")))
    lakh = extract(raw, unicode_i(r"([\d.]+)\s*Lakh")).try_cast("double")
    in_crore = bind(lakh, lambda x: F.when(x.isNotNull(), F.format_string("%.2f", F.bround(x / 100, 2))))
    return F.coalesce(F.concat(F.lit("₹"), F.coalesce(crore, in_crore), F.lit(" Cr")), F.trim(raw))


def first_match(text: Column, patterns: list[str], words: list[list[str]]) -> Column:
    """First match that is not empty; a pattern is tried on texts with one of its ``words``."""
    return bind(F.lower(text), lambda low: first_filled(*[
        F.when(holds_any(low, needed), extract(text, unicode_i(p))) for p, needed in zip(patterns, words, strict=True)]))


def branch_count(text: Column) -> Column:
    return squeeze(first_match(text, fixed.BRANCH_PATTERNS, _BRANCH_WORDS))


def contact_name(text: Column) -> Column:
    return F.trim(first_match(text, fixed.CONTACT_PATTERNS, _CONTACT_WORDS))


_ERP_WORDS = ["sap", "oracle", "tally", "zoho", "odoo", "infor", "dynamics", "busy", "marg"]  # one for each pattern


def _first_hit(hits: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, else the empty string."""
    ladder = F.when(hits[0][1], hits[0][0])
    for name, hit in hits[1:]:
        ladder = ladder.when(hit, name)
    return ladder.otherwise("")


def erp_by_pattern(text: Column) -> Column:
    """First software whose pattern is found; a text without any of the words is not searched.

    The patterns take letters of other scripts for their own (a long s for an
    s), so only in plain text does a pattern need its word.
    """
    def found(at: Column) -> Column:
        low, plain = at["low"], at["plain"]
        hits = [(name, (F.contains(low, F.lit(word)) | ~plain) & text.rlike(unicode_i(pattern)))
                for (name, pattern), word in zip(fixed.ERP_PATTERNS, _ERP_WORDS, strict=True)]
        return F.when(plain | text.rlike("(?i)" + "|".join(_ERP_WORDS)), _first_hit(hits)).otherwise("")

    return bind(F.struct(F.lower(text).alias("low"), is_ascii(text).alias("plain")), found)


def erp_by_phrase(text: Column) -> Column:
    def found(padded: Column) -> Column:
        return _first_hit([(name, holds_any(padded, phrases)) for name, phrases in fixed.ERP_PHRASES])

    return bind(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), found)


def detect_erp(text: Column) -> Column:
    return first_filled(erp_by_pattern(text), erp_by_phrase(text))


def industry_of_text(text: Column) -> Column:
    """First keyword group, in priority order, with a hit anywhere in the text."""
    return bind(F.lower(text), lambda low: _first_hit(
        [(name, holds_any(low, keywords)) for name, keywords in fixed.INDUSTRY_KEYWORDS.items()]))


def gstin(text: Column) -> Column:
    return extract(F.upper(text), f"({fixed.GSTIN_PATTERN})")


def owner_in_summary(text: Column) -> Column:
    return first_filled(*[extract(text, unicode(p)) for p in fixed.OWNER_PATTERNS])


def count_phrase(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of ``phrase``."""
    removed = F.replace(text, phrase, F.lit(""))
    return ((F.length(text) - F.length(removed)) / F.length(phrase)).cast("bigint")


