"""Company-name scoring and clean-up as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions import fixed
from leadloom.functions.text import SPACE_CHARS, any_by_letter, any_of, bind, extract, squeeze, unicode, unicode_i

_SUFFIX = rf"(?i)\b(?:{any_by_letter(fixed.LEGAL_SUFFIXES)})\b\.?"


def _any_pattern(patterns: list[str]) -> str:
    """One pattern for all: plain words by their first letter, the others as they are."""
    plain = [p for p in patterns if p.replace("\\.", "").replace(" ", "").isalpha()]
    others = [p for p in dict.fromkeys(patterns) if p not in plain]
    whole = f"^(?:{'|'.join(p[1:] for p in others if p.startswith('^'))})"
    return "(?i)" + "|".join([whole, *[p for p in others if not p.startswith("^")], any_by_letter([p.replace("\\.", ".") for p in plain])])


_INVALID = _any_pattern(fixed.INVALID_NAME_PATTERNS)


def clean_name(c: Column) -> Column:
    """Squeeze, then strip separators from both ends."""
    edges = rf"^[{SPACE_CHARS}\-–—|.:;]+|[{SPACE_CHARS}\-–—|.:;]+$"
    return F.regexp_replace(F.regexp_replace(squeeze(c), edges, ""), r"[\x00-\x1f\x7f-\x{9f}]", "")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def name_score(name: Column, domain: Column | None = None) -> Column:
    """Plausibility points of a company name (squeezed text expected).

    A name that consists of legal suffixes only has no words left; its share
    of capitalised words counts as zero.
    """
    refused = (
        (F.coalesce(name, F.lit("")) == "")
        | name.rlike(r"[<>{}\[\]|\\^`~]")
        | name.rlike(_INVALID)
        | ~name.rlike("(?:[a-zA-Z][^a-zA-Z]*+){3}")
        | (name.rlike("^[0-9]") & (F.length(name) < 10))
        | (F.length(F.replace(name, F.lit("("), F.lit(""))) != F.length(F.replace(name, F.lit(")"), F.lit(""))))
        | ((F.length(name) > 30) & (_count(name, "[^ ]+") > 15))
        | (F.length(name) > 200)
    )
    core = F.trim(F.regexp_replace(name, _SUFFIX, ""))
    counted = bind(core, lambda c: F.struct(
        _count(c, "[^ ]+").alias("words"), _count(F.concat(F.lit(" "), c), r" \p{Lu}").alias("capital"),
        F.length(c).alias("size"), (c != name).alias("legal")))
    score = bind(counted, lambda c: (
        F.lit(1)
        + F.when(c["words"].between(2, 6), 2).when((c["words"] == 1) & (c["size"] >= 4), 1)
        .when(c["words"] > 6, -1).otherwise(0)
        + F.when(c["capital"] * 10 > c["words"] * 7, 1).otherwise(0)
        + F.when(c["legal"], 1).otherwise(0)
    ))
    if domain is not None:
        base = F.substring_index(F.replace(F.lower(domain), F.lit("www."), F.lit("")), ".", 1)
        flat = F.regexp_replace(F.lower(name), "[ _-]", "")
        related = F.contains(flat, base) | F.contains(base, flat)
        score = score + F.when((F.coalesce(domain, F.lit("")) != "") & related, 2).otherwise(0)
    return F.when(refused, F.lit(0)).otherwise(F.greatest(F.lit(0), score))


def is_valid_name_basic(name: Column) -> Column:
    return ~F.lower(name).rlike(any_of(fixed.JUNK_NAMES)) & (F.length(F.trim(name)) >= 2)


def strip_title_noise(title: Column) -> Column:
    out = title
    for pattern in fixed.TITLE_NOISE:
        out = F.trim(F.regexp_replace(out, unicode_i(pattern), ""))
    return out


def copyright_name(text: Column) -> Column:
    return F.trim(extract(text, unicode(fixed.COPYRIGHT_NAME)))


def strip_name_noise(name: Column) -> Column:
    """Drop site words; nothing is left unless two letters stand together."""
    kept = F.regexp_replace(F.regexp_replace(name, unicode_i(fixed.NAME_NOISE), ""), r"^[ \-|:]+|[ \-|:]+$", "")
    return F.coalesce(F.get(F.filter(F.array(kept), lambda k: k.rlike("[A-Za-z]{2,}")), 0), F.lit(""))
