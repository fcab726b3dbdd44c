"""E-mail and phone validation and extraction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions import fixed
from leadloom.functions.text import any_of, bind, contains_any, extract_all

# as the pattern, begun only where a word begins or the match before it ended, and never given back letter by letter
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + fixed.EMAIL_PATTERN.replace("+@", "++@", 1)
_PHONE_RUN = r"[0-9\s\-.()+]{10,}"  # all that the phone patterns can read; a valid number has ten digits
_TEN_DIGITS = "(?:[0-9][^0-9]*+){10}"
_FULL_EMAIL = "^" + fixed.EMAIL_PATTERN.replace("A-Z", "") + "$"


def is_valid_email(c: Column) -> Column:
    mail = F.lower(F.trim(c))
    local = F.substring_index(mail, "@", 1)
    domain = F.substring_index(mail, "@", -1)
    return (
        mail.rlike(_FULL_EMAIL)
        & (F.length(local) <= 64)
        & (F.length(domain) <= 255)
        & ~local.rlike(r"\.\.|^\.|\.$")
        & ~domain.isin(fixed.DISPOSABLE_DOMAINS)
        & ~mail.rlike(f"^(?:{any_of(fixed.NO_REPLY_PREFIXES)})")
        & F.substring_index(domain, ".", -1).isin(fixed.EMAIL_TLDS)
        & ~contains_any(mail, fixed.SUSPICIOUS_EMAIL_PARTS)
    )


def is_free_mail(c: Column) -> Column:
    domain = F.substring_index(F.lower(F.trim(c)), "@", -1)
    return F.substring_index(F.replace(domain, F.lit("www."), F.lit("")), ".", 1).isin(fixed.FREE_MAIL_NAMES)


def is_business_email(c: Column) -> Column:
    return is_valid_email(c) & ~is_free_mail(c)


def emails(text: Column, limit: int = 5) -> Column:
    """Valid addresses in text order; free-mail addresses only when there is no business one."""
    found = F.array_distinct(F.transform(loose_emails(text), lambda m: F.lower(m)))
    valid = F.filter(found, lambda m: is_valid_email(m))

    def preferred(all_valid: Column) -> Column:
        return bind(F.filter(all_valid, lambda m: ~is_free_mail(m)),
                    lambda business: F.when(F.size(business) > 0, business).otherwise(all_valid))

    return F.slice(bind(valid, preferred), 1, limit)


def best_email(text: Column) -> Column:
    return F.coalesce(F.get(emails(text, 1), 0), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]++", "")


def is_valid_phone(c: Column, region: str = "") -> Column:
    d = digits(c)
    ok = (
        F.length(d).between(10, 15)
        & ~d.isin(fixed.FAKE_PHONES)
        & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")
        # ten digits with a leading zero are refused
        & ~((F.length(d) == 10) & d.startswith("0"))
    )
    if region in ("in", "india"):
        ok = ok & d.rlike("^(?:[6-9][0-9]{9}|0[6-9][0-9]{9}|91[6-9][0-9]{9})$")
    elif region in ("us", "usa", "ca", "canada"):
        ok = ok & d.rlike("^1?[3-9][0-9]{9}$")
    elif region in ("uk", "gb"):
        ok = ok & d.rlike("^(?:[0-9]{10}|0[0-9]{10}|44[0-9]{10})$")
    return ok


def plus_phone(c: Column, region: str = "") -> Column:
    """Valid numbers as +digits, others as the empty string."""
    d = digits(c)
    out = F.concat(F.lit("+"), d)
    if region in ("in", "india"):
        out = (
            F.when(F.length(d) == 10, F.concat(F.lit("+91"), d))
            .when((F.length(d) == 11) & d.startswith("0"), F.concat(F.lit("+91"), F.substring(d, 2, 10)))
            .otherwise(out)
        )
    return F.when(is_valid_phone(c, region), out).otherwise("")


def phones(text: Column, limit: int = 5, region: str = "") -> Column:
    """Valid numbers found by any of the patterns, in order of their place in the text.

    The patterns read digits and a few marks only, so they are tried on the
    runs of these that are long enough for a number, put side by side with a
    letter between them that no pattern reads.  A text with fewer than ten
    digits in all has no valid number and is not read again.
    """
    def matches(runs: Column, rule: int, pattern: str) -> Column:
        return F.transform(extract_all(runs, pattern), lambda m: F.struct(
            F.lit(rule).alias("rule"), F.trim(m).alias("raw")))

    runs = bind(text, lambda x: F.when(~x.rlike(_TEN_DIGITS), F.array().cast("array<string>")).otherwise(extract_all(x, _PHONE_RUN)))
    found = bind(F.array_join(runs, "x"),
                 lambda runs: F.concat(*[matches(runs, n, p) for n, p in enumerate(fixed.PHONE_PATTERNS)]))
    valid = F.filter(found, lambda m: is_valid_phone(m["raw"], region))
    placed = F.transform(
        F.array_distinct(valid),
        lambda m: F.struct(F.instr(text, m["raw"]).alias("at"), m["rule"].alias("rule"),
                           plus_phone(m["raw"], region).alias("number")),
    )
    return F.slice(F.array_distinct(F.transform(F.array_sort(placed), lambda m: m["number"])), 1, limit)


def best_phone(text: Column, region: str = "") -> Column:
    return F.coalesce(F.get(phones(text, 1, region), 0), F.lit(""))


def normalize_phone(c: Column) -> Column:
    """Keep digits and plus; Indian numbers get their country code."""
    kept = F.regexp_replace(c, "[^0-9+]", "")
    return (
        F.when(kept.startswith("91") & (F.length(kept) > 10), F.concat(F.lit("+"), kept))
        .when(kept.startswith("0") & (F.length(kept) == 11), F.concat(F.lit("+91"), F.substring(kept, 2, 20)))
        .otherwise(kept)
    )


def loose_emails(text: Column) -> Column:
    """All matches of the pattern; a text without an @ is not read again."""
    return bind(text, lambda x: F.when(F.instr(x, "@") > 0, extract_all(x, _EMAIL)).otherwise(
        F.when(x.isNotNull(), F.array().cast("array<string>"))))


def loose_phones(text: Column) -> Column:
    """The looser pattern set of the seed pages: raw matches with at least ten digits."""
    found = F.concat(*[extract_all(text, "(?U)" + p) for p in fixed.LOOSE_PHONE_PATTERNS])
    long_enough = F.filter(found, lambda m: F.length(F.regexp_replace(m, r"[^0-9+]", "")) >= 10)
    return F.array_distinct(F.transform(long_enough, lambda m: F.trim(m)))
