"""Rules that look for a word before they search, and lists read by their first letter, give what the plain patterns give."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from leadloom.functions import facts, fixed, names, places, text as t

PARTS = [
    None, "", " ", "Team of over 1,200", "9 Employees", "workforce of 12 people", "45 + professionals, over 30 staff", "20-strong team", "employ 7",
    "3 members", "0 employees 5 associates", "annual TURNOVER: Rs. 12.5 crore", "₹ 3 cr", "sales 4 Lakh", "rs 5", "8 branches", "operates in 3 Cities",
    "0 stores", "CEO: Ravi Kumar", "md  anita Sharma", "Founder x", "SAP", "ſap tally", "Oracle fusion", "busy", "MARG ERP", "zoho books", "D365", "infor",
    "Plot 7, Andheri East, Mumbai 400069", "york, new york", "navi mumbai, london-leeds", "agrawal", "delhi ncr", "westvirginia virginia", "édelhi bihaŕ",
    "Salt Lake, Kolkata", "Rampur, Shimla | Goa", "Acme Private Limited", "Blue (Star Ltd.", "A1B2c", "12 ab", "Home", "about.com", "www. x", "x" * 31 + " y" * 16,
    "Kochi", "co. corp", "Test", "a　b c", "a\tb", "ab ", "12345 67890", "Acme  Works", "null", "2024 ©",
]


def _token(low, words):
    return t.extract(low, t.unicode(rf"\b({t.any_of(list(words))})\b"))


def _city(low):
    hits = F.filter(F.array(*map(F.lit, places.CITIES)), lambda c: F.contains(low, c))
    return F.coalesce(facts.lookup(F.get(hits, 0), places.CITY_NAMES), F.lit(""))


def _band(text):
    bands = [t.bind(facts.as_count(t.extract(text, t.unicode_i(p))), facts.believable_band) for p in fixed.EMPLOYEE_PATTERNS]
    return F.coalesce(*bands, F.lit(""))


def _turnover(text):
    found = [F.concat(F.lit("₹"), t.some(t.extract(text, t.unicode_i(p), 1)), F.lit(" "), F.initcap(t.extract(text, t.unicode_i(p), 2)))
             for p in fixed.TURNOVER_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def _first(text, patterns):
    return t.first_filled(*[t.extract(text, t.unicode_i(p)) for p in patterns])


def _erp(text):
    found = F.lit("")
    for name, pattern in reversed(fixed.ERP_PATTERNS):
        found = F.when(text.rlike(t.unicode_i(pattern)), name).otherwise(found)
    return F.when(text.rlike("(?i)sap|oracle|tally|zoho|odoo|infor|dynamics|busy|marg"), found).otherwise("")


def _meaningful(c):
    letters = F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    return (F.length(c) >= 5) & c.rlike(rf"[^{t.SPACE_CHARS}]{t.SPACE}+[^{t.SPACE_CHARS}]") & (letters * 2 >= F.length(c))


def _refused(name):
    return name.rlike("(?i)" + "|".join(dict.fromkeys(fixed.INVALID_NAME_PATTERNS)))


def test_rules_equal_the_plain_patterns(spark):
    texts = PARTS + [f"{a or ''} {b or ''}" for a, b in product(PARTS, PARTS)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").repartition(8).withColumn("low", F.lower("x"))
    x, low = F.col("x"), F.col("low")
    suffix = rf"(?i)\b(?:{t.any_of(fixed.LEGAL_SUFFIXES)})\b\.?"
    tokens = [fixed.US_STATES, fixed.UK_COUNTIES, fixed.CANADIAN_PROVINCES, fixed.INDIAN_STATES, fixed.COUNTRY_TOKENS]
    pairs = [
        (facts.employee_band(x), _band(x)), (facts.turnover(x), _turnover(x)), (facts.erp_by_pattern(x), _erp(x)),
        (facts.branch_count(x), t.squeeze(_first(x, fixed.BRANCH_PATTERNS))), (facts.contact_name(x), F.trim(_first(x, fixed.CONTACT_PATTERNS))),
        (places.known_city(low), _city(low)), *[(places._token(low, words), _token(low, words)) for words in tokens],
        (t.is_meaningful(x), _meaningful(x)), (x.rlike(names._INVALID), _refused(x)),
        (F.regexp_replace(x, names._SUFFIX, ""), F.regexp_replace(x, suffix, "")),
        (x.rlike(t.any_by_letter(fixed.CITY_SKIP_WORDS)), x.rlike(t.any_of(fixed.CITY_SKIP_WORDS))),
    ]
    for n, (new, old) in enumerate(pairs):
        wrong = df.filter(~new.eqNullSafe(old)).select("x", new.alias("new"), old.alias("old")).limit(3).collect()
        assert not wrong, (n, wrong)


def test_an_alternation_has_one_branch_for_a_letter():
    found = t.any_by_letter(["new york", "new jersey", "n", "ohio"])
    assert found == "n(?:ew jersey|ew york|)|o(?:hio)"
    assert names._INVALID.count("^") == 1  # the anchored ones are tried in one place
