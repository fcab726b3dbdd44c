"""The text rules written for long texts give what the plain patterns give, and no rule runs more often than needed."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from leadloom.functions import contacts, fixed, text as t
from leadloom.operators.enrich import enrich_company, enrich_location
from leadloom.operators.records import rename_long_names
from leadloom.schema import RECORD_SCHEMA, as_records

ODD = [
    None, "", " ", "  ", "a", " a  b ", "a\t b\n", " a b", "a  　 b", "x\x1c\x1dy \x85", "\x00a\x7fb \x0bc", "é  ü",
    "<b>a</b> c", "a &amp;amp; b", "1 < 2 > 0", "a&nbsp;b", "<!-- a --><p>x</p > y", "<script>1</script >z<style>q</style> w ",
    "</p><?x ?> q <!doctype a> r <1>", " \x01 a \x01\x01 b \n", "<template>a</template><SCRIPT x>b</SCRIPT>c", "a<br>\n<br> b",
    "mail a.b@c.co_x@y.com,x@@b@c.com z%q@w.org", "@", "a@b", "A@B.COMx@y.zz", "..a@b.in@c.in", "no mail here " * 40,
    "call +91 98765 43210, 022-27541234x(415) 555-2671.", "-12345678901 0 12345678901", "+44 20 7946 0958+1 212 555 0187",
    "1 2 3 4 5 6 7 8 9 0 1 2", "9876543210123456789098765432101", "( 91-9876501234 )", "......... 98765", "1-800-555-01999\n080 1234 5678",
    "àáâã ÿ", "�", "ж" * 30, "short", "Some words of plain text that go on and on for more than thirty letters",
]


def _old_page_text(html):
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), t.HIDDEN, "\x01")
    marked = t.unescape(F.regexp_replace(shown, t.TAG, "\x01"))
    joined = F.regexp_replace(marked, rf"{t.SPACE}*(?:\x01{t.SPACE}*)+", " ")
    return F.regexp_replace(joined, rf"^{t.SPACE}+|{t.SPACE}+$", "")


def _old_squeeze(c):
    return F.trim(F.regexp_replace(c, t.SPACE + "+", " "))


def _old_clean(c):
    decoded = t.unescape(t.unescape(F.regexp_replace(c, "<[^>]+>", " ")))
    return _old_squeeze(F.regexp_replace(decoded, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def _old_phones(text, limit):
    def matches(rule, pattern):
        return F.transform(t.extract_all(text, pattern), lambda m: F.struct(F.lit(rule).alias("rule"), F.trim(m).alias("raw")))

    found = F.concat(*[matches(n, p) for n, p in enumerate(fixed.PHONE_PATTERNS)])
    valid = F.filter(found, lambda m: contacts.is_valid_phone(m["raw"]))
    placed = F.transform(F.array_distinct(valid), lambda m: F.struct(
        F.instr(text, m["raw"]).alias("at"), m["rule"].alias("rule"), contacts.plus_phone(m["raw"]).alias("number")))
    return F.slice(F.array_distinct(F.transform(F.array_sort(placed), lambda m: m["number"])), 1, limit)


def _old_garbled(c):
    foreign = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return c.rlike(r"[\x00-\x1f\x7f-\x{9f}]|[\x{c0}-\x{ff}]{3,}|[\x{fffc}-\x{ffff}]") | (
        (foreign > F.length(c) * F.lit(0.3)) & (foreign > 10))


def test_rules_equal_plain_patterns(spark):
    texts = ODD + [f"{a or ''}{b or ''}" for a, b in product(ODD, ODD)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").repartition(8)
    x = F.col("x")
    pairs = {
        "squeeze": (t.squeeze(x), _old_squeeze(x)), "clean": (t.clean_text(x), _old_clean(x)),
        "page_text": (t.page_text(x), _old_page_text(x)), "garbled": (t.is_garbled(x), _old_garbled(x)),
        "emails": (contacts.loose_emails(x), t.extract_all(x, fixed.EMAIL_PATTERN)),
        "phones": (contacts.phones(x, 50), _old_phones(x, 50)),
        "any": (t.contains_any(x, fixed.LOREM + ["words", ".."]), x.rlike(t.any_of(fixed.LOREM + ["words", ".."]))),
    }
    for name, (new, old) in pairs.items():
        wrong = df.select("x", new.alias("new"), old.alias("old")).filter(~F.col("new").eqNullSafe(F.col("old"))).collect()
        assert not wrong, (name, wrong[:3])


def test_texts_are_searched_only_for_what_they_can_hold(spark):
    df = spark.createDataFrame([("98765 4321 x " * 3,), ("98765 4321 x",), ("call +91 98765 43210 x",), (None,)], "x string")
    found = df.select(contacts.phones(F.col("x")).alias("p"), t.clean_text(F.col("x")).alias("c"), t.page_text(F.col("x")).alias("t"))
    assert [r["p"] for r in found.collect()] == [[], [], ["+919876543210"], None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "{10}" in plan  # too few digits: no search for runs
    assert plan.count("RLIKE [\\x00-\\x1f") == 1 and "btrim" in plan.lower() or "trim(" in plan
    assert "$)" not in plan  # the ends of a page's text are not looked for at every blank


def test_rules_are_not_repeated(spark):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        raw = as_records(spark.createDataFrame([], RECORD_SCHEMA))

        def times(df, wanted):
            return df._jdf.queryExecution().optimizedPlan().toString().count(wanted)

        assert times(enrich_location(raw), "headquartered in") == 1
        assert times(enrich_company(raw), next(iter(fixed.INDUSTRY_KEYWORDS.values()))[0]) <= 1
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_long_name_is_replaced_and_short_one_kept(spark):
    long = "Words " * 12
    info = "© 2020 Acme Pumps Pvt Ltd"
    rows = as_records(spark.createDataFrame([(1, long, info), (2, "Blue Star", info), (3, long, "")],
                                            "ord long, company_name string, additional_info string"))
    got = {r["ord"]: r["company_name"] for r in rename_long_names(rows).collect()}
    assert got == {1: "Acme Pumps", 2: "Blue Star", 3: long}
