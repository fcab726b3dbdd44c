"""Pages written from customer rows in the markup of each source, with the rows and records they must give.

A page and what is expected of it are templates over the same columns: ``{K}``
the key, ``{NAME}`` the name, ``{SEG}`` the segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.operators import listing, pages as pg
from leadloom.sources import readers
from registry import sqltext as q, views as v
from registry.queries import query

_SITE = "https://c{K}.example.in/"
_RESULTS = (
    '<div class="result__body"><h2 class="result__title"><a class="result__a" href="https://c{K}.example.in/">{NAME} <b>Works</b></a></h2>'
    '<a class="result__snippet">{SEG} goods</a></div><div class="result__body"><p>no title</p></div>'
    '<div class="result__body"><h2 class="result__title"><a class="result__a" href="https://www.tradeindia.com/s{K}">{SEG} {K}</a></h2>'
    '<a class="result__snippet">Second <i>text</i></a></div>')
_RESULT_CARDS = [
    dict(pos=0, name="{NAME} Works", href=_SITE, snippet="{SEG} goods"),
    dict(pos=2, name="{SEG} {K}", href="https://www.tradeindia.com/s{K}", snippet="Second text"),
]
_PROFILES = (
    '<div class="result__body"><h2 class="result__title"><a class="result__a" href="https://www.linkedin.com/company/c-{K}">{NAME} | LinkedIn</a></h2>'
    '<a class="result__snippet">{SEG} goods</a></div><div class="result__body"><h2 class="result__title">'
    '<a class="result__a" href="https://www.linkedin.com/company/c-{K}">again</a></h2></div>')
_BING = (
    '<ol><li class="b_algo"><h2><a href="https://c{K}.example.in/">{NAME}</a></h2><div class="b_caption"><p>{SEG} goods</p></div></li>'
    '<li class="b_algo"><p>none</p></li><li class="b_algo"><h2><a href="https://www.bing.com/x{K}">own</a></h2><p>x</p></li></ol>')
_CARDS = (
    '<ul><li class="cntanr"><span class="jcn"><a href="/d/{K}">{NAME}</a></span><span class="cont_fl_addr">{K} MG Road</span>'
    '<span class="cate">{SEG}</span><a href="https://c{K}.example.in/">site</a></li><li class="cntanr"><p>no name</p></li></ul>')
_SEARX = (
    '<article class="result"><h3><a href="https://c{K}.example.in/">{NAME} <b>Ltd</b></a></h3><p class="content">{SEG} goods</p></article>'
    '<article class="result"><p>x</p></article>')
_CLUTCH = (
    '<ul><li class="provider"><h3 class="company_name"><a href="/profile/{K}">{NAME}</a></h3><a class="website-link__item" href="https://c{K}.example.in/">w</a>'
    '<div class="provider__description">{SEG} makers</div><div class="provider__services">{SEG}</div></li>'
    '<li class="provider"><h3 class="company_name"><a href="/profile/b{K}">B {K}</a></h3></li></ul>')
_GOODFIRMS = (
    '<div class="company-info"><h3><a href="/company/{K}">{NAME}</a></h3><p class="tagline">{SEG} makers</p><div class="service-focus">{SEG}</div></div>'
    '<div class="company-info"><span>x</span><a href="/companies/b{K}">B {K}</a></div>')
_INDIAMART = '<div class="card"><h3><a href="https://www.indiamart.com/shop-{K}/">{NAME}</a></h3></div>' + " " * 500
_PLACES = '{"status":"OK","results":[{"name":"{NAME}","formatted_address":"{K} MG Road","types":["store"],"rating":4}]}'

#: rule: page, its cards
CARDS = {
    "discovery": (_BING, [dict(pos=0, name="{NAME}", href=_SITE, snippet="{SEG} goods"),
                          dict(pos=2, name="own", href="https://www.bing.com/x{K}", snippet="x")]),
    **{rule: (_RESULTS, _RESULT_CARDS) for rule in ("google", "maps", "tradeindia", "justdial", "linkedin")},
    "linkedin_general": (_RESULTS, [c | {"snippet": s} for c, s in zip(_RESULT_CARDS, ("{SEG} goods", "Second text"))]),
    "ddg_seeds": (_RESULTS, [c | {"snippet": ""} for c in _RESULT_CARDS]),
    "justdial_cards": (_CARDS, [dict(pos=0, name="{NAME}", href="/d/{K}", address="{K} MG Road", category="{SEG}")]),
    "searx": (_SEARX, [dict(pos=0, name="{NAME}Ltd", href=_SITE, snippet="{SEG} goods")]),
    "clutch": (_CLUTCH, [dict(pos=0, name="{NAME}", href="/profile/{K}", snippet="{SEG} makers", category="{SEG}", website=_SITE),
                         dict(pos=1, name="B {K}", href="/profile/b{K}")]),
    "goodfirms": (_GOODFIRMS, [dict(pos=0, name="{NAME}", href="/company/{K}", snippet="{SEG} makers", category="{SEG}"),
                               dict(pos=1, name="B {K}", href="/companies/b{K}")]),
}
_CARD_FIELDS = ["name", "href", "snippet", "address", "category", "website"]

_URL = "https://host.example/p?q={K}"
_BOTH = [dict(company_name="{NAME} Works", website=_SITE, description="{SEG} goods"),
         dict(company_name="{SEG} {K}", website="https://www.tradeindia.com/s{K}", description="Second text")]
#: source, page, its records; the query of a page is "query {K}", its url _URL
RECORDS = [
    ("discovery", _BING, [dict(company_name="{NAME}", website=_SITE, description="{SEG} goods", additional_info="Search engine discovery")]),
    ("google", _RESULTS, [r | {"additional_info": "DDG search result for: query {K}"} for r in _BOTH]),
    ("maps", _RESULTS, [r | {"additional_info": "Maps result for: query {K}"} for r in _BOTH]),
    ("tradeindia", _RESULTS, [_BOTH[1] | {"additional_info": "TradeIndia via DDG for: query {K}"}]),
    ("justdial", _CARDS, [dict(company_name="{NAME}", website=_SITE, address="{K} MG Road", industry="{SEG}",
                               additional_info=f"JustDial listing: {_URL} | query: query {{K}}")]),
    ("linkedin", _PROFILES, [dict(company_name="{NAME}", industry="B2B LinkedIn Company", description="{SEG} goods",
                                  additional_info="LinkedIn company profile: https://www.linkedin.com/company/c-{K}")]),
    ("linkedin", _RESULTS, [r | {"source": "linkedin_general_search", "additional_info": "Web search fallback for: query {K}"} for r in _BOTH]),
    ("searx", _SEARX, [dict(company_name="{NAME}Ltd", website=_SITE, description="{SEG} goods", additional_info="Found via searx for: query {K}")]),
    ("clutch", _CLUTCH, [dict(company_name=n, website=w, industry=i, description=d, source_url=f"https://host.example/profile/{u}",
                              additional_info="Clutch search: query {K}")
                         for n, w, i, d, u in (("{NAME}", _SITE, "{SEG}", "{SEG} makers", "{K}"), ("B {K}", "", "", "", "b{K}"))]),
    ("goodfirms", _GOODFIRMS, [dict(company_name=n, industry=i, description=d, source_url=f"https://www.goodfirms.co/{u}",
                                    additional_info="GoodFirms result. Original query: query {K}")
                               for n, i, d, u in (("{NAME}", "{SEG}", "{SEG} makers", "company/{K}"),
                                                  ("B {K}", "Software Development", "", "companies/b{K}"))]),
    ("indiamart", _INDIAMART, [dict(company_name="Shop {K}", website="https://www.indiamart.com/shop-{K}/",
                                    additional_info="IndiaMART | query {K} | confidence=0.85")]),
    ("google_places", _PLACES, [dict(company_name="{NAME}", address="{K} MG Road", industry="Retail",
                                     description="Google Places | Rating: 4", additional_info="Query: query {K}")]),
    ("website", "<p>x{K}</p>", [dict(company_name=_URL, website=_URL, description="x{K}", additional_info=f"Website scrape target: {_URL}")]),
    ("direct_website", "<p>x{K}</p>", [dict(website=_URL, description="x{K}", additional_info="Direct website scrape for: query {K}")]),
]
_RECORD_FIELDS = ["company_name", "website", "address", "industry", "description", "source", "source_url", "additional_info"]


def _filled(template: str) -> Column:
    out = F.lit(template)
    for mark, value in (("{K}", F.col("c_custkey").cast("string")), ("{NAME}", F.col("c_name")), ("{SEG}", F.col("c_mktsegment"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _filled_sql(template: str) -> str:
    out = q.lit(template)
    for mark, value in (("{K}", "c_custkey::VARCHAR"), ("{NAME}", "c_name"), ("{SEG}", "c_mktsegment")):
        out = f"replace({out}, '{mark}', {value})"
    return out


def _expected(fields: list[str], row: dict, first: str) -> str:
    return f"SELECT {first}" + ", ".join(f"{_filled_sql(row.get(f, ''))} AS {f}" for f in fields) + " FROM customer"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return v.spread(v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), rows=True)


def _written(spark: SparkSession, sf: str, template: str) -> DataFrame:
    return _customers(spark, sf).select(F.col("c_custkey").alias("page_id"), _filled(template).alias("html"))


def _register_cards(rule: str) -> None:
    page, cards = CARDS[rule]
    sql = " UNION ALL ".join(_expected(_CARD_FIELDS, c, f"c_custkey AS page_id, {c['pos']} AS pos, ") for c in cards)

    @query(f"listing_rows_{rule}", sql)
    def _(spark, sf):
        return listing.listing_rows(_written(spark, sf, page), listing.RULES[rule]).select("page_id", "pos", *_CARD_FIELDS)


for _rule in CARDS:
    _register_cards(_rule)


@query("source_mappers_written", " UNION ALL ".join(
    _expected(_RECORD_FIELDS, {"source": source} | r, "") for source, _, records in RECORDS for r in records))
def _(spark, sf):
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(source).alias("source"), _filled(page).alias("html"))
                      for i, (source, page, _) in enumerate(RECORDS)])
    fetched = _customers(spark, sf).select(
        "c_custkey", _filled(_URL).alias("url"), _filled("query {K}").alias("query"), F.inline(kinds)).select(
        (F.col("c_custkey") * len(RECORDS) + F.col("i")).alias("page_id"), "query", "source", "url", "html")
    return readers.records_of_all(fetched, list(readers.SOURCES)).select(*_RECORD_FIELDS)


_PLACES_SHOWN = ["{K} Hill Road {SEG}", "Call {K}", "{K} Market Street"]


def _ranked(column: str, values: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey AS page_id, {n} AS rank, {_filled_sql(x)} AS {column} FROM customer" for n, x in enumerate(values, 1))


@query("page_addresses_written", _ranked("address", _PLACES_SHOWN))
def _(spark, sf):
    return pg.page_addresses(_written(spark, sf, (
        '<body><address>{K} Hill Road<br>{SEG}</address><div class="footer-contact">Call {K}</div><p>{K} Market Street</p>'
        "<p>{K} MARKET street</p><p>nothing</p></body>")))


@query("decision_makers_written", _ranked("person", ["Ravi Kumar (CEO Ravi Kumar leads {SEG})", "director {K}"]))
def _(spark, sf):
    return pg.decision_makers(_written(
        spark, sf, "<body><li>CEO Ravi Kumar leads {SEG}</li><p>nothing</p><h3>director {K}</h3><h4>Director {K}</h4></body>"))


def _register_profile(rule: str, role: str, address: str) -> None:
    lakh, staff = "(c_custkey % 900 + 1)", "(c_custkey % 700 + 1)"
    sql = (
        f"SELECT c_custkey AS page_id, 'Ravi Kumar' AS contact_name, '{role}' AS owner_role,"
        f" '₹' || ({lakh} // 100) || '.' || lpad(({lakh} % 100)::VARCHAR, 2, '0') || ' Cr' AS turnover, {q.band(staff)} AS employee_count,"
        f" c_mktsegment AS industry_type, {_filled_sql(address)} AS address, 'GST: 29ABCDE1234F1Z5' AS additional_info FROM customer")

    @query(f"profile_facts_{rule}", sql)
    def _(spark, sf):
        k = F.col("c_custkey")
        page = _filled(
            "<p>Contact Person : Mr. Ravi Kumar, 1 person</p>\n<p>Annual Turnover: Rs. {T} Lakh</p>\n<p>No. of Employees : {E}</p>\n"
            "<p>Nature of Business : {SEG}\n</p><p>Address: {K} Hill Road Pune</p>\n<p>GST No: 29ABCDE1234F1Z5</p>")
        for mark, n in (("{T}", k % 900 + 1), ("{E}", k % 700 + 1)):
            page = F.replace(page, F.lit(mark), n.cast("string"))
        return pg.profile_facts(_customers(spark, sf).select(k.alias("page_id"), page.alias("html")), rule)


_register_profile("directory1", "Proprietor", "")
_register_profile("directory2", "Contact Person", "{K} Hill Road Pune")
