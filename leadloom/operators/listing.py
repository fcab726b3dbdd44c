"""Search-result and directory pages: one row per card, by a table of rules.

The page is parsed once (``markup.with_elements``); cards, titles, links and
the other fields are column expressions over its elements, so a new rule is a
new row of selectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.functions import contacts, fixed, markup, text as t
from leadloom.operators import pages as pg
from leadloom.operators.enrich import one_per_key
from leadloom.operators.resolve import dedupe_listing, keep_first
from leadloom.schema import RECORD_FIELDS, as_records, record


@dataclass(frozen=True)
class Rule:
    """Selectors are tried left to right; the first that finds anything wins."""

    cards: list[str]
    title: list[str]
    cap: int | None
    snippet: list[str] = field(default_factory=list)
    address: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    website: list[str] = field(default_factory=list)
    glue: str = " "
    whole: bool = False  # read the card's whole text and its first link elsewhere, too


_RESULT = ["div.result__body", "div.results_links_deep", "div.result"]
_RESULT_TITLE = ["h2.result__title a.result__a", "a.result__a", "h2 a"]
_SITE_TITLE = ["a.result__a", "h2.result__title a", "h2 a"]
_RESULT_SNIPPET = ["a.result__snippet", ".result__snippet", "p"]

# fixed values: selectors and caps of the sources
RULES = {
    "discovery": Rule(["li.b_algo"], ["h2 a"], 15, ["p, .b_caption p"]),
    "google": Rule(_RESULT, _RESULT_TITLE, 10, _RESULT_SNIPPET),
    "maps": Rule(_RESULT, _RESULT_TITLE, 8, _RESULT_SNIPPET),
    "tradeindia": Rule(_RESULT, _SITE_TITLE, 12, _RESULT_SNIPPET),
    "justdial": Rule(_RESULT, _SITE_TITLE, 12, _RESULT_SNIPPET),
    "justdial_cards": Rule(
        ["li.cntanr", ".jdCard", ".resultbox_info", "[class*='store-details']", "div.jresult"],
        ["span.jcn a, .resultbox_title_anchor, .jdTitle a, .title a, h2.title, .fn.org, .store-name"], 15,
        address=["span.cont_fl_addr, .resultbox_address, .address, .adr"],
        category=["span.cate, .resultbox_category, .cat_name"], whole=True,
    ),
    "linkedin": Rule(["div.result__body"], ["a.result__url, a.result__a, h2.result__title a"], 5, ["a.result__snippet"]),
    "linkedin_general": Rule(["div.result__body"], ["h2.result__title a"], 5, ["a.result__snippet"]),
    "searx": Rule(
        ["article.result", "div.result", ".item", "li.result"],
        ["h3 a, .result_title a, .title a, h2 a, a.result__a"], 15,
        ["p, .content, .snippet, .result_content, .result__snippet"], glue="",
    ),
    "clutch": Rule(
        ["li.provider, div.provider-row"], ["h3.company_name a, .provider__title a"], 25,
        [".company_info .field-content, .provider__description"],
        category=[".list-item.block-tagline, .provider__services"],
        website=["a.website-link__item, a[href*='visit-website']"],
    ),
    "goodfirms": Rule(
        ["div.company-info, div.cl-detail-tile, li.company-list-item", "div.company", "article"],
        ["h3 a, h2 a, .company-name a", "a[href*='/companies/']"], 20,
        ["p, .tagline, .company-desc"], category=[".service-focus, .focus-areas, .categories"],
    ),
    "ddg_seeds": Rule(["div.result__body"], ["a.result__a, a.result__url"], 20),
}
LISTING_LINKS = [
    ".company-details h3 a", ".company-name-title a", ".prod-title a", "div.companyname a", "h2.companyname a",
    "p.companyname a", ".producttitle a", ".compny-name a", ".lcname a", "h3 a[href*='indiamart.com']",
    "h2 a[href*='indiamart.com']", ".company-card a", ".product-card a", "[class*='company-name'] a",
    "[class*='product-title'] a",
]
LISTING_CARD_CLASS = "list|card|company|item|m-cl|r-stpd|product"
LISTING_PHONE = ".phone, .tel, [class*='phone'], [class*='mobile']"
LISTING_ADDRESS = ".address, [class*='addr'], .loc"
SEED_CARDS = [".jdCard", ".resultbox", "[class*='resultcard']", ".store-details", "li.cntanr", ".restrocard",
              "[class*='tabcontent'] li", ".mr2 .store-details"]
SEED_NAME = ".jdTitle, .title, h2.title, .store-name, .fn.org, span.jcn a, .resultbox_title_anchor, .store-name a"
JUSTDIAL_LISTING = (
    r"(?i)justdial\.com/[^/]+/[^/]+-(?:in|near|at|around)-[^/]+|justdial\.com/[A-Za-z]+/[A-Za-z][^?#]{5,}/nct-"
)
GOODFIRMS_BASE = "https://www.goodfirms.co/companies"
SITE_ADDRESS = {
    "justdial": ".address, [itemprop='address'], .cont_fl_addr, .jdl_addr",
    "tradeindia": ".company-address, .address, [itemprop='address'], .seller-address",
}
SITE_CATEGORY = ".cat_name, .cate, [itemprop='description']"


def card_rows(rule: Rule) -> Column:
    """Array of the cards of a page whose elements are in ``nodes`` and ``texts``.

    Made within the page row, so that no card carries the page's elements.
    Cards without a title element give no row but use up their place.
    """
    nodes, texts = F.col("nodes"), F.col("texts")
    cards = markup.first_selection(nodes, rule.cards)
    if rule.cap is not None:
        cards = F.slice(cards, 1, rule.cap)

    def fields(card: Column, pos: Column, near: Column, own: Column, title: Column) -> Column:
        def one(selectors: list[str], glue: str = " ") -> Column:
            if not selectors:
                return F.lit("")
            return t.bind(markup.select_one(own, selectors, near), lambda n: markup.text_of(texts, n, glue))

        def outside() -> Column:
            hrefs = F.transform(markup.select(own, "a[href]"), lambda a: a["href"])
            return F.get(F.filter(hrefs, lambda h: h.startswith("http") & ~F.contains(h, F.lit("justdial.com"))), 0)

        website = F.coalesce(markup.select_one(own, rule.website, near)["href"], F.lit("")) if rule.website else F.lit("")
        return F.struct(
            pos.alias("pos"), markup.text_of(texts, title, rule.glue).alias("name"),
            F.coalesce(title["href"], F.lit("")).alias("href"), one(rule.snippet, rule.glue).alias("snippet"),
            one(rule.address).alias("address"), one(rule.category).alias("category"), website.alias("website"),
            (outside() if rule.whole else F.lit(None).cast("string")).alias("outside"),
            (markup.text_of(texts, card) if rule.whole else F.lit("")).alias("card_text"))

    def row(card: Column, pos: Column) -> Column:
        return t.bind(markup.around_and_inside(nodes, card), lambda near: t.bind(markup.inside(near, card), lambda own: t.bind(
            markup.select_one(own, rule.title, near), lambda title: F.when(title.isNotNull(), fields(card, pos, near, own, title)))))

    return F.filter(F.transform(cards, row), lambda r: r.isNotNull())


def listing_rows(pages: DataFrame, rule: Rule) -> DataFrame:
    """One row per card: pos, name, href, snippet, address, category, website, outside, card_text."""
    keep = [c for c in pages.columns if c != "html"]
    found = markup.with_elements(pages).select(*keep, t.pinned(card_rows(rule)).alias("cards"))
    return found.select(*keep, F.inline("cards"))


def _place(page: str = "page_id") -> Column:
    """Order of a card: by page, then by place in it.  An order only: records are never told apart by it."""
    return F.col(page).cast("long") * (1 << 20) + F.col("pos")


def _best_mail(text: Column) -> Column:
    return contacts.best_email(text)


def result_rows(pages: DataFrame, source: str, page_filter: Column | None = None) -> DataFrame:
    """Cards of a search-result page with decoded links; challenge pages give nothing."""
    html = F.col("html")
    challenge = F.contains(html, F.lit(fixed.CAPTCHA_MARKERS[0])) | F.contains(html, F.lit(fixed.CAPTCHA_MARKERS[1]))
    rows = listing_rows(pages.filter(~challenge), RULES[source]).withColumn("href", t.unwrap_redirect(F.col("href")))
    rows = rows.filter(F.col("href").startswith("http") & ~F.contains("href", F.lit("duckduckgo.com")))
    return rows if page_filter is None else rows.filter(page_filter)


# --- records per source ----------------------------------------------------

def bing_records(pages: DataFrame) -> DataFrame:
    rows = listing_rows(pages, RULES["discovery"]).filter((F.col("href") != "") & ~F.contains("href", F.lit("bing.com")))
    host = F.replace(t.url_host(F.col("href")), F.lit("www."), F.lit(""))
    return rows.select(*record(
        ord=_place(), company_name=F.when(F.length("name") < 2, host).otherwise(F.col("name")), website=F.col("href"),
        description=t.first_filled(F.col("snippet"), F.concat(F.lit("Discovered via search query: "), F.col("query"))),
        source=F.lit("discovery"), additional_info=F.lit("Search engine discovery"),
    ))


def web_records(pages: DataFrame) -> DataFrame:
    return result_rows(pages, "google").select(*record(
        ord=_place(), company_name=F.col("name"), website=F.col("href"), description=F.col("snippet"),
        email=_best_mail(F.col("snippet")), phone=contacts.best_phone(F.col("snippet")), source=F.lit("google"),
        additional_info=F.concat(F.lit("DDG search result for: "), F.col("query")),
    ))


def maps_records(pages: DataFrame) -> DataFrame:
    """Map-style results; the address is cut from the snippet when its wording has one."""
    in_snippet = F.when(F.col("snippet").rlike(t.unicode_i(fixed.ADDRESS_PATTERN)), t.squeeze(F.col("snippet"))).otherwise("")
    return result_rows(pages, "maps").select(*record(
        ord=_place(), company_name=F.col("name"), website=F.col("href"), description=F.col("snippet"),
        phone=contacts.best_phone(F.col("snippet")), address=in_snippet, source=F.lit("maps"),
        additional_info=F.concat(F.lit("Maps result for: "), F.col("query")),
    ))


def site_records(pages: DataFrame, source: str, visited: DataFrame | None = None) -> DataFrame:
    """Results of a directory found over a search engine, completed from the visited page where there is one.

    ``visited`` has url and html.  Directory listing pages among the results
    are left to ``card_records``.
    """
    label = {"tradeindia": "TradeIndia via DDG for: ", "justdial": "JustDial via DDG for: "}[source]
    rows = result_rows(pages, source, F.contains("href", F.lit(f"{source}.com")))
    if source == "justdial":
        rows = keep_first(rows.withColumn("ord", _place()), [F.col("page_id"), F.col("href")])
        rows = rows.filter(~F.col("href").rlike(JUSTDIAL_LISTING))
    facts_of = None
    if visited is not None:
        facts_of = _visited_facts(visited, source)
        rows = rows.join(facts_of, F.col("href") == F.col("v_url"), "left")
    else:
        for c in ("v_name", "v_text", "v_address", "v_category"):
            rows = rows.withColumn(c, F.lit(""))
    snippet, page = F.col("snippet"), F.coalesce("v_text", F.lit(""))
    return rows.select(*record(
        ord=_place(), company_name=t.first_filled(F.col("v_name"), F.col("name")), website=F.col("href"),
        description=F.substring(snippet, 1, 400),
        email=t.first_filled(_best_mail(snippet), _best_mail(page)),
        phone=t.first_filled(contacts.best_phone(snippet), contacts.best_phone(page)),
        address=F.coalesce("v_address", F.lit("")), industry=F.coalesce("v_category", F.lit("")),
        industry_type=F.coalesce("v_category", F.lit("")), source=F.lit(source),
        additional_info=F.concat(F.lit(label), F.col("query")),
    ))


def _visited_facts(visited: DataFrame, source: str) -> DataFrame:
    """Name, text, address and category of visited directory pages, one row per url."""
    nodes, texts = F.col("nodes"), F.col("texts")
    title = F.trim(F.substring_index(t.fragment_text(
        t.extract(F.col("html"), r"(?is)<title\b[^>]*>(.*?)</title\s*>"), ""), "-", 1))
    own = visited.select("url", "html", title.alias("_t"), t.page_text(F.col("html")).alias("v_text"))
    parsed = markup.with_elements(own)

    def text_at(selector: str) -> Column:
        return t.bind(F.get(markup.select(nodes, selector), 0), lambda n: markup.text_of(texts, n))

    address, category = text_at(SITE_ADDRESS[source]), text_at(SITE_CATEGORY)
    if source == "tradeindia":
        def last_cell(*words: str) -> Column:
            rows = F.transform(
                markup.select(nodes, "tr, li.detail-item, div.company-details div"),
                lambda r: F.struct(F.lower(markup.text_of(texts, r)).alias("text"),
                                   markup.select(markup.inside(nodes, r), "td, span, div").alias("cells")))
            hits = F.filter(rows, lambda r: t.contains_any(r["text"], list(words)) & (F.size(r["cells"]) > 1))
            return F.transform(hits, lambda r: markup.text_of(texts, F.try_element_at(r["cells"], F.lit(-1)), ""))

        category = F.coalesce(F.try_element_at(last_cell("nature of business", "company type"), F.lit(-1)), F.lit(""))
        address = t.first_filled(F.coalesce(F.get(F.filter(last_cell("address"), lambda a: a != ""), 0), F.lit("")), address)
    found = parsed.select(
        F.col("url").alias("v_url"), F.when(F.length("_t") > 3, F.col("_t")).otherwise("").alias("v_name"), "v_text",
        address.alias("v_address"), category.alias("v_category"),
    )
    return found.dropDuplicates(["v_url"])


def card_records(pages: DataFrame) -> DataFrame:
    """Companies of a directory listing page."""
    rows = listing_rows(pages, RULES["justdial_cards"]).filter(F.length("name") >= 3)
    return rows.select(*record(
        ord=_place(), company_name=F.col("name"), website=F.coalesce("outside", "url"),
        phone=contacts.best_phone(F.col("card_text")), email=_best_mail(F.col("card_text")), address=F.col("address"),
        industry=F.col("category"), industry_type=F.col("category"), source=F.lit("justdial"),
        additional_info=F.concat(F.lit("JustDial listing: "), F.col("url"), F.lit(" | query: "), F.col("query")),
    ))


def linkedin_records(pages: DataFrame) -> DataFrame:
    """Company profiles found over a search engine; pages without any give plain web results."""
    def shown(rule: str) -> Column:
        return F.transform(card_rows(RULES[rule]), lambda r: r.withField("href", t.unwrap_redirect(r["href"])))

    def firsts(rows: Column) -> Column:
        """One row of each link, the first."""
        hrefs = F.transform(rows, lambda r: r["href"])
        return t.bind(hrefs, lambda known: F.filter(rows, lambda r, i: F.array_position(known, r["href"]) == i + 1))

    keep = [c for c in pages.columns if c != "html"]
    staged = markup.with_elements(pages).select(*keep, "nodes", "texts", t.pinned(
        F.filter(shown("linkedin"), lambda r: F.contains(r["href"], F.lit("linkedin.com/company")))).alias("hits"))
    is_profile = F.size("hits") > 0
    chosen = staged.select(*keep, is_profile.alias("is_profile"), t.pinned(
        F.when(is_profile, firsts(F.col("hits"))).otherwise(shown("linkedin_general"))).alias("cards"))
    rows = chosen.select(*keep, "is_profile", F.inline("cards"))
    name = F.regexp_replace(F.col("name"), r"(?s) [|] LinkedIn.*$| - LinkedIn.*$", "")
    slug = t.py_title(F.replace(F.regexp_extract(t.url_path(F.col("href")), "([^/]*)$", 1), F.lit("-"), F.lit(" ")))

    def either(profile: Column, general: Column) -> Column:
        return F.when(F.col("is_profile"), profile).otherwise(general)

    link = F.when(F.col("href").startswith("http"), F.col("href")).otherwise("")
    return rows.select(*record(
        ord=_place(), company_name=either(t.first_filled(F.trim(name), slug), F.col("name")),
        industry=either(F.lit("B2B LinkedIn Company"), F.lit("")), website=either(F.lit(""), link), description=F.col("snippet"),
        source=either(F.lit("linkedin"), F.lit("linkedin_general_search")),
        additional_info=either(F.concat(F.lit("LinkedIn company profile: "), F.col("href")),
                               F.concat(F.lit("Web search fallback for: "), F.col("query"))),
    ))


def searx_records(pages: DataFrame) -> DataFrame:
    """Meta-search results; of several instances asked for a query (``instance_pos``), the first that gave rows counts."""
    rows = listing_rows(pages, RULES["searx"])
    good = rows.filter((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.contains(F.lower("href"), F.lit("javascript")))
    if "instance_pos" in pages.columns:
        first = good.groupBy("query").agg(F.min("instance_pos").alias("instance_pos"))
        good = good.join(first, ["query", "instance_pos"], "left_semi")
    instance = F.col("instance") if "instance" in pages.columns else F.lit("searx")
    return good.select(*record(
        ord=_place(), company_name=F.col("name"), website=F.col("href"), description=F.substring("snippet", 1, 500),
        email=_best_mail(F.col("snippet")), phone=contacts.best_phone(F.col("snippet")), source=F.lit("searx"),
        additional_info=F.concat(F.lit("Found via "), instance, F.lit(" for: "), F.col("query")),
    ))


def clutch_records(pages: DataFrame) -> DataFrame:
    return listing_rows(pages, RULES["clutch"]).select(*record(
        ord=_place(), company_name=F.col("name"), website=F.col("website"), industry=F.col("category"),
        industry_type=F.col("category"), description=F.col("snippet"), source=F.lit("clutch"),
        source_url=t.resolve_url(F.col("url"), F.col("href")),
        additional_info=F.concat(F.lit("Clutch search: "), F.col("query")),
    ))


def goodfirms_records(pages: DataFrame) -> DataFrame:
    trade = t.first_filled(F.col("category"), F.lit("Software Development"))
    return listing_rows(pages, RULES["goodfirms"]).filter(F.col("name") != "").select(*record(
        ord=_place(), company_name=F.col("name"), industry=trade, industry_type=trade, description=F.col("snippet"),
        source=F.lit("goodfirms"), source_url=t.resolve_url(F.lit(GOODFIRMS_BASE), F.col("href")),
        additional_info=F.concat(F.lit("GoodFirms result. Original query: "), F.col("query")),
    ))


def website_records(pages: DataFrame, source: str = "website") -> DataFrame:
    """One record per visited website."""
    text, url, html = F.col("_text"), F.col("url"), F.col("html")
    own = pages.select("page_id", "url", "query", "html", t.page_text(html).alias("_text"))
    name = pg.best_name_of_candidates(pg.name_candidates_of_text(text, t.domain_of(url)))
    start = F.substring(text, 1, 500)
    common = dict(ord=F.col("page_id").cast("long") * (1 << 20), website=url, email=_best_mail(text), phone=contacts.best_phone(text),
                  source=F.lit(source))
    if source == "direct_website":
        return own.select(*record(**common, company_name=name, description=start, additional_info=F.concat(
            F.lit("Direct website scrape for: "), F.col("query"))))
    parsed = markup.with_elements(own.withColumn("_meta", t.meta_content(html, "name", "description")))
    return parsed.select(*record(
        **common, company_name=t.first_filled(name, url), description=t.first_filled(F.col("_meta"), start),
        address=F.coalesce(F.get(pg.address_blocks(), 0), F.lit("")),
        additional_info=F.concat(F.lit("Website scrape target: "), url),
    ))


# fixed values: the sources that visit the page of a result, and how they name it
PROFILE_LABELS = {"google": "Search", "maps": "Maps", "clutch": "Clutch", "goodfirms": "GoodFirms"}


def with_profiles(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill what records lack from the page they point to (``source_url``, else ``website``).

    ``profiles`` has page_id, url and html; of several pages with a url the
    first by page_id counts.  Records of other sources, without a link or
    without a page stay as they are.  For map results the page's address comes
    before the snippet's.
    """
    info, from_map = F.col("additional_info"), F.col("source") == "maps"
    label = F.create_map(*[F.lit(x) for pair in PROFILE_LABELS.items() for x in pair])[F.col("source")]
    target = F.when(label.isNotNull(), t.some(t.first_filled(F.col("source_url"), F.col("website"))))
    pages = pg.profile_to_record(profiles, "").withColumn("ord", F.col("page_id"))
    fields = [f for f in RECORD_FIELDS if f not in ("source", "additional_info")]
    known = one_per_key(pages, "url", fields)
    joined = records.withColumn("_url", target).join(known, F.col("_url") == F.col("_key"), "left")
    filled = {f: t.fill_missing(F.col(f), F.col(f"_x_{f}")) for f in fields}
    filled["address"] = F.when(from_map, t.first_filled(F.col("_x_address"), F.col("address"))).otherwise(filled["address"])
    filled["additional_info"] = F.concat_ws(
        " | ", t.some(info), F.concat(label, F.lit(" profile: "), F.col("_key")))
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in records.columns])


# --- seeds -----------------------------------------------------------------

def _seed(url: Column, source: str, confidence: float) -> Column:
    return F.struct(url.alias("url"), F.lit(source).alias("source_name"), F.lit(confidence).alias("confidence"))


def listing_seeds(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Company and website seeds of a directory listing, distinct within ``by``; the page's phone and address go to its last seed."""
    nodes, texts = F.col("nodes"), F.col("texts")
    class_test = rf"(?i)^[^ .]+\.(?:[^ .@]+\.)*[^ .@]*(?:{LISTING_CARD_CLASS})[^ .@]*\.[^ ]*$"

    def seeds_of(link: Column) -> Column:
        href = F.when(link["href"].startswith("/"), F.concat(F.lit("https://www.indiamart.com"), link["href"])).otherwise(
            link["href"])
        good = (F.length(markup.text_of(texts, link, "")) >= 3) & href.startswith("http") & F.contains(
            F.lower(href), F.lit("indiamart.com"))
        around = markup.ancestor(nodes, link, lambda p: p["step"].rlike(class_test))
        inner = t.bind(around, lambda card: markup.select(markup.inside(nodes, card), "a[href]"))
        outside = F.filter(
            F.transform(inner, lambda a: a["href"]),
            lambda h: h.startswith("http") & ~F.contains(F.lower(h), F.lit("indiamart")))
        site = F.get(F.coalesce(outside, F.array().cast("array<string>")), 0)
        return F.when(good, F.filter(F.array(
            _seed(href, "indiamart_listing", 0.85), _seed(site, "indiamart_website", 0.80)),
            lambda s: s["url"].isNotNull() & ((s["source_name"] == "indiamart_listing") | (F.length(s["url"]) > 10)),
        )).otherwise(F.slice(F.array(_seed(href, "", 0.0)), 1, 0))

    links = F.filter(markup.first_selection(nodes, LISTING_LINKS), lambda n: F.coalesce(n["href"], F.lit("")) != "")
    seeds = F.flatten(F.transform(links, lambda n: seeds_of(n)))
    shown_phones = F.transform(markup.select(nodes, LISTING_PHONE), lambda n: markup.text_of(texts, n, ""))
    shown_places = F.transform(markup.select(nodes, LISTING_ADDRESS), lambda n: markup.text_of(texts, n, ""))
    keep = [c for c in pages.columns if c != "html"]
    staged = markup.with_elements(usable(pages)).select(
        *keep, t.pinned(seeds).alias("seeds"),
        F.get(F.filter(shown_phones, lambda p: p.rlike("[0-9]{10}")), 0).alias("phone"),
        F.get(F.filter(shown_places, lambda a: F.length(a) > 10), 0).alias("place"),
    )
    rows = staged.select(*keep, "phone", "place", F.size("seeds").alias("n"), F.posexplode("seeds").alias("pos", "s"))
    last = F.col("pos") == F.col("n") - 1
    out = rows.select(
        *keep, _place().alias("ord"), "s.url", "s.source_name", "s.confidence",
        F.when(last, F.col("phone")).alias("inline_phone"), F.lit(None).cast("string").alias("inline_email"),
        F.when(last, F.col("place")).alias("inline_address"),
    ) if "url" not in keep else rows.select(
        *[c for c in keep if c != "url"], _place().alias("ord"), "s.url", "s.source_name", "s.confidence",
        F.when(last, F.col("phone")).alias("inline_phone"), F.lit(None).cast("string").alias("inline_email"),
        F.when(last, F.col("place")).alias("inline_address"),
    )
    return dedupe_listing(out, by)


def usable(pages: DataFrame) -> DataFrame:
    return pages.filter(F.length("html") >= 500)


def any_link_seeds(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Product detail links anywhere on a page."""
    nodes, texts = F.col("nodes"), F.col("texts")
    links = F.filter(markup.select(nodes, "a[href*='/proddetail/']"), lambda n: F.length(markup.text_of(texts, n, "")) > 3)
    urls = F.transform(links, lambda n: F.when(
        n["href"].startswith("/"), F.concat(F.lit("https://www.indiamart.com"), n["href"])).otherwise(n["href"]))
    found = markup.with_elements(pages.select("page_id", "html")).select(
        "page_id", t.pinned(F.slice(urls, 1, limit)).alias("urls")).select("page_id", F.posexplode("urls").alias("pos", "url"))
    return found.select("page_id", _place().alias("ord"), "url", F.lit("indiamart_listing").alias("source_name"),
                        F.lit(0.80).alias("confidence"))


def card_seeds(pages: DataFrame) -> DataFrame:
    """Profile and website seeds of a second directory's listing page."""
    nodes, texts = F.col("nodes"), F.col("texts")

    def seeds_of(card: Column) -> Column:
        near = markup.around_and_inside(nodes, card)
        own = markup.inside(near, card)

        def from_name(name: Column) -> Column:
            link = markup.ancestor(nodes, name, lambda p: p["tag"] == "a")["href"]
            profile = F.when(link.startswith("/"), F.concat(F.lit("https://www.justdial.com"), link)).otherwise(link)
            site = F.get(F.filter(
                F.transform(markup.select(own, "a[href]"), lambda a: a["href"]),
                lambda h: h.startswith("http") & ~F.contains(h, F.lit("justdial"))), 0)
            both = F.array(_seed(profile, "justdial_listing", 0.75), _seed(site, "justdial_website", 0.80))
            some = F.filter(both, lambda s: F.coalesce(s["url"], F.lit("")) != "")
            return F.when(F.length(markup.text_of(texts, name, "")) >= 3, some)

        return t.bind(F.get(markup.select(own, SEED_NAME, near), 0), from_name)

    cards = markup.first_selection(nodes, SEED_CARDS)
    none = F.slice(F.array(_seed(F.lit(""), "", 0.0)), 1, 0)
    seeds = F.flatten(F.transform(cards, lambda c: F.coalesce(seeds_of(c), none)))
    found = markup.with_elements(pages.select("page_id", "html")).select(
        "page_id", t.pinned(seeds).alias("seeds")).select("page_id", F.posexplode("seeds").alias("pos", "s"))
    return found.select("page_id", _place().alias("ord"), "s.url", "s.source_name", "s.confidence")


def web_seeds(pages: DataFrame) -> DataFrame:
    """Seeds of a web search, search engines themselves left out."""
    rows = listing_rows(pages, RULES["ddg_seeds"]).withColumn("href", t.unwrap_redirect(F.col("href")))
    good = rows.filter(F.col("href").startswith("http") & ~t.contains_any(F.col("href"), fixed.SEARCH_ENGINE_HOSTS))
    return good.select("page_id", _place().alias("ord"), F.col("href").alias("url"),
                       F.lit("duckduckgo").alias("source_name"), F.lit(0.60).alias("confidence"))


def indiamart_records(seeds: DataFrame, query: str = "query") -> DataFrame:
    """Records of listing seeds: the name comes from the address; twenty per query."""
    slug = F.regexp_extract(F.regexp_replace(t.url_path(F.col("url")), "^/+|/+$", ""), "^([^/]*)", 1)
    rank = F.row_number().over(Window.partitionBy(query).orderBy("ord"))
    capped = seeds.withColumn("_n", rank).filter(F.col("_n") <= fixed.SOURCE_CAPS["indiamart"])
    return as_records(capped.select(
        "ord", t.py_title(F.translate(slug, "-_", "  ")).alias("company_name"), F.col("url").alias("website"),
        *[F.coalesce(f"inline_{f}", F.lit("")).alias(f) for f in ("phone", "email", "address")],
        F.lit("indiamart").alias("source"),
        F.concat(F.lit("IndiaMART | "), F.col(query), F.lit(" | confidence="),
                 F.format_string("%.2f", "confidence")).alias("additional_info"),
    ))
