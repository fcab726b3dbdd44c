"""Records, contacts, names and facts from tables of pages.

All of it is per page: no operator here needs a shuffle, and html is dropped
as soon as its last reader is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import contacts, facts, fixed, markup, names, text as t
from leadloom.schema import record

_BLOCK_START = (
    "address|article|aside|blockquote|div|dl|fieldset|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|ul"
)


# --- page level columns ----------------------------------------------------

def json_ld_name(html: Column) -> Column:
    """Name of the first organisation in the page's JSON-LD blocks; empty if there is none."""
    blocks = t.extract_all(html, r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script", 1)
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(
        F.from_json(b, "array<struct<`@type`:string,name:string>>"), F.array())))
    named = F.transform(
        F.filter(items, lambda i: i["@type"].isin(fixed.ORGANIZATION_TYPES)), lambda i: F.trim(i["name"]))
    return F.coalesce(F.get(F.filter(named, lambda n: F.length(n).between(3, 79)), 0), F.lit(""))


def first_heading(html: Column) -> Column:
    return t.fragment_text(t.extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), "")


def name_tiers(html: Column) -> Column:
    """Array of (name, score) candidates, best tier first."""
    title = names.strip_title_noise(t.fragment_text(t.extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>"), ""))
    h1 = first_heading(html)
    tiers = [
        (json_ld_name(html), 10),
        (t.meta_content(html, "property", "og:site_name"), 9),
        (names.copyright_name(t.page_text(html)), 8),
        (title, 6),
        (h1, 5),
    ]

    def usable(c: Column) -> Column:
        name, few = c["name"], F.regexp_count(c["name"], F.lit(rf"[^{t.SPACE_CHARS}]+")) <= 5
        return (
            F.when(c["score"] == 6, F.length(name).between(3, 79))
            .when(c["score"] == 5, F.length(name).between(1, 59) & few)
            .otherwise(name != "")
        )

    found = F.array(*[F.struct(n.alias("name"), F.lit(s).alias("score")) for n, s in tiers])
    return F.filter(found, lambda c: usable(c))


def best_name_of_page(html: Column) -> Column:
    return F.coalesce(names.strip_name_noise(F.get(name_tiers(html), 0)["name"]), F.lit(""))


def name_candidates_of_text(text: Column, domain: Column | None = None, limit: int = 5) -> Column:
    """Array of (name, score) from title, heading and first lines; plausible names, best first."""
    lines = F.transform(F.slice(F.split(text, "\n", 21), 1, 20), lambda x: F.regexp_replace(
        x, rf"^{t.SPACE}+|{t.SPACE}+$", ""))
    liked = F.filter(lines, lambda x: F.length(x).between(4, 149) & x.rlike("^[A-Z]")
                     & ~F.lower(x).rlike(t.any_of(fixed.LINE_STOP_WORDS)))
    tagged = F.filter(
        F.array(t.extract(text, "(?i)<title>([^<]+)</title>"),
                t.extract(text, '(?i)property="og:title" content="([^"]+)"')),
        lambda x: x != "",
    )
    raw = F.concat(tagged, t.extract_all(text, "(?i)<h1[^>]*>([^<]+)</h1>", 1), liked)
    unique = _distinct_first(F.filter(F.transform(raw, lambda x: names.clean_name(x)), lambda x: x != ""))
    scored = F.transform(unique, lambda x, i: F.struct(
        (-names.name_score(x, domain)).alias("minus"), i.alias("pos"), x.alias("name")))
    good = F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"] <= -3)), 1, limit)
    return F.transform(good, lambda s: F.struct(s["name"].alias("name"), (-s["minus"]).alias("score")))


def best_name_of_candidates(candidates: Column) -> Column:
    """Highest score, then longest, then first."""
    ranked = F.array_sort(F.transform(candidates, lambda c, i: F.struct(
        (-c["score"]).alias("s"), (-F.length(c["name"])).alias("l"), i.alias("i"), c["name"].alias("name"))))
    return F.coalesce(F.get(ranked, 0)["name"], F.lit(""))


def external_link(html: Column, url: Column) -> Column:
    """First link that leads away from the page itself and from the blocked hosts."""
    hrefs = F.transform(
        t.extract_all(html, r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1),
        lambda h: F.trim(t.unescape(F.regexp_replace(h, "^[\"']|[\"']$", ""))),
    )
    usable = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("^(?:mailto:|tel:|#|javascript:)"))
    absolute = F.transform(usable, lambda h: t.resolve_url(url, h))
    away = F.filter(absolute, lambda a: (a != "") & (a != url) & ~t.contains_any(a, fixed.PROFILE_LINK_BLOCKLIST))
    return F.coalesce(F.get(away, 0), F.lit(""))


def description_of_page(html: Column) -> Column:
    """Meta description, else the first paragraph, article or section with more than 20 characters, else the text."""
    paragraph = t.extract(html, rf"(?is)<p\b[^>]*>(.*?)(?:</p\s*>|</?(?:{_BLOCK_START}|body|td|li)\b|$)")
    texts = [t.fragment_text(f, " ") for f in (
        paragraph,
        t.extract(html, r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)"),
        t.extract(html, r"(?is)<section\b[^>]*>(.*?)(?:</section\s*>|$)"),
    )]
    shown = [F.get(F.filter(F.array(x), lambda v: F.length(v) > 20), 0) for x in texts]
    return F.coalesce(
        t.some(t.meta_content(html, "name", "description")), *[F.substring(x, 1, 500) for x in shown],
        F.substring(t.page_text(html), 1, 500))


# --- jobs ------------------------------------------------------------------

def page_summary(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Title, distinct sorted e-mails and phones, and the first thousand characters of text."""
    text = F.col("_text")
    mails = F.filter(t.extract_all(text, fixed.EMAIL_PATTERN), lambda m: F.length(m) < 100)
    numbers = F.transform(t.extract_all(text, t.unicode(fixed.SUMMARY_PHONE_PATTERN)),
                          lambda n: F.regexp_replace(n, "[^0-9+]", ""))
    real = F.filter(numbers, lambda n: F.length(contacts.digits(n)).between(9, 15))
    return pages.withColumn("_text", t.squeeze(t.page_text(F.col("html")))).select(
        id, t.page_title(F.col("html")).alias("title"),
        F.array_sort(F.array_distinct(F.transform(mails, lambda m: F.lower(m)))).alias("emails"),
        F.array_sort(F.array_distinct(real)).alias("phones"),
        F.substring(text, 1, 1000).alias("text"),
    )


def contacts_of(df: DataFrame, id: str, text: Column, limit: int = 5) -> DataFrame:
    """Long table of contacts: id, kind, value, rank (1 = best)."""
    both = df.select(F.col(id), text.alias("_text")).select(
        id, contacts.emails(F.col("_text"), limit).alias("email"), contacts.phones(F.col("_text"), limit).alias("phone")
    )
    def ranked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda v, i: F.struct(
            F.lit(kind).alias("kind"), v.alias("value"), (i + 1).alias("rank")))

    return both.select(id, F.inline(F.concat(ranked("email"), ranked("phone"))))


def page_contacts(pages: DataFrame, id: str = "page_id") -> DataFrame:
    return contacts_of(pages, id, t.page_text(F.col("html")))


def profile_to_record(pages: DataFrame, source: str, id: str = "page_id", addresses: bool = True) -> DataFrame:
    """One record per page: best contacts, first address, first outside link, description and name."""
    url, html, text = F.col("url"), F.col("html"), F.col("_text")
    columns = [c for c in dict.fromkeys([id, "url"]) if c in pages.columns]
    base = pages.select(*columns, "html", t.page_text(html).alias("_text"))
    if addresses:
        parsed = markup.with_elements(base.withColumn("_html", html))
        base = parsed.withColumn("_address", F.coalesce(F.get(address_blocks(), 0), F.lit(""))).withColumnRenamed(
            "_html", "html")
    else:
        base = base.withColumn("_address", F.lit(""))
    candidates = name_candidates_of_text(text, t.domain_of(url))
    return base.select(
        *columns,
        *record(
            company_name=best_name_of_candidates(candidates),
            website=external_link(html, url),
            email=contacts.best_email(text),
            phone=contacts.best_phone(text),
            address=F.col("_address"),
            description=description_of_page(html),
            source=F.lit(source),
            additional_info=F.concat(F.lit(f"{source} profile: "), url),
        ),
    )


def name_candidates(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """All confidence tiers of every page and the name that wins."""
    html = F.col("html")
    tiers = pages.select(id, t.pinned(name_tiers(html)).alias("tiers"))
    best = F.coalesce(names.strip_name_noise(F.get("tiers", 0)["name"]), F.lit(""))
    return tiers.select(id, best.alias("best_name"), F.posexplode("tiers").alias("pos", "c")).select(
        id, "best_name", F.col("c.name").alias("name"), F.col("c.score").alias("score"))


def name_candidates_text(df: DataFrame, id: str, text: str = "text", domain: Column | None = None) -> DataFrame:
    found = df.select(id, name_candidates_of_text(F.col(text), domain).alias("found"))
    return found.select(id, best_name_of_candidates(F.col("found")).alias("best_name"),
                        F.posexplode("found").alias("pos", "c")).select(
        id, "best_name", (F.col("pos") + 1).alias("rank"), F.col("c.name").alias("name"), F.col("c.score").alias("score"))


def _distinct_first(texts: Column) -> Column:
    """Case-insensitive distinct inside one array, first spelling and order kept."""
    sorted_texts = F.array_sort(F.transform(
        texts, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = t.bind(sorted_texts, lambda keyed: F.filter(
        keyed, lambda s, i: (i == 0) | (s["k"] != F.get(keyed, i - 1)["k"])))
    in_order = F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return F.transform(in_order, lambda s: s["x"])


def _block_texts(tags: list[str]) -> Column:
    nodes, texts = F.col("nodes"), F.col("texts")
    blocks = F.filter(nodes, lambda n: n["tag"].isin(tags) & (n["t1"] > n["t0"]))
    return F.transform(blocks, lambda n: F.struct(
        n["tag"].alias("tag"), n["step"].alias("step"), t.squeeze(markup.text_of(texts, n)).alias("text")))


def address_blocks() -> Column:
    """Addresses of a page whose elements are in ``nodes`` and ``texts``."""
    words = "|".join(fixed.ADDRESS_CLASS_WORDS)
    in_class = rf"(?i)^[^ .]+\.(?:[^ .@]+\.)*[^ .@]*(?:{words})[^ .@]*\.[^ ]*$"
    hits = F.filter(
        _block_texts(["address", "p", "div", "span", "li"]),
        lambda b: (b["text"] != "")
        & ((b["tag"] == "address") | b["step"].rlike(in_class) | b["text"].rlike(t.unicode_i(fixed.ADDRESS_PATTERN))),
    )
    return _distinct_first(F.transform(hits, lambda b: b["text"]))


def page_addresses(pages: DataFrame, id: str = "page_id") -> DataFrame:
    found = markup.with_elements(pages.select(id, "html")).select(
        id, t.pinned(address_blocks()).alias("found")).select(id, F.posexplode("found").alias("pos", "address"))
    return found.select(id, (F.col("pos") + 1).alias("rank"), "address")


def decision_makers(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Blocks that mention a leading role, with the person's name in front when one is found."""
    blocks = _block_texts(["p", "li", "h1", "h2", "h3", "h4", "span", "div"])
    hits = F.filter(blocks, lambda b: t.contains_any(F.lower(b["text"]), fixed.ROLE_KEYWORDS))

    def shown(b: Column) -> Column:
        person = t.extract(b["text"], t.unicode(fixed.PERSON_PATTERN))
        return F.coalesce(F.concat(t.some(person), F.lit(" ("), b["text"], F.lit(")")), b["text"])

    found = markup.with_elements(pages.select(id, "html")).select(
        id, t.pinned(_distinct_first(F.transform(hits, lambda b: shown(b)))).alias("found")).select(
        id, F.posexplode("found").alias("pos", "person"))
    return found.select(id, (F.col("pos") + 1).alias("rank"), "person")


def page_description(pages: DataFrame, id: str = "page_id") -> DataFrame:
    return pages.select(id, description_of_page(F.col("html")).alias("description"))


def is_blocked(html: Column, shortest: int = 500) -> Column:
    challenge = F.contains(html, F.lit(fixed.CAPTCHA_MARKERS[0])) | F.contains(html, F.lit(fixed.CAPTCHA_MARKERS[1]))
    return F.coalesce(challenge | (F.length(html) < shortest), F.lit(True))


def usable_pages(pages: DataFrame, shortest: int = 500) -> DataFrame:
    """Pages without bot challenges and stubs."""
    return pages.filter(~is_blocked(F.col("html"), shortest))


def blocked_pages(pages: DataFrame, shortest: int = 500) -> DataFrame:
    """How many pages are unusable, per host."""
    return pages.groupBy(t.url_host(F.col("url")).alias("host")).agg(
        F.count("*").alias("n_pages"), F.count_if(is_blocked(F.col("html"), shortest)).alias("n_blocked"))


def profile_facts(pages: DataFrame, rule: str, id: str = "page_id", cards: bool = True) -> DataFrame:
    """Facts of directory profile pages as a fill table: people, turnover, size, business, address, registration."""
    rules = fixed.PROFILE_RULES[rule]
    html, text = F.col("html"), F.col("_text")
    own = pages.select(id, "html", t.raw_text(html).alias("_text"))
    roles = []
    for role, pattern in rules["contact"]:
        person = F.trim(t.extract(text, t.unicode_i(pattern)))
        roles.append(F.get(F.filter(F.array(F.struct(person.alias("name"), F.lit(role).alias("role"))),
                                    lambda p: F.length(p["name"]).between(5, 49)), 0))
    own = own.withColumn("_who", F.coalesce(*roles))
    if cards:
        own = markup.with_elements(own)
        shown = F.transform(markup.select(F.col("nodes"), rules["contact_cards"]),
                            lambda n: markup.text_of(F.col("texts"), n, ""))
        good = F.get(F.filter(shown, lambda x: F.length(x).between(5, 49) & x.rlike("^[A-Z][a-z]")), 0)
        own = own.withColumn("_who", F.coalesce("_who", F.when(good.isNotNull(), F.struct(
            good.alias("name"), F.lit("Contact Person").alias("role")))))
    raw = t.first_filled(*[t.extract(text, t.unicode_i(p)) for p in rules["turnover"]])
    staff = facts.as_count(t.extract(t.extract(text, t.unicode_i(rules["employees"])), "[0-9,]+", 0))
    gst = t.extract(text, t.unicode_i(fixed.PROFILE_GST))
    return own.select(
        id,
        F.coalesce("_who.name", F.lit("")).alias("contact_name"),
        F.coalesce("_who.role", F.lit("")).alias("owner_role"),
        t.bind(raw, lambda r: F.when(r != "", facts.turnover_crore(r)).otherwise("")).alias("turnover"),
        F.coalesce(t.bind(staff, facts.believable_band), F.lit("")).alias("employee_count"),
        F.trim(t.extract(text, t.unicode_i(rules["nature"]))).alias("industry_type"),
        (F.trim(t.extract(text, t.unicode_i(rules["address"]))) if rules["address"] else F.lit("")).alias("address"),
        F.coalesce(F.concat(F.lit("GST: "), t.some(gst)), F.lit("")).alias("additional_info"),
    )


# --- free text -------------------------------------------------------------

def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity")))


def entities(text: Column) -> Column:
    """Array of (entity_type, entity): distinct values of every entity type."""
    typed = []
    for kind, pattern in fixed.ENTITY_PATTERNS.items():
        group = 1 if kind in ("ERP", "EMPLOYEES") else 0
        found = F.transform(t.extract_all(text, t.unicode(pattern), group), lambda m: F.regexp_replace(
            m, rf"^{t.SPACE}+|{t.SPACE}+$", ""))
        distinct = F.array_distinct(F.filter(found, lambda m: m != ""))
        typed.append(_typed(kind, distinct))
    return F.concat(*typed)


def entity_long(df: DataFrame, id: str, text_columns: list[str]) -> DataFrame:
    """Entities found in the non-empty values of a row put together."""
    joined = F.concat_ws(" | ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in text_columns])
    return df.select(id, joined.alias("_text")).select(id, F.inline(entities(F.col("_text"))))


def label_spans(companies: DataFrame, id: str) -> DataFrame:
    """Companies put into sentence templates, with the place of every value.

    Columns read: company, person, phone, email, address, industry, revenue, erp.
    """
    labels = ["company", "person", "phone", "email", "address", "industry", "revenue", "erp"]
    value = {x: F.when(F.trim(F.col(x)).isin(fixed.LABEL_MISSING), F.lit("")).otherwise(F.trim(F.col(x))) for x in labels}
    value["person"] = F.trim(F.replace(F.substring_index(value["person"], "\n", 1), F.lit("CEO - "), F.lit("")))
    value["email"] = F.substring_index(t.squeeze(value["email"]), " ", 1)
    ready = companies.select(id, *[F.coalesce(value[x], F.lit("")).alias(x) for x in labels])
    filled = ready.select(id, *labels, F.posexplode(F.array(*map(F.lit, fixed.LABEL_TEMPLATES))).alias("template", "_template"))
    text = F.col("_template")
    for x in labels:
        text = F.replace(text, F.lit("{" + x.upper() + "}"), F.col(x))
    # what is counted and unnested below is made once: pinned texts and spans are not copied into filters
    filled = filled.select(id, *labels, "template", t.pinned(t.squeeze(text)).alias("text"))
    spans = F.filter(F.array(*[
        F.struct((F.instr("text", F.col(x)) - 1).alias("start"),
                 (F.instr("text", F.col(x)) - 1 + F.length(x)).alias("end"),
                 F.when(F.col(x) != "", F.lit(x.upper())).alias("label"))
        for x in labels
    ]), lambda s: s["label"].isNotNull() & (s["start"] >= 0))
    return filled.select(id, "template", "text", t.pinned(spans).alias("spans")).filter(F.size("spans") > 0)
