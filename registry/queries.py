"""The registered queries: a name, the Spark job and, where SQL can state it, the statement to check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import facts, fixed, markup, places, text as t
from leadloom.operators import enrich, knowledge, listing, pages as pg, params, records as rec, resolve, serve
from leadloom.plans import leads
from leadloom.schema import RECORD_FIELDS
from leadloom.sources import readers, sinks
from registry import sqltext as q, views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LOW = "3.0"  # the generated pages have few contacts: the usual threshold would leave almost nothing to look at


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(job: Query) -> Query:
        QUERIES[name] = job
        if sql:
            SQL[name] = sql
        return job
    return add


# --- A: sources ------------------------------------------------------------

_NAMED_PARAMS = (
    "SELECT c_custkey AS ord, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(c_mktsegment) || ' erp' END AS a,"
    " CASE WHEN c_custkey % 7 < 2 THEN ' ' ELSE c_name END AS b, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS c,"
    " CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS d FROM customer JOIN nation ON n_nationkey = c_nationkey"
)


@query("read_params", (
    f"SELECT ord, {q.first_filled('trim(a)', 'trim(b)')} AS keyword, nullif(trim(c), '') AS location,"
    f" nullif(trim(d), '') AS industry FROM ({_NAMED_PARAMS}) WHERE {q.first_filled('trim(a)', 'trim(b)')} <> ''"
))
def _(spark, sf):
    k = F.col("c_custkey")
    nation = F.broadcast(v.table(spark, sf, "nation"))
    raw = v.table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        k.alias("ord"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" erp"))).alias("keyword"),
        F.when(k % 7 < 2, " ").otherwise(F.col("c_name")).alias("Company Name"),
        F.when(k % 3 != 0, F.col("n_name")).alias("Address"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("Industry_Type"),
    )
    return params.params_from_table(raw)


@query("load_results", (
    "SELECT coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END, n::VARCHAR) AS id, n::VARCHAR AS sl_no, s_name"
    " FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)"
))
def _(spark, sf):
    k = F.col("s_suppkey")
    raw = v.table(spark, sf, "supplier").select(
        k, "s_name", F.when(k % 3 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("id"))
    numbered = serve.serial_number(raw, "s_suppkey", name="n")
    return readers.with_default_ids(numbered, F.col("n")).select("id", F.col("`SL No.`").alias("sl_no"), "s_name")


@query("union_sources", (
    "SELECT c_custkey AS ord, c_name AS company_name, c_mktsegment AS industry, '' AS phone, 'customers' AS source FROM customer"
    " UNION ALL SELECT s_suppkey, s_name, '', '', 'suppliers' FROM supplier"
))
def _(spark, sf):
    customers = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"))
    suppliers = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("company_name"))
    return readers.union_sources(customers=customers, suppliers=suppliers).select(
        "ord", "company_name", "industry", "phone", "source")


_SEED_NAMES = ["indiamart_listing", "indiamart_website", "justdial_listing", "justdial_website", "duckduckgo"]
_SEED_SCORES = ["0.85", "0.8", "0.75", "0.8", "0.6"]


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("page_id", F.lit(5)) + 1
    return v.pages(spark, sf).select(
        F.col("page_id").alias("ord"), "url",
        F.element_at(F.array(*map(F.lit, _SEED_NAMES)), k.cast("int")).alias("source_name"),
        F.element_at(F.array(*[F.lit(float(x)) for x in _SEED_SCORES]), k.cast("int")).alias("confidence"),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("98765"), F.lpad(F.col("page_id").cast("string"), 5, "0"))).alias(
            "inline_phone"),
        F.lit(None).cast("string").alias("inline_email"),
        F.when(F.col("page_id") % 6 == 0, "MG Road, Pune").alias("inline_address"),
    )


_SEEDS_SQL = (
    f"(SELECT page_id AS ord, url, ([{q.lits(_SEED_NAMES)}])[page_id % 5 + 1] AS source_name,"
    f" ([{q.lits(_SEED_SCORES)}])[page_id % 5 + 1] AS score,"
    " CASE WHEN page_id % 4 = 0 THEN '98765' || lpad(page_id::VARCHAR, 5, '0') ELSE '' END AS phone,"
    " CASE WHEN page_id % 6 = 0 THEN 'MG Road, Pune' ELSE '' END AS address FROM pages)"
)


@query("seeds_to_records", (
    "SELECT ord, CASE WHEN source_name LIKE '%_website' THEN url ELSE '' END AS website, phone, address, 'India' AS country,"
    " source_name AS source, url AS source_url, 'Source: ' || source_name || ' | Confidence: ' || score ||"
    " CASE WHEN source_name LIKE '%_listing' THEN ' | Profile: ' || url ELSE '' END AS additional_info FROM " + _SEEDS_SQL
))
def _(spark, sf):
    return readers.seeds_to_records(_seeds(spark, sf)).select(
        "ord", "website", "phone", "address", "country", "source", "source_url", "additional_info")


@query("source_mappers")
def _(spark, sf):
    fetched = v.pages(spark, sf).withColumn("query", F.lit("all")).withColumn(
        "source", F.element_at(F.array(*map(F.lit, ["website", "direct_website", "discovery", "goodfirms", "searx"])),
                               (F.pmod("page_id", F.lit(5)) + 1).cast("int")))
    return readers.records_of_all(fetched, ["website", "direct_website", "discovery", "goodfirms", "searx"]).select(
        "ord", "company_name", "website", "email", "phone", "description", "source", "additional_info")


# --- B: parameters ---------------------------------------------------------

def _part_params(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    nation = F.broadcast(v.table(spark, sf, "nation"))
    word = F.when(k % 10 == 0, F.concat(F.col("p_name"), F.lit(" tally"))).when(k % 17 == 0, "finance").otherwise(F.col("p_name"))
    return v.table(spark, sf, "part").join(nation, F.col("n_nationkey") == k % 25).select(
        k.alias("ord"), word.alias("keyword"),
        F.when(k % 3 != 0, F.col("n_name")).alias("location"), F.when(k % 4 != 0, F.col("p_brand")).alias("industry"))


_PART_PARAMS = (
    "(SELECT p_partkey AS ord, CASE WHEN p_partkey % 10 = 0 THEN p_name || ' tally' WHEN p_partkey % 17 = 0 THEN 'finance'"
    " ELSE p_name END AS keyword, CASE WHEN p_partkey % 3 <> 0 THEN n_name END AS location,"
    " CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS industry FROM part JOIN nation ON n_nationkey = p_partkey % 25)"
)
_ERP_HIT = " OR ".join(f"contains(lower(keyword), {q.lit(w)})" for w in fixed.ERP_TRIGGERS)


@query("build_queries", (
    "SELECT ord, pos, query FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, pos) AS n FROM ("
    "SELECT ord, unnest(range(len(l))) AS pos, unnest(l) AS query FROM (SELECT ord, list_concat([trim(keyword)], CASE WHEN "
    + _ERP_HIT + f" THEN list_transform([{q.lits(fixed.ERP_VARIANTS)}], lambda x: CASE WHEN location IS NULL THEN x ELSE x || ' ' || location END)"
    " ELSE [trim(keyword) || ' ' || location, trim(keyword) || ' ' || industry] END) AS l FROM " + _PART_PARAMS + "))"
    " WHERE query IS NOT NULL AND query <> '' AND NOT contains(lower(query), 'nan') AND NOT contains(lower(query), 'none')) WHERE n = 1"
))
def _(spark, sf):
    return params.build_queries(_part_params(spark, sf))


_ASKED = "trim(" + q.sub(q.squeeze("text"), fixed.REQUEST_VERBS) + ")"
_WHERE = (
    r"(?i)(^|[^\p{L}\p{N}_])((?:in|near|from|at|around|across)\s+)([A-Za-z][a-zA-Z\s]+?)"
    r"(\s+(?:who|that|which|providing|with|for|and|,|\.|$)|[,.]|$)"
)


@query("parse_requests", (
    "SELECT id, " + q.squeeze("CASE WHEN hit <> '' THEN left(asked, strpos(asked, hit) - 1) || ' ' || substr(asked, strpos(asked, hit) + length(hit)) ELSE asked END")
    + " AS keyword, rtrim(trim(place), '.,') AS location, '' AS industry FROM (SELECT id, asked, " + q.ext("asked", _WHERE, 3) + " AS place, "
    + q.ext("asked", _WHERE, 2) + " || " + q.ext("asked", _WHERE, 3)
    + f" AS hit FROM (SELECT conv_id * 1000 + turn AS id, {_ASKED} AS asked FROM conversations WHERE role = 'user'))"
))
def _(spark, sf):
    asked = v.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return params.parse_requests(asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id")


_CITY_OF = "(['Mumbai', 'new delhi', 'Navi Mumbai', 'kota', '', 'Indiana'])[(p_partkey % 6 + 1)::INT]"
_CITIES_BY_LENGTH = sorted(dict.fromkeys(fixed.QUERY_CITIES), key=lambda c: -len(c))


@query("split_city", (
    "SELECT ord, query, CASE WHEN city = '' THEN query ELSE coalesce(nullif(trim(replace(lower(query), city, ''), ' ,'), ''), query) END AS keyword,"
    f" city FROM (SELECT *, coalesce(list_filter([{q.lits(_CITIES_BY_LENGTH)}], lambda c: contains(lower(query), c))[1], '') AS city"
    f" FROM (SELECT p_partkey AS ord, trim(p_name || ', ' || {_CITY_OF}) AS query FROM part))"
))
def _(spark, sf):
    k = F.pmod("p_partkey", F.lit(6)) + 1
    city = F.element_at(F.array(*map(F.lit, ["Mumbai", "new delhi", "Navi Mumbai", "kota", "", "Indiana"])), k.cast("int"))
    asked = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.trim(F.concat("p_name", F.lit(", "), city)).alias("query"))
    return params.split_city(asked)


_ROUTE_TRADE = "(['steel tubes', 'retail shop', 'Mustard Oil', 'pharma', 'software'])[(c_custkey % 5 + 1)::INT]"
_ROUTE_PLACE = "([NULL, 'Kolkata', 'Bengaluru, India', 'Paris', 'surat', 'Delhi NCR', ''])[(c_custkey % 7 + 1)::INT]"
_DIRECTORY = (
    "(" + " OR ".join(f"contains(lower(coalesce(location, '')), {q.lit(w)})" for w in fixed.DIRECTORY_CITIES) + ") AND ("
    + " OR ".join(f"contains(lower(keyword), {q.lit(w)})" for w in fixed.DIRECTORY_INDUSTRIES) + ")"
)


@query("route_queries", (
    f"SELECT ord, keyword, location, CASE WHEN {_DIRECTORY} THEN 'directory' ELSE 'general' END AS route,"
    f" CASE WHEN {_DIRECTORY} THEN keyword ELSE '' END AS directory_industry,"
    f" CASE WHEN {_DIRECTORY} THEN coalesce(nullif(location, ''), 'kolkata') ELSE '' END AS directory_city"
    f" FROM (SELECT c_custkey AS ord, {_ROUTE_TRADE} AS keyword, {_ROUTE_PLACE} AS location FROM customer)"
))
def _(spark, sf):
    def pick(values, n):
        return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (F.pmod("c_custkey", F.lit(n)) + 1).cast("int"))

    asked = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), pick(["steel tubes", "retail shop", "Mustard Oil", "pharma", "software"], 5).alias("keyword"),
        pick([None, "Kolkata", "Bengaluru, India", "Paris", "surat", "Delhi NCR", ""], 7).alias("location"),
        F.lit(None).cast("string").alias("industry"))
    return params.route_queries(asked).drop("industry")


@query("work_items", (
    "SELECT query, platform_pos, platform, CASE platform WHEN 'discovery' THEN 0 WHEN 'website' THEN 2 ELSE 1 END AS phase"
    " FROM (SELECT DISTINCT event_type || ' ' || (user_id % 5) AS query FROM events),"
    f" (SELECT unnest(range({len(fixed.PLATFORMS)}))::INT AS platform_pos, unnest([{q.lits(fixed.PLATFORMS)}]) AS platform)"
))
def _(spark, sf):
    words = F.concat_ws(" ", "event_type", (F.col("user_id") % 5).cast("string"))
    asked = v.table(spark, sf, "events").select(words.alias("query")).distinct()
    return params.work_items(asked)


@query("website_targets", (
    f"SELECT query, website, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, website) AS rank FROM ("
    f"SELECT {q.host('url')} AS query, url AS website, min(page_id) AS ord FROM pages WHERE {q.rx('url', '^https?://')}"
    " GROUP BY 1, 2)) WHERE rank <= 10"
))
def _(spark, sf):
    found = v.pages(spark, sf).select(t.url_host(F.col("url")).alias("query"), F.col("page_id").alias("ord"), F.col("url").alias("website"))
    return params.website_targets(found)


_WORDS = q.sub("name", rf"[^\p{{L}}\p{{N}}_{t.SPACE_CHARS}]", " ")
_NAMES_SQL = "(SELECT c_custkey * 2 AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name")).unionByName(
        v.table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("name")))


@query("candidate_urls", (
    "SELECT id, unnest(range(5))::INT AS pos, unnest(list_transform("
    f"[{q.lits(fixed.GUESS_TLDS)}], lambda d: 'https://www.' || lower(replace(trim({_WORDS}), ' ', '')) || d)) AS url FROM {_NAMES_SQL}"
))
def _(spark, sf):
    return params.candidate_urls(_names(spark, sf), "id", "name")


@query("candidate_urls_written", (
    "SELECT page_id AS id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS url FROM (SELECT page_id, list_transform("
    + q.ext_all("(CASE WHEN page_id % 3 = 0 THEN 'see ' || url || ',' ELSE 'Nova Steel' END)", r"https?://[^\s<>\"{}|\\^`\[\]]+")
    + "[1:5], lambda u: rtrim(u, '.,;:')) AS w, CASE WHEN len(w) > 0 THEN w ELSE ['https://NovaSteel.com', 'https://www.NovaSteel.com',"
    " 'https://nova-steel.com', 'https://www.nova-steel.com'] END AS l FROM pages)"
))
def _(spark, sf):
    asked = v.pages(spark, sf).select(F.col("page_id").alias("id"), F.when(
        F.col("page_id") % 3 == 0, F.concat(F.lit("see "), "url", F.lit(","))).otherwise("Nova Steel").alias("query"))
    return params.candidate_urls(asked, "id", "query", written=True)


_SLUG_I, _SLUG_C = "replace(trim(i), ' ', '-')", "replace(lower(c), '_', '-')"
_DIR_TITLE = q.title(_SLUG_C)


@query("directory_urls", (
    f"SELECT id, u.directory, u.pos, u.url FROM (SELECT id, unnest([{{'directory': 'directory1', 'pos': 0, 'url': 'https://dir.indiamart.com/search.mp?ss=' || replace(i, ' ', '+') || '&city=' || c || '&prdc=on'}},"
    " {'directory': 'directory1', 'pos': 1, 'url': 'https://www.indiamart.com/search?q=' || replace(i, ' ', '+')},"
    " {'directory': 'directory1', 'pos': 2, 'url': 'https://m.indiamart.com/search?q=' || replace(i, ' ', '+')},"
    f" {{'directory': 'directory1', 'pos': 3, 'url': 'https://dir.indiamart.com/impcat/' || {_SLUG_I} || '.html?biz=' || {_SLUG_C}}},"
    f" {{'directory': 'directory1', 'pos': 4, 'url': 'https://dir.indiamart.com/impcat/' || {_SLUG_I} || '.html'}},"
    f" {{'directory': 'directory2', 'pos': 0, 'url': 'https://www.justdial.com/' || {_DIR_TITLE} || '/' || {_SLUG_I} || '-in-' || {_SLUG_C}}},"
    f" {{'directory': 'directory2', 'pos': 1, 'url': 'https://www.justdial.com/' || {_DIR_TITLE} || '/' || replace(i, ' ', '-') || '-in-' || {_DIR_TITLE}}},"
    f" {{'directory': 'directory2', 'pos': 2, 'url': 'https://www.justdial.com/' || {_DIR_TITLE} || '/' || {_SLUG_I} || '-in-' || {_SLUG_C} || '/nct-10462188'}},"
    f" {{'directory': 'directory2', 'pos': 3, 'url': 'https://www.justdial.com/' || {_DIR_TITLE} || '/' || {_SLUG_I}}}]) AS u"
    " FROM (SELECT p_partkey AS id, p_name AS i, n_name AS c FROM part JOIN nation ON n_nationkey = p_partkey % 25))"
))
def _(spark, sf):
    nation = F.broadcast(v.table(spark, sf, "nation"))
    asked = v.table(spark, sf, "part").join(nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("i"), F.col("n_name").alias("c"))
    return params.directory_urls(asked, "id", "i", "c")


@query("first_yielding_directory", (
    "SELECT id, directory, url, n_rows FROM (SELECT id, directory, pos, 'u' || (id % 40) || '-' || pos AS url FROM"
    " (SELECT DISTINCT user_id AS id FROM events), (SELECT 'directory1' AS directory), (SELECT unnest(range(5)) AS pos))"
    " JOIN (SELECT 'u' || (user_id % 40) || '-' || (event_id % 4 + 1) AS url, count(*) AS n_rows FROM events WHERE event_type = 'click' GROUP BY 1) USING (url)"
    " QUALIFY row_number() OVER (PARTITION BY id, directory ORDER BY pos) = 1"
))
def _(spark, sf):
    events = v.table(spark, sf, "events")
    asked = events.select(F.col("user_id").alias("id")).distinct().select(
        "id", F.lit("directory1").alias("directory"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    urls = asked.withColumn("url", F.concat(F.lit("u"), (F.col("id") % 40).cast("string"), F.lit("-"), F.col("pos").cast("string")))
    rows = events.filter(F.col("event_type") == "click").groupBy(F.concat(
        F.lit("u"), (F.col("user_id") % 40).cast("string"), F.lit("-"), (F.col("event_id") % 4 + 1).cast("string")).alias("url")).agg(
        F.count("*").alias("n_rows"))
    return params.first_yielding(urls, rows, "id").select("id", "directory", "url", "n_rows")


@query("top_n_per_source", (
    "SELECT event_id, user_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rank FROM events)"
    " WHERE rank <= CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 8 WHEN 'error' THEN 5 ELSE 12 END"
))
def _(spark, sf):
    out = params.top_n_per_source(v.table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"],
                                  {"click": 10, "view": 8, "error": 5}, default_cap=12)
    return out.select("event_id", "user_id", "event_type", "rank")


# --- C: pages --------------------------------------------------------------

_TXT = q.squeeze(q.page_text("html"))
_SUMMARY_PHONES = (
    f"list_sort(list_distinct(list_filter(list_transform({q.ext_all('txt', fixed.SUMMARY_PHONE_PATTERN)}, lambda n: {q.sub('n', '[^0-9+]')}),"
    f" lambda n: length({q.digits('n')}) BETWEEN 9 AND 15)))"
)


@query("page_summary", (
    f"SELECT page_id, title, array_to_string(list_sort(list_distinct(list_transform(list_filter({q.ext_all('txt', fixed.EMAIL_PATTERN)},"
    f" lambda m: length(m) < 100), lambda m: lower(m)))), ',') AS emails, array_to_string({_SUMMARY_PHONES}, ',') AS phones,"
    f" left(txt, 1000) AS text FROM (SELECT page_id, {q.page_title('html')} AS title, {_TXT} AS txt FROM pages)"
))
def _(spark, sf):
    return pg.page_summary(v.pages(spark, sf)).withColumns(
        {c: F.array_join(c, ",") for c in ("emails", "phones")})


def _contacts_sql(source: str, id: str) -> str:
    return (
        f"SELECT {id}, 'email' AS kind, unnest(m) AS value, unnest(range(1, len(m) + 1))::INT AS rank FROM (SELECT {id}, {q.emails('txt')} AS m FROM {source})"
        f" UNION ALL SELECT {id}, 'phone', unnest(p), unnest(range(1, len(p) + 1))::INT FROM (SELECT {id}, {q.phones('txt')} AS p FROM {source})"
    )


@query("page_contacts", _contacts_sql(f"(SELECT page_id, {q.page_text('html')} AS txt FROM pages)", "page_id"))
def _(spark, sf):
    return pg.page_contacts(v.pages(spark, sf))


@query("document_contacts", _contacts_sql("(SELECT doc_id, text AS txt FROM documents)", "doc_id"))
def _(spark, sf):
    return pg.contacts_of(v.table(spark, sf, "documents"), "doc_id", F.col("text"))


_P_TEXT = q.fragment_text(q.ext("html", (
    r"(?is)<p\b[^>]*>(.*?)(?:</p\s*>|</?(?:address|article|aside|blockquote|div|dl|fieldset|footer|form|h[1-6]|header|hr|main|nav|"
    r"ol|p|pre|section|table|ul|body|td|li)\b|$)")), " ")
_A_TEXT = q.fragment_text(q.ext("html", r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)"), " ")
_DESCRIPTION = f"left(CASE WHEN length({_P_TEXT}) > 20 THEN {_P_TEXT} WHEN length({_A_TEXT}) > 20 THEN {_A_TEXT} ELSE {q.page_text('html')} END, 500)"
_LINK = (
    "list_filter(list_transform(list_filter(" + q.ext_all("html", r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"", 1)
    + ", lambda h: h <> '' AND NOT regexp_matches(h, '^(?:mailto:|tel:|#|javascript:)')), lambda h: CASE WHEN starts_with(h, '/') THEN "
    + q.ext("url", "^(https?://[^/?#]*)") + " || h ELSE h END), lambda a: a <> url AND NOT "
    + q.rx("a", q.any_of(fixed.PROFILE_LINK_BLOCKLIST)) + ")[1]"
)


@query("profile_to_record", (
    f"SELECT page_id, url, coalesce({_LINK}, '') AS website, coalesce({q.emails('txt', 1)}[1], '') AS email,"
    f" coalesce({q.phones('txt', 1)}[1], '') AS phone, description, 'web' AS source, 'web profile: ' || url AS additional_info"
    f" FROM (SELECT page_id, url, html, {q.page_text('html')} AS txt, {_DESCRIPTION} AS description FROM pages)"
))
def _(spark, sf):
    return pg.profile_to_record(v.pages(spark, sf), "web", addresses=False).select(
        "page_id", "url", "website", "email", "phone", "description", "source", "additional_info")


_TITLE = q.fragment_text(q.ext("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>"), "")
for _noise in fixed.TITLE_NOISE:
    _TITLE = f"trim({q.sub(_TITLE, '(?i)' + _noise)})"
_H1 = q.fragment_text(q.ext("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), "")
_NAME_NOISE = q.sub(q.sub("best", "(?i)" + fixed.NAME_NOISE), r"^[ \-|:]+|[ \-|:]+$")


@query("name_candidates", (
    f"SELECT page_id, CASE WHEN {q.rx(_NAME_NOISE, '[A-Za-z]{2,}')} THEN {_NAME_NOISE} ELSE '' END AS best_name, c.name AS name, c.score AS score FROM ("
    "SELECT page_id, tiers[1].name AS best, unnest(tiers) AS c FROM (SELECT page_id, list_filter([{'name': cp, 'score': 8}, {'name': ttl, 'score': 6}, {'name': h1, 'score': 5}],"
    f" lambda x: CASE x.score WHEN 6 THEN length(x.name) BETWEEN 3 AND 79 WHEN 5 THEN length(x.name) BETWEEN 1 AND 59 AND {q.count('x.name', '[^ ]+')} <= 5 ELSE x.name <> '' END) AS tiers"
    f" FROM (SELECT page_id, trim({q.ext(q.page_text('html'), fixed.COPYRIGHT_NAME)}) AS cp, {_TITLE} AS ttl, {_H1} AS h1 FROM pages)))"
))
def _(spark, sf):
    return pg.name_candidates(v.pages(spark, sf))


_LINES = (
    "list_filter(list_transform(str_split(text, chr(10))[1:20], lambda x: " + q.sub("x", rf"^{t.SPACE}+|{t.SPACE}+$")
    + "), lambda x: length(x) BETWEEN 4 AND 149 AND " + q.rx("x", "^[A-Z]") + " AND NOT " + q.rx("lower(x)", q.any_of(fixed.LINE_STOP_WORDS)) + ")"
)


@query("name_candidates_text", (
    "WITH c AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT doc_id, " + _LINES + " AS l FROM documents)),"
    f" n AS (SELECT doc_id, arg_min(name, pos) AS name, min(pos) AS pos FROM (SELECT doc_id, pos, {q.clean_name('raw')} AS name FROM c) WHERE name <> '' GROUP BY doc_id, lower(name)),"
    f" s AS (SELECT *, {q.name_score('name')} AS score FROM n),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s WHERE score >= 3)"
    " SELECT doc_id, first_value(name) OVER (PARTITION BY doc_id ORDER BY score DESC, length(name) DESC, rank) AS best_name, rank, name, score FROM r WHERE rank <= 5"
))
def _(spark, sf):
    return pg.name_candidates_text(v.table(spark, sf, "documents"), "doc_id")


@query("page_addresses")
def _(spark, sf):
    return pg.page_addresses(v.pages(spark, sf))


@query("page_description", f"SELECT page_id, {_DESCRIPTION} AS description FROM pages")
def _(spark, sf):
    return pg.page_description(v.pages(spark, sf))


@query("decision_makers")
def _(spark, sf):
    return pg.decision_makers(v.pages(spark, sf))


@query("listing_rows", (
    "SELECT page_id, (unnest(range(len(l))))::INT AS pos, unnest(l).name AS name, unnest(l).href AS href FROM (SELECT page_id, list_transform("
    + q.ext_all("html", r"<li><a href=\"[^\"]*\">[^<]*</a></li>")
    + ", lambda x: {'href': " + q.ext("x", r"href=\"([^\"]*)\"") + ", 'name': trim(" + q.ext("x", ">([^<]*)</a>") + ")}) AS l FROM pages)"
))
def _(spark, sf):
    return listing.listing_rows(v.pages(spark, sf), listing.Rule(["nav li"], ["a"], None)).select("page_id", "pos", "name", "href")


_WRAPPED = (
    "CASE page_id % 3 WHEN 0 THEN '//duckduckgo.com/l/?uddg=' || replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '&', '%26'), '=', '%3D') || '&rut=1'"
    " WHEN 1 THEN '//' || split_part(url, '://', 2) ELSE url END"
)


@query("unwrap_redirects", (
    "SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'https://' || split_part(url, '://', 2) WHEN 0 THEN split_part(url, '#', 1) ELSE url END AS target,"
    f" {_WRAPPED} AS href FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '#', 1) ELSE url END AS url FROM pages)"
))
def _(spark, sf):
    url = F.col("u")
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?uddg="), *[_percent(url)], F.lit("&rut=1"))
    own = v.pages(spark, sf).select("page_id", F.when(
        F.col("page_id") % 3 == 0, F.substring_index("url", "#", 1)).otherwise(F.col("url")).alias("u"))
    links = own.select("page_id", F.when(F.col("page_id") % 3 == 0, wrapped).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("//"), F.regexp_replace(url, "^[^:]*://", ""))).otherwise(url).alias("href"))
    return links.select("page_id", t.unwrap_redirect(F.col("href")).alias("target"), "href")


def _percent(url):
    for plain, coded in (("%", "%25"), (":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("&", "%26"), ("=", "%3D")):
        url = F.replace(url, F.lit(plain), F.lit(coded))
    return url


_BLOCKED = "(" + " OR ".join(f"contains(html, {q.lit(m)})" for m in fixed.CAPTCHA_MARKERS) + " OR length(html) < 1500)"


@query("blocked_pages", f"SELECT {q.host('url')} AS host, count(*) AS n_pages, count(*) FILTER ({_BLOCKED}) AS n_blocked FROM pages GROUP BY 1")
def _(spark, sf):
    return pg.blocked_pages(v.pages(spark, sf), shortest=1500)


@query("profile_facts")
def _(spark, sf):
    worded = v.entity_records(spark, sf).select(
        F.col("ord").alias("page_id"), F.concat(
            F.lit("<html><body><table><tr><td>Contact Person : Mr. "), "company_name", F.lit("</td></tr></table><p>Annual Turnover: Rs. "),
            (F.col("ord") % 900 + 1).cast("string"), F.lit(" Lakh</p>\n<p>No. of Employees : "), (F.col("ord") % 700 + 1).cast("string"),
            F.lit("</p>\n<p>Nature of Business : "), F.col("source"), F.lit("\n</p><p>GST No: 29ABCDE1234F1Z5</p></body></html>")).alias("html"))
    return pg.profile_facts(worded, "directory1")


@query("registry_directors", (
    "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE length(trim(o_orderpriority)) >= 6)"
    " SELECT o_custkey, max(CASE WHEN n = 1 THEN o_orderpriority END) AS contact_name, max(CASE WHEN n = 1 THEN o_orderstatus END) AS owner_role,"
    " string_agg(o_orderpriority, '; ' ORDER BY n) AS additional_directors FROM r JOIN orders USING (o_custkey, o_orderkey) WHERE n <= 5 GROUP BY o_custkey"
))
def _(spark, sf):
    rows = v.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("designation"))
    return knowledge.registry_directors(rows, "o_custkey", shortest=6)


@query("registry_company", (
    "SELECT o_custkey, o_orderkey AS pos, status, o_totalprice FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Struck off' ELSE 'Under process' END AS status,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) AS n FROM orders) WHERE n = 1"
))
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Struck off").otherwise("Under process")
    found = v.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), status.alias("status"), "o_totalprice")
    return knowledge.choose_company(found, "o_custkey")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panels put together from event rows: their own value under a label by type."""
    label = F.when(F.col("event_type") == "click", "Number of employees").when(F.col("event_type") == "view", "Industry").when(
        F.col("event_type") == "error", "Revenue (INR)").otherwise("Founder(s)")
    number = F.get_json_object("props", "$.k")
    return v.table(spark, sf, "events").select("event_id", F.to_json(F.struct(
        F.concat(F.lit("Company "), F.col("user_id").cast("string")).alias("Heading"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("About "), F.col("event_type"))).otherwise("").alias("AbstractText"),
        F.struct(F.array(F.struct(F.lit("Website").alias("label"), F.lit("x").alias("value")),
                         F.struct(label.alias("label"), F.concat(number, F.lit(",000 total")).alias("value"))).alias("content")).alias("Infobox"),
        F.array(F.struct(F.concat(F.lit("A topic text about "), F.col("event_type")).alias("Text"))).alias("RelatedTopics"),
    )).alias("panel"))


@query("knowledge_panel", (
    "SELECT event_id, 'Company ' || user_id AS company_name, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN val ELSE '' END AS contact_name,"
    " CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'Founder' ELSE '' END AS owner_role,"
    f" CASE WHEN event_type = 'click' THEN {q.band('(k::BIGINT * 1000)')} ELSE '' END AS employee_count,"
    " CASE WHEN event_type = 'error' THEN val ELSE '' END AS turnover, CASE WHEN event_type = 'view' THEN val ELSE '' END AS industry_type, '' AS address,"
    " CASE WHEN event_id % 2 = 0 THEN 'About ' || event_type WHEN length('A topic text about ' || event_type) > 20 THEN 'A topic text about ' || event_type ELSE '' END AS description"
    " FROM (SELECT *, json_extract_string(props, '$.k') AS k, k || ',000 total' AS val FROM events)"
))
def _(spark, sf):
    return knowledge.knowledge_panel(_panel(spark, sf), "event_id")


@query("claims_facts", (
    "SELECT o_orderkey, 'T' || o_custkey AS company_name, 'Led. Acme is led by Jane Doe Roe since 1990.' AS description, 'Jane Doe Roe' AS contact_name, 'CEO' AS owner_role,"
    f" {q.band('o_custkey')} AS employee_count, CASE WHEN n > 10000000 THEN '₹' || round_even(n / 10000000, 0)::BIGINT || ' Cr' ELSE '' END AS turnover,"
    " CASE WHEN o_orderstatus = 'O' THEN 'Manufacturing' ELSE '' END AS industry_type FROM (SELECT *, floor(o_totalprice)::BIGINT * 100.0 AS n FROM orders)"
))
def _(spark, sf):
    def amount(n):
        return F.array(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("+"), n.cast("string")).alias("amount")).alias("value")).alias("datavalue")).alias("mainsnak")))

    claims = F.struct(
        amount(F.col("o_custkey")).alias("P1128"), amount(F.floor("o_totalprice") * 100).alias("P2139"),
        F.when(F.col("o_orderstatus") == "O", amount(F.lit(1))).alias("P452"))
    own = v.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("title"), F.lit("Q1").alias("entity_id"),
        F.lit("Led. Acme is led by Jane Doe Roe since 1990.").alias("extract"),
        F.to_json(F.struct(F.struct(F.struct(claims.alias("claims")).alias("Q1")).alias("entities"))).alias("claims"))
    return knowledge.claims_facts(own, "o_orderkey")


_PLACE_KINDS = ["store", "real_estate_agency", "point_of_interest", "travel_agency"]


@query("places_records", (
    "SELECT s_suppkey * 10 AS ord, s_name AS company_name, n_name AS address, ['Retail', 'Real Estate', 'Point Of Interest', 'Travel'][(s_suppkey % 4 + 1)::INT] AS industry,"
    " 'google_places' AS source, 'Google Places | Rating: ' || (s_suppkey % 5) AS description, 'Query: ' || n_name AS additional_info FROM supplier JOIN nation ON n_nationkey = s_nationkey"
))
def _(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _PLACE_KINDS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    nation = F.broadcast(v.table(spark, sf, "nation"))
    answers = v.table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("ord"), F.col("n_name").alias("query"), F.to_json(F.struct(
            F.lit("OK").alias("status"), F.array(F.struct(
                F.col("s_name").alias("name"), F.col("n_name").alias("formatted_address"), (F.col("s_suppkey") % 5).alias("rating"),
                F.array(kind, F.lit("other")).alias("types"))).alias("results"))).alias("answer"))
    return knowledge.places_records(answers).select(
        "ord", "company_name", "address", "industry", "source", "description", "additional_info")


def _entity_sql() -> str:
    parts = []
    for kind, pattern in fixed.ENTITY_PATTERNS.items():
        group = 1 if kind in ("ERP", "EMPLOYEES") else 0
        text = "ptxt" if kind in ("ERP", "LEADERSHIP_ROLE", "REVENUE") else "text"
        found = f"list_transform({q.ext_all(text, pattern, group)}, lambda m: {q.sub('m', rf'^{t.SPACE}+|{t.SPACE}+$')})"
        parts.append(f"SELECT DISTINCT doc_id, {q.lit(kind)} AS entity_type, entity FROM (SELECT doc_id, unnest({found}) AS entity FROM d) WHERE entity <> ''")
    return f"WITH d AS (SELECT doc_id, text, {q.plain('text')} AS ptxt FROM documents) " + " UNION ALL ".join(parts)


@query("entity_long", _entity_sql())
def _(spark, sf):
    return pg.entity_long(v.table(spark, sf, "documents"), "doc_id", ["text"])


_LABELS = ["company", "person", "phone", "email", "address", "industry", "revenue", "erp"]


def _label_sql() -> str:
    filled = "tpl"
    for x in _LABELS:
        filled = f"replace({filled}, {q.lit('{' + x.upper() + '}')}, {x})"
    spans = " UNION ALL ".join(
        f"SELECT id, template, text, {q.lit(x.upper())} AS label, strpos(text, {x}) - 1 AS start, strpos(text, {x}) - 1 + length({x}) AS \"end\" FROM f WHERE {x} <> '' AND strpos(text, {x}) > 0"
        for x in _LABELS)
    return (
        "WITH c AS (SELECT c_custkey AS id, c_name AS company, 'Asha Rao' AS person, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '98' || lpad(c_custkey::VARCHAR, 8, '0') END AS phone,"
        " 'info@c' || c_custkey || '.in' AS email, '' AS address, c_mktsegment AS industry, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '₹' || c_custkey || ' Cr' END AS revenue, 'SAP' AS erp FROM customer),"
        f" f AS (SELECT *, {q.squeeze(filled)} AS text FROM c, (SELECT unnest(range(5))::INT AS template, unnest([{q.lits(fixed.LABEL_TEMPLATES)}]) AS tpl))"
        f" {spans}"
    )


@query("label_spans", _label_sql())
def _(spark, sf):
    k = F.col("c_custkey")
    companies = v.spread(v.table(spark, sf, "customer"), rows=True).select(
        k.alias("id"), F.col("c_name").alias("company"), F.lit("CEO - Asha Rao\nCFO - X").alias("person"),
        F.when(k % 2 == 0, "Not publicly disclosed").otherwise(F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0"))).alias("phone"),
        F.concat(F.lit("info@c"), k.cast("string"), F.lit(".in other@x.in")).alias("email"), F.lit("").alias("address"),
        F.col("c_mktsegment").alias("industry"),
        F.when(k % 3 == 0, "Not publicly documented").otherwise(F.concat(F.lit("₹"), k.cast("string"), F.lit(" Cr"))).alias("revenue"),
        F.lit(" SAP ").alias("erp"))
    return pg.label_spans(companies, "id").select("id", "template", "text", F.inline("spans")).select(
        "id", "template", "text", "label", "start", "end")
