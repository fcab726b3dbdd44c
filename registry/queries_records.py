"""Registered queries over records: cleaning, enrichment, places, duplicates, serving, whole runs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import contacts, facts, fixed, places, text as t
from leadloom.operators import enrich, records as rec, resolve, serve
from leadloom.plans import leads
from leadloom.schema import RECORD_FIELDS
from leadloom.session import checkpoint_dir, cut_lineage
from leadloom.sources import buckets, sinks
from leadloom.streaming import flows
from registry import sqltext as q, views as v
from registry.queries import LOW, _seeds, query

_PAGE = f"({q.page_records()})"
_ENTITY = f"({q.entity_records()})"
_COLS = ", ".join(["ord", *RECORD_FIELDS])


def _with_text(spark: SparkSession, sf: str) -> DataFrame:
    return v.entity_records(spark, sf).withColumn(
        "txt", F.concat_ws(" ", "company_name", "industry", "description", "additional_info", "address"))


_TXT = f"(SELECT *, concat_ws(' ', company_name, industry, description, additional_info, address) AS txt FROM {_ENTITY})"


# --- D: cleaning and scoring -----------------------------------------------

@query("clean_records", f"SELECT {_COLS} FROM ({q.cleaned(_PAGE)})")
def _(spark, sf):
    return rec.clean_records(v.page_records(spark, sf))


@query("clean_entity_records", f"SELECT {_COLS} FROM ({q.cleaned(_ENTITY)})")
def _(spark, sf):
    return rec.clean_records(v.entity_records(spark, sf))


_BASIC = {f: q.sub(q.squeeze(f), r"[\x00-\x1f\x7f-\x{9f}]") for f in RECORD_FIELDS}


_BASIC_SQL = q.replace_fields(f"({q.replace_fields(_ENTITY, _BASIC)})", {
    "email": f"CASE WHEN {q.valid_email('email')} THEN email ELSE '' END",
    "phone": f"CASE WHEN {q.valid_phone('phone')} THEN phone ELSE '' END",
    "website": f"CASE WHEN contains({q.host('website')}, '.') THEN website ELSE '' END",
    "company_name": "CASE WHEN length(trim(company_name)) >= 2"
                    + "".join(f" AND NOT contains(lower(company_name), {q.lit(j)})" for j in fixed.JUNK_NAMES) + " THEN company_name ELSE '' END",
})


@query("clean_records_basic", f"SELECT {_COLS} FROM ({_BASIC_SQL})")
def _(spark, sf):
    return rec.clean_records_basic(v.entity_records(spark, sf))


def _scored(source: str) -> str:
    return f"SELECT ord, company_name, website, ({q.quality()})::DOUBLE AS quality FROM ({q.cleaned(source)})"


@query("quality_score", _scored(_PAGE))
def _(spark, sf):
    scored = rec.quality_score(rec.clean_records(v.page_records(spark, sf)))
    return scored.select("ord", "company_name", "website", F.col("quality").cast("double"))


@query("quality_score_entities", _scored(_ENTITY))
def _(spark, sf):
    scored = rec.quality_score(rec.clean_records(v.entity_records(spark, sf)))
    return scored.select("ord", "company_name", "website", F.col("quality").cast("double"))


@query("quality_filter", f"SELECT ord, company_name, website, email, phone FROM ({q.cleaned(_ENTITY)}) WHERE {q.quality()} >= 5.5")
def _(spark, sf):
    return rec.quality_filter(rec.clean_records(v.entity_records(spark, sf))).select(
        "ord", "company_name", "website", "email", "phone")


def _rejected_sql() -> str:
    watched = ["company_name", "website", "email", "phone", "description", "address"]
    raw = ", ".join(f"trim({f}) AS raw_{f}" for f in watched)
    both = f"SELECT c.*, {', '.join('raw_' + f for f in watched)} FROM ({q.cleaned(_ENTITY)}) c JOIN (SELECT ord, {raw} FROM {_ENTITY}) r USING (ord)"
    parts = [f"SELECT 'invalid {f}' AS reason FROM b WHERE raw_{f} <> '' AND {f} = ''" for f in watched]
    parts.append(f"SELECT 'below threshold' FROM b WHERE {q.quality()} < 5.5")
    return f"WITH b AS ({both}) SELECT reason, count(*) AS n_records FROM ({' UNION ALL '.join(parts)}) GROUP BY reason"


@query("rejected_records", _rejected_sql())
def _(spark, sf):
    return rec.rejection_counts(v.entity_records(spark, sf))


# --- E: normalising --------------------------------------------------------

@query("normalize_records", f"SELECT {_COLS} FROM ({q.normalized(_ENTITY)})")
def _(spark, sf):
    return rec.normalize_records(v.entity_records(spark, sf))


@query("normalize_industry", (
    "SELECT c_mktsegment AS raw, industry, count(*) AS n FROM (SELECT c_mktsegment, " + q.normalize_industry("c_mktsegment")
    + " AS industry FROM customer UNION ALL SELECT p_type, " + q.normalize_industry("p_type") + " FROM part) GROUP BY 1, 2"
))
def _(spark, sf):
    both = v.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("raw")).unionAll(
        v.table(spark, sf, "part").select(F.col("p_type").alias("raw")))
    # few distinct values: count first, normalise the groups
    return both.groupBy("raw").agg(F.count("*").alias("n")).select(
        "raw", rec.normalize_industry_name(F.col("raw")).alias("industry"), "n")


@query("normalize_urls", f"SELECT page_id, url, {q.normalize_url('url')} AS clean_url FROM pages")
def _(spark, sf):
    return v.pages(spark, sf).select("page_id", "url", t.normalize_url(F.col("url")).alias("clean_url"))


def _long_named(spark, sf):
    name = F.concat(F.col("company_name"), F.lit(" of a very long name that goes on and on for ever"))
    return v.entity_records(spark, sf).select(
        "ord", name.alias("company_name"), F.concat(F.lit("© 2020 "), "company_name", F.lit(" Pvt and more")).alias("description"),
        "additional_info")


@query("rename_long_names", (
    "SELECT ord, CASE WHEN length(long) > 60 THEN company_name ELSE long END AS company_name FROM (SELECT ord, company_name,"
    f" company_name || ' of a very long name that goes on and on for ever' AS long FROM {_ENTITY})"
))
def _(spark, sf):
    return rec.rename_long_names(_long_named(spark, sf)).select("ord", "company_name")


# --- F: enrichment ---------------------------------------------------------

@query("enrich_company", f"SELECT {_COLS} FROM ({q.enriched(_ENTITY)})")
def _(spark, sf):
    return enrich.enrich_company(v.entity_records(spark, sf))


@query("infer_industry", f"SELECT doc_id, {q.industry_of('text')} AS industry FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", facts.industry_of_text(F.col("text")).alias("industry"))


@query("employee_band", f"SELECT ord, {q.employee_band('txt')} AS employee_count FROM {_TXT}")
def _(spark, sf):
    return _with_text(spark, sf).select("ord", facts.employee_band(F.col("txt")).alias("employee_count"))


@query("employee_band_of_size", f"SELECT band, count(*) AS n_parts FROM (SELECT {q.band('(p_size * 25)')} AS band FROM part) GROUP BY band")
def _(spark, sf):
    return v.table(spark, sf, "part").groupBy(facts.band_of(F.col("p_size") * 25).alias("band")).agg(F.count("*").alias("n_parts"))


_MONEY = "([('Annual Turnover: Rs. ' || n || ' crore in total'), ('sales ' || n || ' Million'), ('Rs ' || n || ' Cr'), 'nothing'])[(o_orderkey % 4 + 1)::INT]"


@query("turnover", f"SELECT o_orderkey, {q.turnover('txt')} AS turnover FROM (SELECT o_orderkey, {_MONEY} AS txt FROM (SELECT *, floor(o_totalprice)::BIGINT AS n FROM orders))")
def _(spark, sf):
    n = F.floor("o_totalprice").cast("string")
    texts = [F.concat(F.lit("Annual Turnover: Rs. "), n, F.lit(" crore in total")), F.concat(F.lit("sales "), n, F.lit(" Million")),
             F.concat(F.lit("Rs "), n, F.lit(" Cr")), F.lit("nothing")]
    worded = v.table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("txt"))
    return worded.select("o_orderkey", facts.turnover(F.col("txt")).alias("turnover"))


@query("turnover_crore", (
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '₹' || n || ' Cr' WHEN 1 THEN '₹' || printf('%.2f', n / 100) || ' Cr' ELSE 'Rs. ' || n END AS turnover"
    " FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)"
))
def _(spark, sf):
    n, k = F.floor("o_totalprice").cast("string"), F.col("o_orderkey") % 3
    unit = F.when(k == 0, " Crore only").when(k == 1, " Lakh").otherwise("")
    raw = v.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Rs. "), n, unit).alias("raw"))
    return raw.select("o_orderkey", facts.turnover_crore(F.col("raw")).alias("turnover"))


@query("branch_count", f"SELECT ord, {q.branch_count('txt')} AS branch_count FROM {_TXT}")
def _(spark, sf):
    return _with_text(spark, sf).select("ord", facts.branch_count(F.col("txt")).alias("branch_count"))


@query("contact_name", f"SELECT ord, {q.contact_name('txt')} AS contact_name FROM {_TXT}")
def _(spark, sf):
    return _with_text(spark, sf).select("ord", facts.contact_name(F.col("txt")).alias("contact_name"))


@query("detect_erp", f"SELECT doc_id, {q.detect_erp('text')} AS erp FROM documents UNION ALL SELECT -1 - ord, {q.detect_erp('txt')} FROM {_TXT}")
def _(spark, sf):
    worded = _with_text(spark, sf).select((-1 - F.col("ord")).alias("doc_id"), F.col("txt").alias("text"))
    both = v.table(spark, sf, "documents").select("doc_id", "text").unionByName(worded)
    return both.select("doc_id", facts.detect_erp(F.col("text")).alias("erp"))


_JOB_WORDS = ["SAP FI and sap mm lead", "Tally 9 / TallyPrime operator", "Zoho Books, Odoo", "accounts", "Fiori HANA expert", "NetSuite admin"]


def _vote_sql() -> str:
    hits = ", ".join(
        f"{{'rank': {n}, 'erp': {q.lit(name)}, 'hits': "
        + " + ".join(f"((length(up) - length(replace(up, {q.lit(k.upper())}, ''))) // {len(k)})" for k in ks) + "}"
        for n, (name, ks) in enumerate(fixed.ERP_JOB_KEYWORDS))
    return (
        f"WITH w AS (SELECT conv_id, upper(left(text, 40) || ' ' || ([{q.lits(_JOB_WORDS)}])[((conv_id + turn) % 6 + 1)::INT]) AS up FROM conversations),"
        f" h AS (SELECT conv_id, unnest([{hits}]) AS s FROM w), g AS (SELECT conv_id, s.rank AS rank, s.erp AS erp, sum(s.hits)::BIGINT AS score FROM h GROUP BY 1, 2, 3)"
        " SELECT conv_id, erp AS erp_software, score FROM g WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank) = 1"
    ).replace("left(text, 40)", "text")


@query("erp_vote", _vote_sql())
def _(spark, sf):
    word = F.element_at(F.array(*map(F.lit, _JOB_WORDS)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    titles = v.table(spark, sf, "conversations").select("conv_id", F.concat_ws(" ", "text", word).alias("title"))
    return enrich.erp_vote(titles, "conv_id", "title")


@query("enrich_text_only", f"SELECT {_COLS} FROM ({q.enriched_text(_ENTITY)})")
def _(spark, sf):
    return enrich.enrich_text_only(v.entity_records(spark, sf))


def _lookup_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, enrich.Lookups]:
    """Customers as records, with tables made from nations and orders to look their gaps up in."""
    customers = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("company_name"),
        F.when(F.col("c_custkey") % 4 == 0, "Known Person").otherwise("").alias("contact_name"),
        F.when(F.col("c_custkey") % 2 == 0, "₹1 Cr").otherwise("").alias("turnover"),
        F.lit("").alias("employee_count"), F.lit("").alias("industry_type"), F.lit("").alias("description"),
        F.lit("").alias("additional_info"), F.lit("").alias("erp_software"))
    orders = v.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderpriority").alias("p"), F.count("*").alias("n"))
    names = v.table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    key = enrich.lookup_key(F.col("c_name")).alias("name_key")
    directory1 = names.select(key, F.when(F.col("n") > 10, F.col("p")).otherwise("").alias("contact_name"),
                              F.lit("").alias("turnover"), F.lit("from orders").alias("additional_info"))
    panel = v.table(spark, sf, "customer").select(key, F.col("c_mktsegment").alias("industry_type"))
    votes = names.filter(F.col("n") > 12).select(key, F.lit("SAP").alias("erp_software"))
    return customers, enrich.Lookups(directory1=directory1, panel=panel, erp=votes)


@query("enrich_lookup", (
    "SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'Known Person' WHEN n > 10 THEN p ELSE '' END AS contact_name,"
    " CASE WHEN c_custkey % 2 = 0 THEN '₹1 Cr' ELSE '' END AS turnover, c_mktsegment AS industry_type,"
    " CASE WHEN n > 0 AND (c_custkey % 4 <> 0 OR c_custkey % 2 <> 0) THEN 'from orders' ELSE '' END AS additional_info,"
    " CASE WHEN n > 12 THEN 'SAP' ELSE '' END AS erp_software FROM customer LEFT JOIN"
    " (SELECT o_custkey, min(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"
))
def _(spark, sf):
    customers, lookups = _lookup_frames(spark, sf)
    return enrich.enrich_lookup(customers, lookups).select(
        "ord", "contact_name", "turnover", "industry_type", "additional_info", "erp_software")


@query("enrich_lookup_all", (
    "WITH o AS (SELECT o_custkey, min(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1),"
    " a AS (SELECT c_custkey AS k, c_nationkey, c_mktsegment, n_name, coalesce(n, 0) AS n, p,"
    " CASE WHEN c_custkey % 4 = 0 THEN 'Known Person' ELSE '' END AS person, CASE WHEN c_custkey % 2 = 0 THEN '₹1 Cr' ELSE '' END AS money,"
    " CASE WHEN c_custkey % 5 = 0 THEN '11-50' ELSE '' END AS people"
    " FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey),"
    " b AS (SELECT *, CASE WHEN person = '' AND n > 10 THEN p ELSE person END AS person1,"
    " CASE WHEN n > 0 AND (person = '' OR money = '') THEN 'from orders' END AS info1 FROM a),"
    " c AS (SELECT *, k % 3 = 0 AND (person1 = '' OR money = '') AS second FROM b),"
    " d AS (SELECT *, CASE WHEN second AND money = '' THEN '₹5 Cr' ELSE money END AS money2, second AND c_nationkey < 20 AS listed,"
    " CASE WHEN k % 7 = 0 THEN c_mktsegment ELSE '' END AS kind FROM c),"
    " e AS (SELECT *, k % 3 <> 1 AND (person1 = '' OR money2 = '' OR people = '' OR kind = '') AS known FROM d)"
    " SELECT k AS ord, CASE WHEN person1 = '' THEN 'Director ' || n_name ELSE person1 END AS contact_name, money2 AS turnover,"
    " CASE WHEN people = '' AND known THEN '51-200' ELSE people END AS employee_count,"
    " CASE WHEN kind = '' AND known THEN 'Encyclopedia' ELSE kind END AS industry_type,"
    " CASE WHEN listed THEN 'L, B, L, ' || n_name || ', C, ' || n_name ELSE '' END AS address,"
    " CASE WHEN listed THEN 'C' ELSE '' END AS city, CASE WHEN listed THEN n_name ELSE '' END AS state,"
    " concat_ws(' | ', info1, CASE WHEN second THEN 'GSTIN ' || lpad((c_nationkey % 36)::VARCHAR, 2, '0') || 'ABCDE1234F1Z5' END,"
    " CASE WHEN listed THEN 'Business Type: Regular' END) AS additional_info,"
    " CASE WHEN n > 12 THEN 'SAP' ELSE '' END AS erp_software FROM e"
))
def _(spark, sf):
    customers, three = _lookup_frames(spark, sf)
    k, number = F.col("c_custkey"), F.concat(F.lpad((F.col("nk") % 36).cast("string"), 2, "0"), F.lit("ABCDE1234F1Z5"))
    customers = customers.withColumn("employee_count", F.when(F.col("ord") % 5 == 0, "11-50").otherwise("")).withColumns(
        {f: F.lit("") for f in ("address", "city", "state")})
    nations = v.table(spark, sf, "nation").withColumn("nk", F.col("n_nationkey"))
    named = v.table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "name_key", enrich.lookup_key(F.col("c_name")))
    registry = enrich.gst_registry(nations.filter("nk < 20").select(
        number.alias("gstin"), F.lit("").alias("legal_name"), F.lit("").alias("trade_name"), F.lit("B").alias("building"),
        F.lit("L").alias("locality"), F.lit("C").alias("city"), F.lit("").alias("district"), F.col("n_name").alias("state"),
        F.lit("Private").alias("constitution"), F.lit("Regular").alias("business_type")))
    tables = dict(
        three.tables, gst=registry, panel=named.filter(k % 7 == 0).select("name_key", F.col("c_mktsegment").alias("industry_type")),
        directory2=named.filter(k % 3 == 0).select(
            "name_key", F.lit("₹5 Cr").alias("turnover"), F.concat(F.lit("GSTIN "), number).alias("additional_info")),
        encyclopedia=named.filter(k % 3 != 1).select(
            "name_key", F.lit("Encyclopedia").alias("industry_type"), F.lit("51-200").alias("employee_count")),
        directors=named.select("name_key", F.concat(F.lit("Director "), "n_name").alias("contact_name")))
    return enrich.enrich_lookup(customers, enrich.Lookups(**tables)).select(
        "ord", "contact_name", "turnover", "employee_count", "industry_type", "address", "city", "state", "additional_info", "erp_software")


_REG_NO = "lpad((c_nationkey % 36)::VARCHAR, 2, '0') || 'ABCDE1234F1Z5'"


@query("gstin_join", (
    f"SELECT c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN {_REG_NO} ELSE '' END AS gstin,"
    " CASE WHEN c_custkey % 2 = 0 AND n_nationkey < 20 THEN 'L, B, L, ' || n_name || ', C, ' || n_name ELSE '' END AS address,"
    " CASE WHEN c_custkey % 2 = 0 AND n_nationkey < 20 THEN 'C' ELSE '' END AS city, CASE WHEN c_custkey % 2 = 0 AND n_nationkey < 20 THEN n_name ELSE '' END AS state,"
    f" 'note ' || CASE WHEN c_custkey % 2 = 0 THEN {_REG_NO} ELSE 'none' END || CASE WHEN c_custkey % 2 = 0 AND n_nationkey < 20 THEN ' | Business Type: Regular' ELSE '' END AS additional_info"
    " FROM customer JOIN nation ON n_nationkey = c_nationkey"
))
def _(spark, sf):
    number = F.concat(F.lpad((F.col("nk") % 36).cast("string"), 2, "0"), F.lit("ABCDE1234F1Z5"))
    own = v.table(spark, sf, "customer").withColumn("nk", F.col("c_nationkey")).select(
        F.col("c_custkey").alias("ord"), F.lit("").alias("address"), F.lit("").alias("city"), F.lit("").alias("state"),
        F.lit("").alias("description"), F.concat(F.lit("note "), F.when(
            F.col("c_custkey") % 2 == 0, F.lower(number)).otherwise("none")).alias("additional_info"))
    own = own.withColumn("additional_info", F.concat(F.lit("note "), F.upper(F.substring("additional_info", 6, 100))))
    own = own.withColumn("additional_info", F.replace("additional_info", F.lit("NONE"), F.lit("none")))
    registry = enrich.gst_registry(v.table(spark, sf, "nation").withColumn("nk", F.col("n_nationkey")).filter("nk < 20").select(
        number.alias("gstin"), F.lit("").alias("legal_name"), F.lit("").alias("trade_name"), F.lit("B").alias("building"),
        F.lit("L").alias("locality"), F.lit("C").alias("city"), F.lit("").alias("district"), F.col("n_name").alias("state"),
        F.lit("Private").alias("constitution"), F.lit("Regular").alias("business_type")))
    return enrich.gstin_join(own, registry).select("ord", "gstin", "address", "city", "state", "additional_info")


@query("merge_fill", (
    "SELECT c_custkey AS k, c_name AS company_name, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE coalesce(o.p, '') END AS address,"
    " concat_ws(' | ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'base' END, o.st) AS additional_info FROM customer LEFT JOIN"
    " (SELECT o_custkey, min(o_orderpriority) AS p, max(o_orderstatus) AS st FROM orders GROUP BY 1) o ON o_custkey = c_custkey"
))
def _(spark, sf):
    k = F.col("c_custkey")
    base = v.table(spark, sf, "customer").select(
        k.alias("k"), F.col("c_name").alias("company_name"), F.when(k % 2 == 0, "own").otherwise("").alias("address"),
        F.when(k % 3 == 0, "").otherwise("base").alias("additional_info"))
    extra = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("o_orderpriority").alias("address"), F.max("o_orderstatus").alias("additional_info"))
    return enrich.merge_fill(base, extra, "k")


# --- G: places -------------------------------------------------------------

def _parts_sql(parts: dict[str, str], source: str) -> str:
    return "SELECT ord, " + ", ".join(f"{x} AS {k}" for k, x in parts.items()) + f" FROM {source}"


@query("parse_addresses", _parts_sql(q.address_parts("address"), _ENTITY))
def _(spark, sf):
    return v.entity_records(spark, sf).select("ord", places.parse_address(F.col("address")).alias("a")).select("ord", "a.*")


@query("city_from_parts", f"SELECT ord, {q.city_from_parts('address')} AS city FROM {_ENTITY}")
def _(spark, sf):
    return v.entity_records(spark, sf).select("ord", places.city_from_parts(F.col("address")).alias("city"))


@query("full_address", _parts_sql(q.full_address_parts("address"), _ENTITY))
def _(spark, sf):
    return v.entity_records(spark, sf).select("ord", places.full_address(F.col("address")).alias("a")).select("ord", "a.*")


@query("location_from_text", "SELECT doc_id, " + ", ".join(f"{x} AS {k}" for k, x in q.text_location("text").items()) + " FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", places.location_in_text(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("enrich_location", f"SELECT ord, city, state, country, pincode FROM ({q.located(_ENTITY)})")
def _(spark, sf):
    return enrich.enrich_location(v.entity_records(spark, sf)).select("ord", "city", "state", "country", "pincode")


# --- H: duplicates ---------------------------------------------------------

@query("dedupe_exact", f"SELECT n_records, {_COLS} FROM ({q.exact_merged('(' + q.cleaned(_ENTITY) + ')')})")
def _(spark, sf):
    # the records are read more than once by what follows
    return resolve.dedupe_exact(cut_lineage(rec.clean_records(v.entity_records(spark, sf))))


@query("dedupe_exact_pages", f"SELECT n_records, {_COLS} FROM ({q.exact_merged('(' + q.cleaned(_PAGE) + ')')})")
def _(spark, sf):
    # the records are read more than once by what follows
    return resolve.dedupe_exact(cut_lineage(rec.clean_records(v.page_records(spark, sf))))


_CLUSTERED = f"(SELECT *, ord % 50 AS cluster FROM (SELECT * REPLACE (additional_info || ' ' || (ord % 3) AS additional_info) FROM {_ENTITY}))"


@query("merge_cluster", f"SELECT n_records, cluster, {_COLS} FROM ({q.merged(_CLUSTERED, ['cluster'])})")
def _(spark, sf):
    noted = v.entity_records(spark, sf).withColumn(
        "additional_info", F.concat_ws(" ", "additional_info", (F.col("ord") % 3).cast("string")))
    return resolve.merge_cluster(noted.withColumn("cluster", F.col("ord") % 50), ["cluster"])


_SEED_HOST = f"replace(replace({q.host('url')}, 'www.', ''), 'm.', '')"


@query("dedupe_seeds", (
    f"SELECT ord, url FROM (SELECT page_id AS ord, url, {_SEED_HOST} AS d FROM pages) WHERE d <> '' QUALIFY row_number() OVER (PARTITION BY d ORDER BY ord) = 1"
))
def _(spark, sf):
    return resolve.dedupe_seeds(_seeds(spark, sf)).select("ord", "url")


@query("dedupe_listing", (
    f"SELECT ord, url FROM (SELECT page_id AS ord, url, {q.host('url')} || {q.sub(q.path('url'), '/+$')} AS d FROM pages)"
    " QUALIFY row_number() OVER (PARTITION BY d ORDER BY ord) = 1"
))
def _(spark, sf):
    return resolve.dedupe_listing(_seeds(spark, sf)).select("ord", "url")


_CASCADE = (
    "WITH s AS (SELECT event_id AS ord, user_id AS job, (event_id % 7) AS city_pos, CASE event_type WHEN 'click' THEN 'directory1' WHEN 'view' THEN 'directory2' ELSE 'web' END AS source FROM events),"
    " c AS (SELECT job, city_pos, count(*) FILTER (source = 'directory1') AS d1, count(*) FILTER (source = 'directory2') AS d2, count(*) FILTER (source = 'web') AS w FROM s GROUP BY 1, 2),"
    " p AS (SELECT *, coalesce(sum(d1 + d2) OVER (PARTITION BY job ORDER BY city_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d1 < 10 AS second,"
    " row_number() OVER (PARTITION BY job ORDER BY city_pos) AS rank FROM c),"
    " j AS (SELECT job, sum(d1 + CASE WHEN second THEN d2 ELSE 0 END) AS total, sum(CASE WHEN rank <= 5 THEN w ELSE 0 END) AS web FROM p GROUP BY job)"
    " SELECT ord, job, city_pos, source, CASE WHEN total < 30 AND total + web > 0 THEN 'hybrid' ELSE 'directory' END AS mode FROM s JOIN p USING (job, city_pos) JOIN j USING (job)"
    " WHERE source = 'directory1' OR (source = 'directory2' AND second) OR (source = 'web' AND total < 30 AND rank <= 5)"
)


@query("discovery_cascade", _CASCADE)
def _(spark, sf):
    kind = F.when(F.col("event_type") == "click", "directory1").when(F.col("event_type") == "view", "directory2").otherwise("web")
    seeds = v.table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("job"), (F.col("event_id") % 7).alias("city_pos"), kind.alias("source"))
    return resolve.discovery_cascade(seeds, max_results=30)


_NAMED = (
    f"(SELECT page_id AS ord, title AS company_name, {q.norm_key('title')} AS name, {q.norm_key('url')} AS site FROM (SELECT page_id, url, {q.page_title('html')} AS title FROM pages))"
)
_ALLOWED = "levenshtein(a.name, b.name) * 100 <= greatest(length(a.name), length(b.name)) * 15"


def _star_sql(key: str, reason: str, source: str = "r") -> str:
    return (
        f"SELECT centre AS left_id, ord AS right_id, {q.lit(reason)} AS reason, 1.0::DOUBLE AS similarity FROM"
        f" (SELECT ord, min(ord) OVER (PARTITION BY {key}) AS centre FROM {source} WHERE {key} <> '') WHERE ord <> centre"
    )


def _links_sql() -> str:
    like = "round(1.0::DOUBLE - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE, 4)"
    return (
        f"WITH r AS (SELECT * FROM {_NAMED}), n AS (SELECT name, min(ord) AS ord FROM r WHERE name <> '' GROUP BY name),"
        " h AS (SELECT ord, left(name, 4) AS head FROM n WHERE length(name) >= 4), links AS ("
        + _star_sql("site", "website") + " UNION ALL " + _star_sql("name", "name") + " UNION ALL " + _star_sql("head", "name beginning", "h")
        + f" UNION ALL SELECT a.ord, b.ord, 'name part', {like} FROM n a JOIN n b ON length(a.name) < length(b.name) AND contains(b.name, a.name)"
        f" UNION ALL SELECT a.ord, b.ord, 'similar name', {like} FROM n a JOIN n b ON (length(a.name) < length(b.name) OR (length(a.name) = length(b.name) AND a.name < b.name))"
        f" AND left(a.name, 4) <> left(b.name, 4) AND {_ALLOWED})"
    )


def _named_pages(spark: SparkSession, sf: str) -> DataFrame:
    return v.pages(spark, sf).select(
        F.col("page_id").alias("ord"), t.page_title(F.col("html")).alias("company_name"), F.col("url").alias("website"),
        *[F.lit("").alias(f) for f in RECORD_FIELDS if f not in ("company_name", "website")])


@query("similar_pairs", _links_sql() + " SELECT * FROM links")
def _(spark, sf):
    return resolve.similar_pairs(_named_pages(spark, sf))


_COMPONENTS = (
    ", e AS (SELECT left_id AS u, right_id AS v FROM links UNION SELECT right_id, left_id FROM links)"
)


@query("cluster_ids", (
    _links_sql().replace("WITH r AS", "WITH RECURSIVE r AS", 1) + _COMPONENTS
    + ", reach(u, v) AS (SELECT ord, ord FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)"
    " SELECT u AS ord, min(v) AS cluster FROM reach GROUP BY u"
))
def _(spark, sf):
    return resolve.cluster_ids(_named_pages(spark, sf)).select("ord", "cluster")


def _fuzzy_sql(source: str) -> str:
    """Exact merge, links by every rule, components, merge: ``source`` is a parenthesised statement of records."""
    keys = (f"SELECT ord, {q.norm_key('company_name')} AS name, {q.norm_key('website')} AS site, {q.norm_key('email')} AS mail,"
            f" CASE WHEN length({q.digits('phone')}) >= 10 THEN {q.digits('phone')} ELSE '' END AS tel FROM x")
    links = _links_sql().replace(f"SELECT * FROM {_NAMED}", keys, 1).replace(
        "links AS (", "links AS (" + _star_sql("mail", "email") + " UNION ALL " + _star_sql("tel", "phone") + " UNION ALL ", 1)
    links = links.replace("WITH r AS (", f"WITH RECURSIVE x AS MATERIALIZED ({q.exact_merged(source)}), r AS MATERIALIZED (", 1)
    return (
        links + _COMPONENTS + ", reach(u, v) AS (SELECT ord, ord FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),"
        " k AS (SELECT u AS ord, min(v) AS cluster FROM reach GROUP BY u) "
        + q.merged("(SELECT x.* EXCLUDE (n_records), cluster FROM x JOIN k USING (ord))", ["cluster"])
    )


@query("dedupe_fuzzy", "SELECT ord, n_records, company_name, website, email, phone, additional_info FROM (" + _fuzzy_sql("(" + q.cleaned(_ENTITY) + ")") + ")")
def _(spark, sf):
    return resolve.dedupe(rec.clean_records(v.entity_records(spark, sf))).select(
        "ord", "n_records", "company_name", "website", "email", "phone", "additional_info")


@query("ordered_distinct", (
    "SELECT ord, line FROM (SELECT doc_id * 100000 + pos AS ord, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM"
    " (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents))) WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY lower(line) ORDER BY ord) = 1"
))
def _(spark, sf):
    lines = v.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return resolve.ordered_distinct(lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("ord"), "line"), "line")


# --- I: serving ------------------------------------------------------------

@query("kpis", (
    f"SELECT count(*) AS total_companies, count(*) FILTER (erp_software <> '') AS companies_with_erp, (SELECT count(DISTINCT user_id) FROM events) AS total_jobs,"
    " (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'click')) AS active_jobs"
    f" FROM (SELECT ord, {q.first_filled(q.detect_erp('txt'), 'erp_software')} AS erp_software FROM {_TXT})"
))
def _(spark, sf):
    jobs = _job_updates(spark, sf)
    latest = serve.latest_per_key(jobs, "id", ["startTime", "event_id"]).withColumn(
        "status", F.when(F.col("status") == "click", "Running").otherwise("Completed"))
    return serve.kpis(enrich.enrich_company(v.entity_records(spark, sf)), latest)


def _job_updates(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("startTime"), F.col("event_type").alias("status"), "event_id")


@query("count_by_industry", "SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Unknown' ELSE c_mktsegment END AS name, count(*) AS value FROM customer GROUP BY 1")
def _(spark, sf):
    blank = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_mktsegment"))
    return serve.count_by(v.table(spark, sf, "customer").withColumn("industry", blank), "industry")


@query("count_by_country", (
    "SELECT coalesce(n_name, 'Unknown') AS name, count(*) AS value FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey GROUP BY 1"
))
def _(spark, sf):
    nation = F.broadcast(v.table(spark, sf, "nation").filter(F.col("n_regionkey") != 2))
    return serve.count_by(v.table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left"), "n_name")


@query("count_by_erp", f"SELECT CASE WHEN e = '' THEN 'Unspecified' ELSE e END AS name, count(*) AS value FROM (SELECT {q.detect_erp('txt')} AS e FROM {_TXT}) GROUP BY 1")
def _(spark, sf):
    return serve.count_by(enrich.enrich_company(v.entity_records(spark, sf)), "erp_software", "Unspecified")


@query("search_records", "SELECT * FROM part WHERE p_type = 'ECONOMY' AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2')")
def _(spark, sf):
    return serve.search_records(v.table(spark, sf, "part"), "RING Brand#2", {"p_type": "ECONOMY", "p_brand": "all"},
                                ["p_name", "p_brand", "p_type"])


@query("facets", "SELECT p_type AS facet, min(p_partkey) AS first_seen FROM part WHERE p_type <> '' GROUP BY 1")
def _(spark, sf):
    return serve.facets(v.table(spark, sf, "part"), "p_type", "p_partkey")


@query("sort_records", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey")
def _(spark, sf):
    return serve.sort_records(v.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_size", False, "p_partkey")


@query("page_of_records", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 20 OFFSET 60")
def _(spark, sf):
    return serve.page_of_records(v.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), 3, 20, ["p_size", "p_partkey"])


@query("page_after", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 120 ORDER BY p_partkey LIMIT 20")
def _(spark, sf):
    return serve.page_after(v.table(spark, sf, "part").select("p_partkey", "p_name"), 120, 20, "p_partkey")


@query("record_by_id", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 77")
def _(spark, sf):
    return serve.record_by_id(v.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "77", ["p_partkey"])


_LATEST = "SELECT id, status, event_id FROM (SELECT user_id AS id, event_type AS status, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@query("job_history", _LATEST)
def _(spark, sf):
    return serve.job_history(_job_updates(spark, sf), "id", ["startTime", "event_id"]).select("id", "status", "event_id")


@query("job_progress", (
    "SELECT event_id, user_id, steps_done, total_steps, least(15 + floor(steps_done / total_steps * 70)::BIGINT, 84) AS progress FROM (SELECT event_id, user_id,"
    " row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS steps_done, count(*) OVER (PARTITION BY user_id) AS total_steps FROM events)"
))
def _(spark, sf):
    return serve.job_progress(v.table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id").select(
        "event_id", "user_id", "steps_done", "total_steps", "progress")


@query("source_yield", (
    "SELECT event_type AS source, user_id AS query, count(*) AS n_rows, count(*) FILTER (value < 1) AS n_errors,"
    " (CASE WHEN grouping(event_type) = 1 THEN 3 WHEN grouping(user_id) = 1 THEN 1 ELSE 0 END)::INT AS level FROM events GROUP BY ROLLUP (event_type, user_id)"
))
def _(spark, sf):
    return serve.source_yield(v.table(spark, sf, "events"), "event_type", "user_id", F.col("value") < 1)


@query("serial_number", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS serial FROM orders")
def _(spark, sf):
    return serve.serial_number(v.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


# --- J: projection and sinks ----------------------------------------------

def _snake(df: DataFrame) -> DataFrame:
    """Output names without spaces and dots, for the check."""
    return df.toDF(*[_plain_name(c) for c in df.columns])


def _plain_name(c: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in c).lower()


def _output_sql(source: str) -> str:
    listed = ", ".join(f'"{c}" AS {_plain_name(c)}' for c in sinks.OUTPUT_NAMES)
    return f"SELECT {listed} FROM ({q.output_columns(source)})"


@query("to_output_schema", _output_sql(_ENTITY))
def _(spark, sf):
    return _snake(sinks.to_output_schema(v.entity_records(spark, sf)))


def _scratch(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


@query("upsert_by_key", (
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"
    " UNION ALL SELECT o_orderkey, 'Y', o_totalprice + 2 FROM orders WHERE o_orderkey % 5 = 0"
))
def _(spark, sf):
    base = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    # every new key comes twice: the later state is the one that stays
    states = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in ((2, "Y"), (1, "X"))]))
    new = base.filter("o_orderkey % 5 = 0").withColumn("state", states).select(
        "o_orderkey", F.col("state.s").alias("o_orderstatus"), (F.col("o_totalprice") + F.col("state.n")).alias("o_totalprice"))
    return sinks.upsert_by_key(base, new, ["o_orderkey"], ["o_totalprice"])


@query("write_json", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    path = _scratch(spark)
    own = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sinks.write_json(own, path)
    return spark.read.schema(own.schema).json(path)


@query("write_csv", _output_sql(_ENTITY))
def _(spark, sf):
    path = _scratch(spark)
    sinks.write_csv(sinks.to_output_schema(v.entity_records(spark, sf)), path)
    return _snake(sinks.read_csv(spark, path))


@query("append_table", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    path = _scratch(spark)
    sinks.append_table(v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name")), path)
    sinks.append_table(v.table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name")), path)
    return spark.read.parquet(path)


@query("replace_snapshot", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _(spark, sf):
    path = _scratch(spark)
    own = v.table(spark, sf, "customer").select("c_custkey", "c_name")
    sinks.replace_snapshot(own, path)
    sinks.replace_snapshot(sinks.read_snapshot(spark, path).withColumn("c_name", F.upper("c_name")), path)
    return sinks.read_snapshot(spark, path)


@query("upsert_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"
       " UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, sf):
    path = _scratch(spark)
    base = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.upsert_table(base, path, ["o_orderkey"], batch=0)
    changed = base.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    for _again in range(2):  # the second time it is a batch that the table has
        sinks.upsert_table(changed, path, ["o_orderkey"], batch=1)
    return buckets.read_table(spark, path)


@query("clear_jobs", "SELECT user_id AS id, event_type AS status FROM events WHERE false")
def _(spark, sf):
    path = _scratch(spark)
    buckets.replace_table(_job_updates(spark, sf).select("id", "status"), path, ["id"])
    return sinks.clear_jobs(spark, path)


@query("export_manifest", "SELECT count(*) AS records, true AS has_bytes FROM customer")
def _(spark, sf):
    manifest = sinks.export_manifest(v.table(spark, sf, "customer"))
    return manifest.agg(F.sum("records").alias("records"), (F.min("bytes") > 0).alias("has_bytes"))


# --- K: whole runs ---------------------------------------------------------

def _prepared_sql(source: str, threshold: str) -> str:
    good = f"(SELECT * FROM ({q.cleaned(source)}) WHERE {q.quality()} >= {threshold})"
    return q.located(f"({q.enriched_text(f'({q.enriched(f'({q.normalized(good)})')})')})")


@query("prepared_records", f"SELECT {_COLS} FROM ({_prepared_sql(_ENTITY, '5.5')})")
def _(spark, sf):
    return leads.prepared(v.entity_records(spark, sf))


@query("lead_table_exact", _output_sql("(" + q.exact_merged("(" + _prepared_sql(_ENTITY, "5.5") + ")") + ")"))
def _(spark, sf):
    return _snake(leads.lead_table_exact(v.entity_records(spark, sf)))


@query("lead_table", _output_sql("(" + _fuzzy_sql("(" + _prepared_sql(_ENTITY, "5.5") + ")") + ")"))
def _(spark, sf):
    return _snake(leads.lead_table(v.entity_records(spark, sf)))


@query("lead_table_pages", _output_sql("(" + _fuzzy_sql("(" + _prepared_sql(_PAGE, LOW) + ")") + ")"))
def _(spark, sf):
    return _snake(leads.lead_table(v.page_records(spark, sf), LOW))


@query("lead_table_external")
def _(spark, sf):
    _, lookups = _lookup_frames(spark, sf)
    return _snake(leads.lead_table(v.entity_records(spark, sf), lookups=lookups))


@query("lead_table_basic", _output_sql("(" + _fuzzy_sql(
    "(" + q.located(f"({q.enriched(f'({q.normalized(f"({_BASIC_SQL})")})')})") + ")") + ")"))
def _(spark, sf):
    return _snake(leads.lead_table_basic(v.entity_records(spark, sf)))


# --- L: streams ------------------------------------------------------------

@query("stream_job_state", _LATEST)
def _(spark, sf):
    schema = v.table(spark, sf, "events").schema
    path = _scratch(spark)
    updates = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        F.col("user_id").alias("id"), F.col("ts"), F.col("event_type").alias("status"), "event_id")
    flows.stream_job_state(updates, "id", ["ts", "event_id"], f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return buckets.read_table(spark, f"{path}/table").select("id", "status", "event_id")


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(spark, sf):
    schema = v.table(spark, sf, "events").schema
    path = _scratch(spark)
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kept = flows.stream_dedupe(arriving.select("user_id", "event_type", F.col("ts").cast("timestamp")), "ts", ["user_id", "event_type"], "400 days")
    kept.writeStream.format("parquet").option("path", f"{path}/table").option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_uploads", f"SELECT {_COLS} FROM ({q.exact_merged('(' + _prepared_sql(_ENTITY, '5.5') + ')')})")
def _(spark, sf):
    path = _scratch(spark)
    v.entity_records(spark, sf).write.json(f"{path}/in")
    arriving = flows.record_stream(spark, f"{path}/in", "json")
    flows.stream_uploads(arriving, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return buckets.read_table(spark, f"{path}/table").select("ord", *RECORD_FIELDS)
