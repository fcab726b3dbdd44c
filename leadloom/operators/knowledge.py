"""Facts from tables, registries and JSON answers of outside sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.functions import facts, fixed, markup, text as t
from leadloom.schema import record


# --- registries ------------------------------------------------------------

def table_rows(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Rows of html tables: id, row, cells, links."""
    nodes, texts = F.col("nodes"), F.col("texts")
    rows = F.transform(markup.select(nodes, "table tbody tr"), lambda tr: F.struct(
        F.transform(markup.select(markup.inside(nodes, tr), "td"), lambda td: markup.text_of(texts, td, "")).alias("cells"),
        F.transform(markup.select(markup.inside(nodes, tr), "td a[href]", markup.around_and_inside(nodes, tr)), lambda a: a["href"]).alias("links"),
    ))
    found = markup.with_elements(pages.select(id, "html")).select(id, F.posexplode(rows).alias("row", "r"))
    return found.select(id, "row", "r.cells", "r.links")


def choose_company(found: DataFrame, company: str) -> DataFrame:
    """One registry entry per company: the first active one, else the first.

    ``found`` has the company, pos, status and any further columns.
    """
    rest = [c for c in found.columns if c != company]
    active = F.contains(F.lower("status"), F.lit("active"))
    best = found.groupBy(company).agg(F.min_by(F.struct(*rest), F.struct((~active).alias("no"), F.col("pos"))).alias("b"))
    return best.select(company, *[f"b.{c}" for c in rest])


def registry_directors(rows: DataFrame, company: str, shortest: int = 3, limit: int = 5) -> DataFrame:
    """Directors as a fill table: the first one as contact, the first five as a list.

    ``rows`` has the company, pos, name and designation.  Only the leading
    rows of a company are brought together.
    """
    named = rows.filter(F.length(F.trim("name")) >= shortest)
    rank = F.row_number().over(Window.partitionBy(company).orderBy("pos"))
    leading = named.withColumn("_n", rank).filter(F.col("_n") <= limit)
    listed = leading.groupBy(company).agg(
        F.array_sort(F.collect_list(F.struct("_n", "name", "designation"))).alias("d"))
    first = F.get("d", 0)
    return listed.select(
        company, first["name"].alias("contact_name"),
        t.first_filled(first["designation"], F.lit("Director")).alias("owner_role"),
        F.array_join(F.transform("d", lambda x: x["name"]), "; ").alias("additional_directors"),
    )


def directors_in_snippet(df: DataFrame, id: str, text: str) -> DataFrame:
    """People named next to a director's title in a search snippet, in text order."""
    found = F.concat(*[t.extract_all(F.col(text), t.unicode_i(p), 1) for p in fixed.SNIPPET_NAME_PATTERNS])
    names = F.filter(F.transform(found, lambda n: t.py_title(F.trim(n))), lambda n: F.length(n).between(6, 49))
    listed = F.slice(F.array_distinct(names), 1, 5)
    return df.select(id, F.posexplode(listed).alias("pos", "name"))


# --- knowledge panel -------------------------------------------------------

PANEL_SCHEMA = (
    "struct<Heading:string,AbstractText:string,"
    "Infobox:struct<content:array<struct<label:string,value:variant>>>,"
    "RelatedTopics:array<struct<Text:string>>>"
)


def knowledge_panel(df: DataFrame, id: str, panel: str = "panel") -> DataFrame:
    """Label and value lists of knowledge panels as a fill table."""
    parsed = df.select(id, F.from_json(F.col(panel), PANEL_SCHEMA).alias("p"))
    text_items = F.filter(F.coalesce("p.Infobox.content", F.array()), lambda i: F.schema_of_variant(i["value"]) == "STRING")

    def kind(label: Column, value: Column) -> Column:
        def has(*words: str) -> Column:
            return t.contains_any(label, list(words))

        return (
            F.when(has("ceo", "chief executive"), "CEO").when(has("founder"), "Founder").when(has("employee"), "employees")
            .when(has("revenue", "turnover"), "turnover").when(has("industry"), "industry")
            .when(has("headquarters") | F.contains(F.lower(value), F.lit("headquarters")), "address")
        )

    items = F.filter(F.transform(text_items, lambda i: F.struct(
        F.lower(F.coalesce(i["label"], F.lit(""))).alias("label"), i["value"].cast("string").alias("value"))),
        lambda i: i["value"] != "")
    kinds = F.transform(items, lambda i: F.struct(kind(i["label"], i["value"]).alias("kind"), i["value"].alias("value")))
    staged = parsed.select(id, "p", kinds.alias("items"))

    def first(*wanted: str) -> Column:
        return F.get(F.filter("items", lambda i: i["kind"].isin(*wanted)), 0)

    bands = F.transform(
        F.filter("items", lambda i: i["kind"] == "employees"),
        lambda i: facts.band_of(facts.as_count(t.extract(i["value"], "[0-9,]+", 0))))
    topics = F.transform(F.slice(F.coalesce("p.RelatedTopics", F.array()), 1, 3), lambda x: x["Text"])
    topic = F.get(F.filter(topics, lambda x: F.length(x) > 20), 0)
    empty = F.lit("")
    return staged.select(
        id,
        F.coalesce("p.Heading", empty).alias("company_name"),
        F.coalesce(first("CEO", "Founder")["value"], empty).alias("contact_name"),
        F.coalesce(first("CEO", "Founder")["kind"], empty).alias("owner_role"),
        F.coalesce(F.get(F.array_compact(bands), 0), empty).alias("employee_count"),
        F.coalesce(first("turnover")["value"], empty).alias("turnover"),
        F.coalesce(first("industry")["value"], empty).alias("industry_type"),
        F.coalesce(first("address")["value"], empty).alias("address"),
        t.first_filled(F.substring("p.AbstractText", 1, 500), F.substring(topic, 1, 300)).alias("description"),
    )


# --- encyclopedia ----------------------------------------------------------

def choose_title(titles: Column) -> Column:
    """First title that reads like a company, else the first."""
    corporate = F.filter(titles, lambda x: t.contains_any(x, fixed.CORPORATE_TITLE_WORDS))
    return F.coalesce(F.get(corporate, 0), F.get(titles, 0))


def _json_at(json: Column, path: Column) -> Column:
    return F.call_function("get_json_object", json, path)


def claims_facts(df: DataFrame, id: str, entity_id: str = "entity_id", claims: str = "claims", extract: str = "extract",
                 title: str = "title") -> DataFrame:
    """Size, turnover, industry and leader from an entity's claims and the summary text."""
    path = F.concat(F.lit("$.entities."), F.col(entity_id), F.lit(".claims."))

    def amount(claim: str) -> Column:
        value = _json_at(F.col(claims), F.concat(path, F.lit(f"{claim}[0].mainsnak.datavalue.value.amount")))
        return F.regexp_replace(value, r"^\++", "")

    staged = df.select(
        id, F.col(title).alias("title"), F.col(extract).alias("summary"),
        F.when(amount("P1128").rlike("^[0-9]+$"), amount("P1128")).try_cast("bigint").alias("staff"),
        amount("P2139").try_cast("double").alias("money"),
        _json_at(F.col(claims), F.concat(path, F.lit("P452"))).alias("trade"),
    )
    owner = facts.owner_in_summary(F.coalesce("summary", F.lit("")))
    crore = F.bround(F.col("money") / 10000000, 0).cast("bigint").cast("string")
    empty = F.lit("")
    out = staged.withColumn("contact_name", owner)
    return out.select(
        id,
        F.coalesce("title", empty).alias("company_name"),
        F.substring(F.coalesce("summary", empty), 1, 500).alias("description"),
        "contact_name",
        F.when(F.col("contact_name") != "", "CEO").otherwise("").alias("owner_role"),
        F.coalesce(facts.band_of(F.col("staff")), empty).alias("employee_count"),
        F.when(F.col("money") > 10000000, F.concat(F.lit("₹"), crore, F.lit(" Cr"))).otherwise("").alias("turnover"),
        F.when(F.col("trade").isNotNull(), "Manufacturing").otherwise("").alias("industry_type"),
    )


# --- places ----------------------------------------------------------------

PLACE_FIELDS = (
    "place_id:string,name:string,formatted_address:string,formatted_phone_number:string,website:string,"
    "rating:string,types:array<string>,url:string"
)
PLACES_SCHEMA = f"struct<status:string,results:array<struct<{PLACE_FIELDS}>>>"
PLACE_DETAIL_SCHEMA = f"struct<result:struct<{PLACE_FIELDS}>>"


def place_industry(types: Column) -> Column:
    """Label of the first type that contains a known word, else the first type in title case."""
    def label(kind: Column) -> Column:
        ladder = None
        for word, name in fixed.PLACE_TYPE_INDUSTRY.items():
            hit = F.contains(kind, F.lit(word))
            ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
        return ladder

    labels = F.array_compact(F.transform(types, lambda x: label(x)))
    return F.coalesce(F.get(labels, 0), t.py_title(F.replace(F.get(types, 0), F.lit("_"), F.lit(" "))), F.lit(""))


def places_records(answers: DataFrame, details: DataFrame | None = None, answer: str = "answer", query: str = "query",
                   ord: str = "ord") -> DataFrame:
    """Records from places answers, ten per query; details (place_id, detail) override the basics."""
    parsed = answers.select(F.col(ord).alias("_a"), F.col(query).alias("query"), F.from_json(F.col(answer), PLACES_SCHEMA).alias("p"))
    good = parsed.filter(F.col("p.status").isin("OK", "ZERO_RESULTS"))
    basic = good.select("_a", "query", F.posexplode(F.slice("p.results", 1, 10)).alias("pos", "b"))
    if details is None:
        joined = basic.withColumn("d", F.from_json(F.lit(None).cast("string"), PLACE_DETAIL_SCHEMA)["result"])
    else:
        known = details.select("place_id", F.from_json("detail", PLACE_DETAIL_SCHEMA)["result"].alias("d"))
        joined = basic.withColumn("place_id", F.nullif(F.col("b.place_id"), F.lit(""))).join(known, "place_id", "left")

    def c(f: str) -> Column:
        return F.coalesce(F.col(f), F.lit(""))

    detailed = F.col("d").isNotNull()
    types = F.coalesce(F.when(detailed, F.col("d.types")).otherwise(F.col("b.types")), F.array())
    rating = F.when(detailed, c("d.rating")).otherwise(c("b.rating"))
    return joined.select(
        *record(
            ord=F.col("_a") * 10 + F.col("pos"),
            company_name=t.first_filled(c("d.name"), c("b.name")),
            address=t.first_filled(c("d.formatted_address"), c("b.formatted_address")),
            phone=c("d.formatted_phone_number"), website=c("d.website"), industry=place_industry(types),
            source=F.lit("google_places"),
            description=F.when(detailed, F.concat(
                F.lit("Google Places result | Rating: "), rating, F.lit(" | Types: "),
                F.array_join(F.slice(types, 1, 3), ", "))).otherwise(F.concat(F.lit("Google Places | Rating: "), rating)),
            additional_info=F.when(detailed, F.concat(
                F.lit("Google Maps: "), c("d.url"), F.lit(" | Query: "), F.col("query"), F.lit(" | Place ID: "),
                c("b.place_id"))).otherwise(F.concat(F.lit("Query: "), F.col("query"))),
        )
    )


SEARCH_ITEMS_SCHEMA = "struct<items:array<struct<link:string,title:string,snippet:string>>>"


def search_item_records(answers: DataFrame, answer: str = "answer", query: str = "query", ord: str = "ord") -> DataFrame:
    """Records from the items of search answers; contacts come from the snippets."""
    from leadloom.functions import contacts

    items = answers.select(F.col(ord).alias("_a"), F.col(query).alias("query"), F.posexplode(
        F.from_json(F.col(answer), SEARCH_ITEMS_SCHEMA)["items"]).alias("pos", "i"))
    text = F.coalesce("i.snippet", F.lit(""))
    return items.filter(F.col("i.link").startswith("http")).select(
        *record(
            ord=F.col("_a") * 1000 + F.col("pos"), company_name=F.coalesce("i.title", F.lit("")), website=F.col("i.link"),
            description=text, email=contacts.best_email(text), phone=contacts.best_phone(text), source=F.lit("google"),
            additional_info=F.concat(F.lit("Google CSE result for: "), F.col("query")),
        )
    )
