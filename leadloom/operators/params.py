"""Search parameters: expansion to queries, routing, work lists and target URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from leadloom.functions import fixed, text as t


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def params_from_table(df: DataFrame, ord: str = "ord", drop_nan: bool = False) -> DataFrame:
    """keyword, location and industry from whatever columns a table of parameters has.

    The first non-empty of the known column names wins; rows without a
    keyword are dropped.  ``drop_nan`` treats the text "nan" as empty.
    """
    def pick(names: list[str]) -> Column:
        values = [F.trim(_quoted(n).cast("string")) for n in names if n in df.columns]
        if drop_nan:
            values = [F.when(F.lower(v) != "nan", v).otherwise("") for v in values]
        return t.first_filled(*values) if values else F.lit("")

    def optional(names: list[str]) -> Column:
        return t.some(pick(names))

    return df.select(
        F.col(ord).alias("ord"), pick(fixed.KEYWORD_COLUMNS).alias("keyword"),
        optional(fixed.LOCATION_COLUMNS).alias("location"), optional(fixed.INDUSTRY_COLUMNS).alias("industry"),
    ).filter(F.col("keyword") != "")


def build_queries(params: DataFrame, strict: bool = True) -> DataFrame:
    """Query variants of every parameter row, first occurrence kept, with (ord, pos) as their place.

    ``strict`` drops every query that contains "nan" or "none" anywhere.
    """
    base = F.trim(F.col("keyword"))
    place, trade = F.nullif("location", F.lit("")), F.nullif("industry", F.lit(""))
    erp = t.contains_any(F.lower(base), fixed.ERP_TRIGGERS)
    variants = F.transform(F.array(*map(F.lit, fixed.ERP_VARIANTS)), lambda v: F.when(
        F.col("place").isNull(), v).otherwise(F.concat(v, F.lit(" "), F.col("place"))))
    plain = F.array(F.concat("base", F.lit(" "), "place"), F.concat("base", F.lit(" "), "trade"))
    expanded = params.select("ord", base.alias("base"), place.alias("place"), trade.alias("trade"), erp.alias("erp"))
    expanded = expanded.filter(F.col("base") != "").withColumn(
        "queries", F.concat(F.array("base"), F.when(F.col("erp"), variants).otherwise(plain)))
    listed = expanded.select("ord", F.posexplode("queries").alias("pos", "query")).filter(F.coalesce("query", F.lit("")) != "")
    if strict:
        listed = listed.filter(~F.lower("query").rlike("nan|none"))
    first = listed.groupBy("query").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.select("at.ord", "at.pos", "query")


def parse_requests(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """Keyword and location of requests in plain words."""
    asked = F.trim(F.regexp_replace(t.squeeze(F.col(text)), fixed.REQUEST_VERBS, ""))
    where = df.select(id, asked.alias("_q")).withColumn("_hit", t.extract(F.col("_q"), fixed.REQUEST_LOCATION, 0))
    at = F.instr("_q", F.col("_hit"))
    rest = F.concat_ws(" ", F.substring(F.col("_q"), F.lit(1), at - 1),
                       F.substring(F.col("_q"), at + F.length("_hit"), F.length("_q")))
    return where.select(
        id,
        t.squeeze(F.when(F.col("_hit") != "", rest).otherwise(F.col("_q"))).alias("keyword"),
        F.rtrim(F.trim(t.extract(F.col("_q"), fixed.REQUEST_LOCATION)), F.lit(".,")).alias("location"),
        F.lit("").alias("industry"),
    )


def split_city(df: DataFrame, query: str = "query") -> DataFrame:
    """Add keyword and city: the longest known city inside the query is taken out of it."""
    cities = sorted(dict.fromkeys(fixed.QUERY_CITIES), key=lambda c: -len(c))
    low = F.lower(F.col(query))
    found = F.get(F.filter(F.array(*map(F.lit, cities)), lambda c: F.contains(low, c)), 0)
    staged = df.withColumn("_city", found)
    rest = F.trim(F.replace(low, F.col("_city"), F.lit("")), F.lit(" ,"))
    return staged.select(
        *df.columns,
        F.when(F.col("_city").isNull(), F.col(query)).otherwise(t.first_filled(rest, F.col(query))).alias("keyword"),
        F.coalesce("_city", F.lit("")).alias("city"),
    ).drop("_city")


def route_queries(params: DataFrame) -> DataFrame:
    """Add the route (directory or general) and, for directory rows, the industry and city to ask for."""
    place = F.lower(F.coalesce("location", F.lit("")))
    trade = t.first_filled(F.col("keyword"), F.col("industry"))
    directory = t.contains_any(place, fixed.DIRECTORY_CITIES) & t.contains_any(F.lower(trade), fixed.DIRECTORY_INDUSTRIES)
    return params.withColumn("route", F.when(directory, "directory").otherwise("general")).withColumns({
        "directory_industry": F.when(F.col("route") == "directory", trade).otherwise(""),
        "directory_city": F.when(F.col("route") == "directory", t.first_filled(
            F.col("location"), F.lit(fixed.DEFAULT_DIRECTORY_CITY))).otherwise(""),
    })


def platform_table(spark: SparkSession, enabled: list[str] | None = None) -> DataFrame:
    """The fixed platforms in their order, with their toggles (a dozen rows)."""
    chosen = set(fixed.PLATFORMS if enabled is None else enabled)
    rows = [(n, p, p in chosen) for n, p in enumerate(fixed.PLATFORMS)]
    return spark.createDataFrame(rows, "platform_pos int, platform string, enabled boolean")


def request_sources(sources: list[str]) -> list[str]:
    """Known sources of a request, or the default list when none is known."""
    return [s for s in sources if s in fixed.PLATFORMS] or list(fixed.DEFAULT_SOURCES)


def work_items(queries: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Every query on every enabled platform; phase 0 discovers, 1 asks the others, 2 visits websites.

    The platform list is exploded from a literal: there is nothing to join.
    """
    chosen = set(fixed.PLATFORMS if enabled is None else enabled)
    listed = F.array(*[
        F.struct(F.lit(n).alias("platform_pos"), F.lit(p).alias("platform"),
                 F.lit({"discovery": 0, "website": 2}.get(p, 1)).alias("phase"))
        for n, p in enumerate(fixed.PLATFORMS) if p in chosen
    ])
    if not chosen & set(fixed.PLATFORMS):
        listed = listed.cast("array<struct<platform_pos:int,platform:string,phase:int>>")
    return queries.select("*", F.inline(listed))


def website_targets(records: DataFrame, query: str = "query", limit: int = fixed.WEBSITES_PER_QUERY) -> DataFrame:
    """Distinct websites per query in order of appearance, the first ten of each query."""
    site = F.trim(F.col("website"))
    usable = records.filter(site.rlike("^https?://")).select(F.col(query), F.col("ord"), site.alias("website"))
    unique = usable.groupBy(query, "website").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("ord", "website"))
    return unique.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _plain_words(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, rf"[^\p{{L}}\p{{N}}_{t.SPACE_CHARS}]", " "))


def guessed_urls(query: Column) -> Column:
    """Five addresses a company of this name may have."""
    flat = F.lower(F.replace(_plain_words(query), F.lit(" "), F.lit("")))
    return F.array_distinct(F.transform(
        F.array(*map(F.lit, fixed.GUESS_TLDS)), lambda tld: F.concat(F.lit("https://www."), flat, tld)))


def urls_in_query(query: Column) -> Column:
    """Up to five URLs written in the query itself, else guesses from its words."""
    written = F.transform(
        F.slice(t.extract_all(query, r"https?://[^\s<>\"{}|\\^`\[\]]+"), 1, 5), lambda u: F.rtrim(u, F.lit(".,;:")))
    words = _plain_words(query)
    flat, dashed = F.replace(words, F.lit(" "), F.lit("")), F.lower(F.replace(words, F.lit(" "), F.lit("-")))
    guesses = F.array_distinct(F.array(*[
        F.concat(F.lit(start), name, F.lit(".com"))
        for name in (flat, dashed) for start in ("https://", "https://www.")
    ]))
    return t.bind(written, lambda w: F.when(F.size(w) > 0, w).otherwise(guesses))


def candidate_urls(df: DataFrame, id: str, query: str, written: bool = False) -> DataFrame:
    urls = urls_in_query(F.col(query)) if written else guessed_urls(F.col(query))
    return df.select(id, F.posexplode(urls).alias("pos", "url"))


def directory_urls(df: DataFrame, id: str, industry: str, city: str) -> DataFrame:
    """Listing URLs of both directories in the order they are tried."""
    trade, place = F.col(industry), F.col(city)
    staged = df.select(id, trade.alias("i"), place.alias("c"), t.slugify(trade).alias("i_slug"), t.slugify(place).alias("c_slug"))
    i, c, i_slug, c_slug = (F.col(x) for x in ("i", "c", "i_slug", "c_slug"))
    title = t.py_title(c_slug)
    first = "https://dir.indiamart.com"
    second = "https://www.justdial.com/"

    def entry(directory: str, pos: int, *parts: Column | str) -> Column:
        url = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.struct(F.lit(directory).alias("directory"), F.lit(pos).alias("pos"), url.alias("url"))

    urls = F.array(
        entry("directory1", 0, f"{first}/search.mp?ss=", F.url_encode(i), "&city=", F.url_encode(c), "&prdc=on"),
        entry("directory1", 1, "https://www.indiamart.com/search?q=", F.url_encode(i)),
        entry("directory1", 2, "https://m.indiamart.com/search?q=", F.url_encode(i)),
        entry("directory1", 3, f"{first}/impcat/", i_slug, ".html?biz=", c_slug),
        entry("directory1", 4, f"{first}/impcat/", i_slug, ".html"),
        entry("directory2", 0, second, title, "/", i_slug, "-in-", c_slug),
        entry("directory2", 1, second, title, "/", F.replace(i, F.lit(" "), F.lit("-")), "-in-", title),
        entry("directory2", 2, second, title, "/", i_slug, "-in-", c_slug, "/nct-10462188"),
        entry("directory2", 3, second, title, "/", i_slug),
    )
    return staged.select(id, F.inline(urls))


def first_yielding(urls: DataFrame, rows: DataFrame, id: str) -> DataFrame:
    """Rows of the first URL, per id and directory, that gave any; ``rows`` has a url column."""
    yielding = urls.join(rows.select("url").distinct(), "url", "left_semi")
    first = yielding.groupBy(id, "directory").agg(F.min_by("url", "pos").alias("url"))
    return first.join(rows, "url")


def top_n_per_source(df: DataFrame, query: str, source: str, order: list[str], caps: dict[str, int] | None = None,
                     default_cap: int = 10) -> DataFrame:
    """The first rows of every query and source, as many as the source delivers per query.

    The rank filter is pushed below the shuffle: every task keeps at most the
    largest cap of rows per group before anything moves.
    """
    caps = fixed.SOURCE_CAPS if caps is None else caps
    cap = F.lit(default_cap)
    for name, n in caps.items():
        cap = F.when(F.col(source) == name, n).otherwise(cap)
    rank = F.row_number().over(Window.partitionBy(query, source).orderBy(*order))
    largest = max([default_cap, *caps.values()])
    return df.withColumn("rank", rank).filter(F.col("rank") <= largest).filter(F.col("rank") <= cap)


