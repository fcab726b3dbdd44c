"""Whole runs over pages written in the markup of every source, held by SQL over the same customer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import fixed
from leadloom.plans import runs
from leadloom.schema import RECORD_FIELDS
from leadloom.sources import readers
from registry import queries_cards as cards, sqltext as q
from registry.queries import LOW, query
from registry.queries_records import _fuzzy_sql, _output_sql, _prepared_sql, _scratch, _snake

# names of two made-up words, told apart by more than a number at their end
_LETTERS = "abcdefghijklmnop"
_NAMED_SQL = (
    "(SELECT c_custkey, c_mktsegment, upper(substr(x, 1, 1)) || substr(x, 2, 6) || ' ' || upper(substr(x, 8, 1)) || substr(x, 9, 6) AS c_name"
    f" FROM (SELECT *, translate(md5(c_custkey::VARCHAR), '0123456789abcdef', '{_LETTERS}') AS x FROM customer))")

_LISTING = (
    '<div class="card"><h3><a href="https://www.indiamart.com/shop-{K}/">{NAME}</a></h3><a href="https://d{K}.example.in/">site</a></div>'
    '<span class="phone">98765{P}</span><p class="address">{K} MG Road, Pune</p>' + " " * 500)
_SEEDS = [
    ("indiamart_listing", "0.85", "https://www.indiamart.com/shop-{K}/", dict(note=" | Profile: https://www.indiamart.com/shop-{K}/")),
    ("indiamart_website", "0.8", "https://d{K}.example.in/", dict(website="https://d{K}.example.in/", phone="98765{P}", address="{K} MG Road, Pune")),
    ("duckduckgo", "0.6", "https://c{K}.example.in/", {}),
    ("duckduckgo", "0.6", "https://www.tradeindia.com/s{K}", {}),
]
_PHONE = "('98765' || lpad(c_custkey::VARCHAR, 5, '0'))"
_SOURCES = [s for s in fixed.PLATFORMS if s in readers.SOURCES]
_ASKED = ["discovery", *[s for s in _SOURCES if s not in ("discovery", "website")]]
_VISITED = "https://c{K}.example.in/"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    x = F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", _LETTERS)
    name = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 6), F.lit(" "), F.upper(F.substring(x, 8, 1)), F.substring(x, 9, 6))
    return cards._customers(spark, sf).withColumn("c_name", name)


def _filled(template: str):
    return F.replace(cards._filled(template), F.lit("{P}"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """What was fetched: result pages of all sources, a website that results name, and pages of the directory branch."""
    kinds = [(source, "query {K}", cards._URL, page) for source, page, _ in cards.RECORDS] + [
        ("website", _VISITED, _VISITED, "<p>x{K}</p>"),
        ("directory1", "", "https://dir.indiamart.com/impcat/steel-{K}.html", _LISTING),
        ("directory1", "", "https://dir.indiamart.com/impcat/steel-{K}.html?biz=pune-{K}", "<p>nothing</p>"),
        ("directory_web", "steel {K} Pune {K}", "", cards._RESULTS),
        ("google", "not asked {K}", "", cards._RESULTS)]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(source).alias("source"), _filled(asked).alias("query"), _filled(url).alias("url"),
                              _filled(page).alias("html")) for i, (source, asked, url, page) in enumerate(kinds)])
    return _named(spark, sf).select("c_custkey", F.inline(each)).select(
        (F.col("c_custkey") * len(kinds) + F.col("i")).alias("page_id"), "query", "source", "url", "html")


def _params(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.col("c_custkey") * 2 + n, _filled(k).alias("keyword"), (_filled(p) if p else F.lit(None).cast("string")).alias("location"))
                     for n, (k, p) in enumerate((("query {K}", None), ("steel {K}", "Pune {K}")))])
    return _named(spark, sf).select(F.inline(rows)).toDF("ord", "keyword", "location").withColumn("industry", F.lit(None).cast("string"))


def _raw_sql() -> str:
    """The raw records of the run in their order: seeds, then each query's sources, then its websites."""
    out = []

    def add(ord: str, row: dict) -> None:
        one = cards._expected(RECORD_FIELDS, row, f"{ord} AS ord, ").replace("FROM customer", f"FROM {_NAMED_SQL}")
        out.append(one)

    for i, (source, confidence, url, more) in enumerate(_SEEDS):
        own = {k: v for k, v in more.items() if k != "note"}
        add(f"c_custkey * 10 + {i}", own | dict(country="India", source=source, source_url=url,
                                                additional_info=f"Source: {source} | Confidence: {confidence}{more.get('note', '')}"))
    for n, (source, _, records) in enumerate(cards.RECORDS):
        place = 900 if source == "website" else _ASKED.index(source) * 50 + n
        for i, r in enumerate(records):
            add(f"1000000000 + c_custkey * 10000 + {place * 10 + i}", {"source": source} | r)
    add("1000000000 + c_custkey * 10000 + 8000", dict(
        company_name=_VISITED, website=_VISITED, description="x{K}", source="website", additional_info=f"Website scrape target: {_VISITED}"))
    return "(" + " UNION ALL ".join(out).replace("'98765{P}'", _PHONE) + ")"


_TABLE = _output_sql("(" + _fuzzy_sql("(" + _prepared_sql(_raw_sql(), LOW) + ")") + ")")


@query("bulk_run", (
    f"SELECT *, 'Completed' AS job_status, 100 AS job_progress, count(*) OVER () AS records_found,"
    f" (SELECT 2 * count(*) FROM customer) AS row_count, (SELECT count(*) FROM customer) AS hybrid_jobs, (SELECT {len(_SEEDS)} * count(*) FROM customer)::BIGINT AS n_seeds"
    f" FROM ({_TABLE})"))
def _(spark, sf):
    out = _scratch(spark)
    table = runs.bulk_run(_params(spark, sf), _pages(spark, sf), _SOURCES, out, LOW)
    job = runs.job_rows(spark.range(0), out).first()
    found = spark.read.parquet(f"{out}/discovery").filter("mode = 'hybrid'").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("n_seeds"), F.lit(0)).alias("s")).first()
    lits = dict(job_status=job["status"], job_progress=job["progress"], records_found=job["recordsFound"], row_count=job["rowCount"],
                hybrid_jobs=found["n"], n_seeds=found["s"])
    types = dict(job_progress="int", records_found="long", row_count="long", hybrid_jobs="long", n_seeds="long")
    return _snake(table).withColumns({k: F.lit(v).cast(types.get(k, "string")) for k, v in lits.items()})


@query("directory_seeds", " UNION ALL ".join(
    f"SELECT c_custkey * 2 + 1 AS job, 'hybrid' AS mode, {cards._filled_sql(url)} AS url, '{source}' AS source_name, {confidence}::DOUBLE AS confidence,"
    f" {_PHONE if more.get('phone') else 'NULL'} AS inline_phone FROM customer"
    for source, confidence, url, more in _SEEDS))
def _(spark, sf):
    seeds = runs.directory_seeds(runs.directory_jobs(_params(spark, sf)), _pages(spark, sf))
    return seeds.select("job", "mode", "url", "source_name", "confidence", "inline_phone")
