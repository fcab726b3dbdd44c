"""A whole run: parameters and fetched pages to the stored table, with the run's job row.

Parameters are routed.  Directory rows go through the listing pages of two
directories and a web search to seeds; the others are expanded to queries and
work items, their result pages give records, and the websites found (or
guessed) are visited.  All records go through the lead steps together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import fixed
from leadloom.operators import listing
from leadloom.operators.enrich import Lookups
from leadloom.operators.params import build_queries, candidate_urls, directory_urls, route_queries, website_targets, work_items
from leadloom.operators.records import rejected_records
from leadloom.operators.resolve import dedupe_seeds, discovery_cascade
from leadloom.operators.serve import number_rows, progress_percent
from leadloom.plans.leads import lead_table
from leadloom.schema import RECORD_FIELDS, as_records
from leadloom.session import cut_lineage, spread, unsent
from leadloom.sources.buckets import read_table
from leadloom.sources.readers import records_by_page, seeds_to_records
from leadloom.sources.sinks import read_snapshot, replace_snapshot, upsert_table, write_csv, write_json

#: Seeds a directory job gives at most (fixed value).
DIRECTORY_RESULTS = 50
JOB = ("id string, query string, keyword string, industry string, location string, status string, recordsFound long, "
       "startTime string, progress int, sources array<string>, rowCount long")
_SEED = ["url", "source_name", "confidence", "inline_phone", "inline_email", "inline_address"]


# --- directory branch --------------------------------------------------------

def directory_jobs(params: DataFrame) -> DataFrame:
    """job, industry and city of the parameter rows that ask the directories first."""
    routed = route_queries(params).filter(F.col("route") == "directory")
    return routed.select(F.col("ord").alias("job"), F.col("directory_industry").alias("industry"), F.col("directory_city").alias("city"))


def directory_seeds(jobs: DataFrame, pages: DataFrame, max_results: int = DIRECTORY_RESULTS) -> DataFrame:
    """Seeds of each job (job, place, the seed fields, mode), in order, distinct, at most ``max_results`` a job.

    ``pages`` has page_id, query, source, url and html; listing pages of the
    two directories have the source directory1 or directory2 and the url that
    was asked for, web searches have directory_web and the query "industry
    city".  Of a directory's urls the first that gave any seed counts.
    """
    own = cut_lineage(pages.filter(F.col("source").isin("directory1", "directory2", "directory_web")), "source")

    def fetched(source: str) -> DataFrame:
        return own.filter(F.col("source") == source).select("page_id", "html")

    nothing = {c: F.lit(None).cast("string") for c in ("inline_phone", "inline_email", "inline_address")}
    found = cut_lineage(reduce(DataFrame.unionByName, [
        listing.listing_seeds(fetched("directory1"), ["page_id"]).select("page_id", "ord", *_SEED, F.lit("directory1").alias("source")),
        listing.card_seeds(fetched("directory2")).withColumns(nothing).select("page_id", "ord", *_SEED, F.lit("directory2").alias("source")),
        listing.web_seeds(fetched("directory_web")).withColumns(nothing).select("page_id", "ord", *_SEED, F.lit("web").alias("source")),
    ]))
    yielding = own.select("page_id", "url", "query", F.replace(F.col("source"), F.lit("directory_"), F.lit("")).alias("source")).join(
        unsent(found.select("page_id").distinct()), "page_id", "left_semi")
    asked = directory_urls(jobs, "job", "industry", "city").withColumnRenamed("directory", "source")
    first = asked.join(unsent(yielding.drop("query")), ["url", "source"]).groupBy("job", "source").agg(
        F.min(F.struct("pos", "page_id")).alias("first")).select("job", "source", "first.page_id")
    searched = jobs.select("job", F.concat_ws(" ", "industry", "city").alias("query")).join(
        unsent(yielding.filter(F.col("source") == "web").drop("url")), "query").groupBy("job", "source").agg(F.min("page_id").alias("page_id"))
    rank = F.array_position(F.array(*map(F.lit, ("directory1", "directory2", "web"))), F.col("source"))
    seeds = first.unionByName(searched).join(unsent(found), ["page_id", "source"]).select(
        "job", F.lit(0).alias("city_pos"), "source", F.struct(rank.alias("rank"), "ord").alias("ord"), *_SEED)
    admitted = discovery_cascade(seeds, max_results)
    return dedupe_seeds(admitted, ["job"], max_results).withColumnRenamed("ord", "place")


def directory_records(seeds: DataFrame) -> DataFrame:
    """Raw records of seeds, numbered by job and place."""
    ordered = number_rows(seeds.withColumn("_at", F.struct("job", "place")).drop("place"), [], "_at", "ord")
    return seeds_to_records(ordered)


# --- general branch ----------------------------------------------------------

def website_visits(queries: DataFrame, records: DataFrame) -> DataFrame:
    """query, rank and url of the websites to visit: those that the records of a query name, else addresses guessed from it."""
    named = website_targets(records).select("query", "rank", F.col("website").alias("url"))
    without = queries.select("query").join(unsent(named.select("query").distinct()), "query", "left_anti")
    guessed = candidate_urls(without, "query", "query").select("query", (F.col("pos") + 1).alias("rank"), "url")
    return named.unionByName(guessed.filter(F.col("rank") <= fixed.WEBSITES_PER_QUERY))


def general_records(queries: DataFrame, pages: DataFrame, sources: list[str], profiles: DataFrame | None = None) -> DataFrame:
    """Records of all queries with their place: query, then discovery, the other sources, the websites visited.

    Only pages that a work item asked for count.  ``pages`` of the source
    website are told by their url.
    """
    order = ["discovery", *[p for p in fixed.PLATFORMS if p not in ("discovery", "website")]]
    asked = [s for s in order if s in sources] + [s for s in sources if s not in fixed.PLATFORMS]
    items = work_items(queries, asked).select("query", F.col("platform").alias("source"))
    wanted = cut_lineage(pages.join(unsent(items), ["query", "source"], "left_semi"))
    if asked:
        found = records_by_page(wanted, asked, profiles).join(unsent(wanted.select("page_id", "query").distinct()), "page_id")
    else:
        found = as_records(wanted.limit(0), "page_id").withColumns({"source_pos": F.lit(0), "page_id": F.lit(0).cast("long"), "query": F.lit("")})
    place = F.struct(F.col("q.ord").alias("ord"), F.col("q.pos").alias("pos"), F.col("source_pos"), F.col("place"), F.col("row"))

    def placed(rows: DataFrame) -> DataFrame:
        row = F.xxhash64(*RECORD_FIELDS)
        return rows.withColumn("row", row).join(
            unsent(queries.select("query", F.struct("ord", "pos").alias("q"))), "query").select(
            place.alias("place"), *RECORD_FIELDS)

    parts = [placed(found.withColumn("place", F.col("ord")))]
    if "website" in sources:
        visits = cut_lineage(website_visits(queries, found.withColumn("ord", F.struct("source_pos", "ord"))))
        site = records_by_page(pages.filter(F.col("source") == "website").join(
            unsent(visits.select("url").distinct()), "url", "left_semi"), ["website"])
        parts.append(placed(site.join(unsent(visits), F.col("website") == F.col("url")).withColumns(
            {"source_pos": F.lit(len(asked)), "place": F.col("rank").cast("long")})))
    return reduce(DataFrame.unionByName, parts)


# --- the run -----------------------------------------------------------------

@dataclass
class Job:
    """The job row of a run; every change of state is stored before the run goes on."""

    path: str
    row: dict

    def set(self, df: DataFrame, **state) -> None:
        self.row |= state
        upsert_table(df.sparkSession.createDataFrame([self.row], JOB), self.path, ["id"])


def _job_of(params: DataFrame, job_id: str, started: str, sources: list[str], path: str) -> Job:
    first = params.agg(F.min(F.struct("ord", "keyword", "industry", "location")).alias("f"), F.count("*").alias("n")).first()
    keyword = first["f"]["keyword"] if first["f"] else ""
    label = f"{keyword} (+{first['n'] - 1} more)" if first["n"] > 1 else keyword
    return Job(path, dict(
        id=job_id, query=label, keyword=keyword, industry=(first["f"]["industry"] if first["f"] else "") or "",
        location=(first["f"]["location"] if first["f"] else "") or "", status="Running", recordsFound=0, startTime=started,
        progress=5, sources=list(sources), rowCount=first["n"]))


def items_done(items: DataFrame, pages: DataFrame) -> Column:
    """Progress of the work items: those with a page are through."""
    done = items.join(unsent(pages.select("query", F.col("source").alias("platform")).distinct()), ["query", "platform"], "left_semi")
    total, through = items.count(), done.count()
    return progress_percent(F.lit(through), F.lit(max(total, 1)))


def bulk_run(params: DataFrame, pages: DataFrame, sources: list[str], out: str, threshold: str = fixed.MIN_QUALITY,
             lookups: Lookups | None = None, profiles: DataFrame | None = None, prefix_rule: bool = True,
             job_id: str = "BULK", started: str = "") -> DataFrame:
    """Run all parameters and return the finished table.

    ``params``: ord, keyword, location, industry.  ``pages``: page_id, query,
    source, url and html, what was fetched for the work items, the websites
    and the directories (see ``directory_seeds``).  ``profiles`` (page_id,
    url, html): pages of results that were visited.  Written under ``out``:
    companies (and json, csv), discovery (job, mode, seeds), rejected (records
    below the threshold, by reason) and jobs, whose row goes from Running to
    Completed, or to Failed if a step fails.
    """
    spark = params.sparkSession
    job = _job_of(params, job_id, started, sources, f"{out}/jobs")
    job.set(params)
    try:
        routed = cut_lineage(route_queries(params))
        queries = cut_lineage(build_queries(routed.filter(F.col("route") == "general").select("ord", "keyword", "location", "industry")))
        job.set(params, progress=15)
        seeds = cut_lineage(directory_seeds(directory_jobs(params), pages))
        replace_snapshot(seeds.groupBy("job", "mode").agg(F.count("*").alias("n_seeds")), f"{out}/discovery")
        general = cut_lineage(general_records(queries, pages, sources, profiles))
        percent = items_done(work_items(queries, sources), pages)
        job.set(params, progress=spark.range(1).select(percent.cast("int").alias("p")).first()["p"])
        # directory records stand before all others
        numbered = number_rows(general, [], "place", "ord").select((F.col("ord") + F.lit(1 << 40)).alias("ord"), *RECORD_FIELDS)
        raw = cut_lineage(directory_records(seeds).select("ord", *RECORD_FIELDS).unionByName(numbered))
        raw = spread(raw, rows=True)  # few splits of compact files, and many text rules on every row
        job.set(params, progress=85)
        replace_snapshot(rejected_records(raw, threshold), f"{out}/rejected")
        replace_snapshot(lead_table(raw, threshold, lookups, prefix_rule), f"{out}/companies")
        stored = read_snapshot(spark, f"{out}/companies")
        write_json(stored, f"{out}/json")
        write_csv(stored, f"{out}/csv")
        job.set(params, progress=100, status="Completed", recordsFound=stored.count())
        return stored
    except Exception:
        job.set(params, progress=100, status="Failed")
        raise


def job_rows(params: DataFrame, out: str) -> DataFrame | None:
    """The stored job rows under ``out``."""
    return read_table(params.sparkSession, f"{out}/jobs")
