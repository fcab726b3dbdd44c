"""Sources, sinks, whole runs, streams and plans."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom.functions import fixed
from leadloom.operators import enrich, records as rec, resolve, serve
from leadloom.plans import leads, runs
from leadloom.schema import RECORD_FIELDS, as_records
from leadloom.sources import buckets, readers, sinks
from leadloom.streaming import flows
from registry import views

SF = "/root/testdata/sf0.001"
FIVE = [  # the usual trouble: suspicious host, spaced phone, no scheme, missing site, test name, throw-away mail, short phone
    dict(company_name="Acme Pumps Private Limited", website="www.acmepumps.in", phone="+91 98765 12345", email="info@acmepumps.in",
         address="12 MG Road, Bengaluru, Karnataka 560001", industry="manufacturing services",
         description="Manufacturer of industrial pumps with over 250 employees since long, runs SAP."),
    dict(company_name="Acme Pumps Pvt Ltd", website="https://acmepumps.in", phone="91-98765-12345", email="sales@acmepumps.in",
         address="12 MG Road, Bengaluru", industry="manufacturing services",
         description="Pumps and valves for all kinds of industrial use across India."),
    dict(company_name="Test Company", website="", phone="123", email="x@yopmail.com"),
    dict(company_name="", website="http://blank.in", phone="", email="a@example.com"),
]


def five(spark):
    return as_records(spark.createDataFrame(
        [(i, *[r.get(f, "") for f in RECORD_FIELDS]) for i, r in enumerate(FIVE)],
        "ord long, " + ", ".join(f"{f} string" for f in RECORD_FIELDS)))


def test_lead_table(spark):
    rows = leads.lead_table(five(spark)).collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert list(row) == sinks.OUTPUT_NAMES and row["SL No."] == "1"
    assert row["Company Name"] == "Acme Pumps Private Limited" and row["Phone Number"] == "+919876512345"
    assert (row["City"], row["State"], row["Country"]) == ("Bengaluru", "Karnataka", "India")
    assert row["Employee_No"] == "201-500" and row["Current_Use_ERP_Software_Name"] == "SAP"


def test_rejections(spark):
    got = {r["reason"]: r["n_records"] for r in rec.rejection_counts(five(spark)).collect()}
    assert got["below threshold"] == 2 and got["invalid email"] == 2 and got["invalid phone"] == 1


def test_params_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿keyword,location,industry\nsteel,"Pune, India",\n,x,y\nnan,,\n', encoding="utf-8")
    rows = readers.read_params(spark, str(tmp_path / "p.csv")).orderBy("ord").collect()
    assert [(r["keyword"], r["location"], r["industry"]) for r in rows] == [("steel", "Pune, India", None), ("nan", None, None)]
    assert readers.read_params(spark, str(tmp_path / "p.csv"), drop_nan=True).count() == 1
    (tmp_path / "p.json").write_text(json.dumps([{"Company Name": "Acme", "Address": "Pune"}, {"website": "x.in"}, {"location": "a"}]))
    rows = readers.read_params(spark, str(tmp_path / "p.json"), "json").orderBy("ord").collect()
    assert [(r["keyword"], r["location"]) for r in rows] == [("Acme", "Pune"), ("x.in", None)]


def test_results_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"Company Name": "A"}, {"Company Name": "B", "id": "x9"}]))
    rows = {r["Company Name"]: (r["id"], r["SL No."]) for r in readers.load_results(spark, str(tmp_path / "r.json")).collect()}
    assert rows == {"A": ("1", "1"), "B": ("x9", "2")}


def test_sinks_read_back(spark, tmp_path):
    table = sinks.to_output_schema(five(spark).withColumn("description", F.lit('say "hi",\nnext é')))
    sinks.write_csv(table, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    sinks.write_json(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    path = str(tmp_path / "jobs")
    jobs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    sinks.upsert_table(jobs, path, ["id"])
    sinks.upsert_table(spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"), path, ["id"])
    assert sorted(map(tuple, buckets.read_table(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    sinks.replace_snapshot(jobs, str(tmp_path / "served"))
    sinks.replace_snapshot(sinks.read_snapshot(spark, str(tmp_path / "served")).filter("n = 2"), str(tmp_path / "served"))
    assert list(map(tuple, sinks.read_snapshot(spark, str(tmp_path / "served")).collect())) == [("b", 2)]


def test_serial_numbers_with_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 10**12, 7, 10**12 + 1)], "ord long")
    got = [(r["ord"], r["serial"]) for r in serve.serial_number(df).orderBy("ord").collect()]
    assert got == [(1, 1), (5, 2), (7, 3), (10**12, 4), (10**12 + 1, 5)]


def test_bulk_run(spark, tmp_path):
    params = spark.createDataFrame([(1, "pumps", "Pune", None)], "ord int, keyword string, location string, industry string")
    html = (
        "<html><head><meta name='description' content='Maker of industrial steel pumps in Pune with 250 employees'></head><body>"
        "Acme Pumps Private Limited\nsales@acmepumps.in +91 98765 12345<address>12 MG Road, Pune, Maharashtra 411001</address></body></html>")
    pages = spark.createDataFrame(
        [(1, "pumps Pune", "website", "https://acmepumps.in", html), (2, "other", "website", "https://x.in", html)],
        "page_id long, query string, source string, url string, html string")
    # no result names a site: the addresses guessed from the query are visited
    guessed = pages.withColumn("url", F.when(F.col("page_id") == 1, "https://www.pumpspune.com").otherwise(F.col("url")))
    out = str(tmp_path / "out")
    rows = runs.bulk_run(params, guessed, ["website"], out, job_id="B1", started="2024-01-01").collect()
    assert len(rows) == 1 and rows[0]["EMail Address"] == "sales@acmepumps.in"
    assert spark.read.json(f"{out}/json").count() == 1
    # a later run with results that name the site; its job has a row of its own
    found = "<li class='b_algo'><h2><a href='https://acmepumps.in'>Acme Pumps</a></h2><p>pumps</p></li>"
    more = pages.unionByName(spark.createDataFrame([(3, "pumps Pune", "discovery", "u", found)], pages.schema))
    again = runs.bulk_run(params, more, ["discovery", "website"], out, job_id="B2", started="2024-01-02").collect()
    assert [(r["Website"], r["EMail Address"]) for r in again] == [("https://acmepumps.in", "sales@acmepumps.in")]
    jobs = {r["id"]: r for r in runs.job_rows(params, out).collect()}
    assert {k: (r["status"], r["progress"], r["recordsFound"], r["query"], r["rowCount"]) for k, r in jobs.items()} == {
        k: ("Completed", 100, 1, "pumps", 1) for k in ("B1", "B2")}
    assert spark.read.parquet(f"{out}/rejected").columns[-1] == "reasons"


def test_records_of_a_run_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    params = spark.createDataFrame([(1, "pumps", "Pune", None)], "ord int, keyword string, location string, industry string")
    pages = spark.createDataFrame(
        [(1, "pumps Pune", "website", "https://www.pumpspune.com", "<p>Acme Pumps</p>")], "page_id long, query string, source string, url string, html string")
    splits = []

    def stop(raw, *rest):
        splits.append(raw.rdd.getNumPartitions())
        raise RuntimeError("far enough")

    monkeypatch.setattr(runs, "rejected_records", stop)
    with pytest.raises(RuntimeError, match="far enough"):
        runs.bulk_run(params, pages, ["website"], str(tmp_path))
    assert splits[0] >= 4 * spark.sparkContext.defaultParallelism


def test_no_side_of_a_run_that_grows_is_sent_to_all(spark, monkeypatch):
    params = spark.createDataFrame([(1, "pumps", "Pune", None), (2, "steel", "Pune", "steel")], "ord int, keyword string, location string, industry string")
    pages = spark.createDataFrame(
        [(1, "pumps Pune", "website", "https://www.pumpspune.com", "<p>Acme Pumps</p>")], "page_id long, query string, source string, url string, html string")
    plans, write = [], runs.cut_lineage

    def seen(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *by)

    for module in (runs, resolve):
        monkeypatch.setattr(module, "cut_lineage", seen)
    queries = runs.build_queries(params)
    seeds = runs.directory_seeds(runs.directory_jobs(params), pages)
    general = runs.general_records(queries, pages, ["discovery", "website"])
    clusters = resolve.cluster_ids(spark.createDataFrame([(1, 2)], "id long, other long").select(
        "id", *[F.lit("x").alias(f) for f in ("website", "email", "phone", "company_name")]), "id")
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (seeds, general)]
    plans.append(clusters._jdf.queryExecution().optimizedPlan().toString())
    assert "SortMergeJoin" in "".join(plans) and "rightHint=(strategy=merge)" in plans[-1]
    grown = ("query#", "url#", "page_id#", "job#", "u#")
    for plan in plans[:-1]:
        for line in plan.splitlines():
            assert "BroadcastHashJoin" not in line or not any(f"[{key}" in line for key in grown), line
    done = []
    monkeypatch.setattr(type(params), "count", lambda df: done.append(df._jdf.queryExecution().executedPlan().toString()) or 1)
    runs.items_done(runs.work_items(queries, ["discovery", "website"]), pages)
    assert "SortMergeJoin" in done[1] and "BroadcastHashJoin" not in done[1]


def test_a_run_that_fails_says_so(spark, tmp_path):
    params = spark.createDataFrame([(1, "steel", "Pune", None)], "ord int, keyword string, location string, industry string")
    pages = spark.createDataFrame([], "page_id long, query string, source string, url string, html string")
    with pytest.raises(Exception):
        runs.bulk_run(params, pages, ["website"], str(tmp_path), threshold="much")
    job = runs.job_rows(params, str(tmp_path)).first()
    assert (job["status"], job["progress"], job["recordsFound"]) == ("Failed", 100, 0)


def test_stream_equals_batch(spark, tmp_path):
    own = views.entity_records(spark, SF)
    own.write.json(str(tmp_path / "in"))
    stream = flows.record_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    flows.stream_uploads(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = buckets.read_table(spark, str(tmp_path / "t"))
    from leadloom.operators.resolve import dedupe_exact

    wanted = dedupe_exact(leads.prepared(own))
    fields = ["company_name", "website", "email", "phone"]
    assert sorted(map(tuple, got.select(fields).collect())) == sorted(map(tuple, wanted.select(fields).collect()))


@pytest.mark.parametrize("step", [
    rec.clean_records, rec.clean_records_basic, rec.quality_filter, rec.normalize_records, rec.rename_long_names,
    enrich.enrich_company, enrich.enrich_text_only, enrich.enrich_location, leads.prepared,
])
def test_record_steps_stay_in_the_engine(spark, step):
    plan = step(five(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_scan_reads_only_what_is_asked(spark):
    df = serve.search_records(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_type"), "", {"p_type": "ECONOMY"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,ECONOMY)]" in plan and "p_name" not in plan


def test_no_duplicate_work_list(spark):
    from leadloom.operators import params

    items = params.work_items(spark.createDataFrame([("q",)], "query string"), ["website", "google", "discovery"])
    assert [(r["platform"], r["phase"]) for r in items.orderBy("phase").collect()] == [
        ("discovery", 0), ("google", 1), ("website", 2)]
    assert params.request_sources(["nope"]) == fixed.DEFAULT_SOURCES
