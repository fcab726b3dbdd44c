"""Orders, keys and batches that repeat: nothing is lost, doubled or merged because of it."""

import random

from leadloom.operators import enrich, resolve
from leadloom.schema import as_records
from leadloom.sources import buckets, readers, sinks
from leadloom.streaming import flows
from pyspark.sql import functions as F


def records(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = ", ".join(f"{n} {'long' if n == 'ord' else 'string'}" for n in names)
    return as_records(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds))


def test_records_with_one_order_are_not_merged(spark):
    rows = [{"ord": 10000, "company_name": "Zeta Pumps", "website": "http://zeta.in/"},
            {"ord": 10000, "company_name": "Quartz Mills", "website": "http://quartzmills.in/"}]
    got = {(r["company_name"], r["website"]) for r in resolve.dedupe(records(spark, rows)).collect()}
    assert got == {("Zeta Pumps", "http://zeta.in/"), ("Quartz Mills", "http://quartzmills.in/")}


def test_orders_of_all_sources_differ(spark):
    pages = spark.createDataFrame([
        (i, "q", f"http://s{i}.in/", source, f"<title>Site {i}</title><p>Welcome to Site {i} Works Ltd</p>")
        for source in ("website", "direct_website") for i in range(1, 4)
    ], "page_id long, query string, url string, source string, html string")
    got = readers.records_of_all(pages, ["website", "direct_website"]).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r["source"] for r in got] == ["website"] * 3 + ["direct_website"] * 3


def test_info_texts_of_any_length_stay(spark):
    a, b = "a" * 1_200_000, "b" * 1_200_000
    rows = [{"ord": 1, "company_name": "Acme", "additional_info": a}, {"ord": 2, "company_name": "Acme", "additional_info": b}]
    row = sinks.to_output_schema(resolve.dedupe(records(spark, rows))).first()
    assert row["Additional_Information"] == f"{a} | {b}"


def test_repeated_lookup_keys_keep_one_record(spark):
    one = records(spark, [{"ord": 1, "company_name": "Acme Pumps"}])
    panel = spark.createDataFrame([("acme pumps", 2, "late"), ("acme pumps", 1, "early")], "name_key string, ord long, turnover string")
    panel = panel.withColumn("name_key", enrich.lookup_key(F.lit("Acme Pumps")))
    assert [r["turnover"] for r in enrich.enrich_lookup(one, enrich.Lookups(panel=panel)).collect()] == ["early"]
    extra = panel.select(F.lit("Acme Pumps").alias("company_name"), "ord", "turnover")
    assert [r["turnover"] for r in enrich.merge_fill(one, extra, "company_name").collect()] == ["early"]


def test_upsert_leaves_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "z", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "k long, v string, at long")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert_by_key(base, new, ["k"], ["at"]).collect()) == [(1, "b"), (2, "z")]


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = tmp_path / "table"
    batch = [records(spark, [{"ord": n, "company_name": "Acme", "additional_info": f"note {n}"}]) for n in range(2)]
    for n in (0, 1):
        flows.merge_into_table(batch[n], str(path), n)
    before = _files(path)
    for n in (1, 0):  # batch 1 comes again as if its run had been lost after the write
        flows.merge_into_table(batch[n], str(path), n)
    assert _files(path) == before
    assert [r["additional_info"] for r in buckets.read_table(spark, str(path)).collect()] == ["note 0 | note 1"]


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    path = tmp_path / "jobs"
    rows = spark.createDataFrame([(i if i else None, "old") for i in range(500)], "id long, state string")
    sinks.upsert_table(rows, str(path), ["id"], batch=0)
    before = _files(path)
    sinks.upsert_table(rows.filter("id in (3, 4)").withColumn("state", F.lit("new")), str(path), ["id"], batch=1)
    after = _files(path)
    wanted = {r[0] for r in rows.filter("id in (3, 4)").select(buckets.bucket_of(["id"])).collect()}
    touched = {name.split("=")[1].split("/")[0] for name in before.keys() ^ after.keys()}
    assert touched == {str(b) for b in wanted} and all(after[f] == before[f] for f in before.keys() & after.keys())
    got = buckets.read_table(spark, str(path)).groupBy("state").count().collect()
    assert sorted(map(tuple, got)) == [("new", 2), ("old", 498)]
    # half of a batch was written before its run was lost: the other half is finished, the first is left alone
    both = rows.filter("id in (3, 7)").withColumn("state", F.lit("half"))
    first, second = (rows.filter(f"id = {i}").select(buckets.bucket_of(["id"])).first()[0] for i in (3, 7))
    assert first != second
    sinks.upsert_table(both.filter("id = 3"), str(path), ["id"], batch=2)
    before = _files(path)
    sinks.upsert_table(both.withColumn("state", F.lit("again")), str(path), ["id"], batch=2)
    touched = {name.split("=")[1].split("/")[0] for name in before.keys() ^ _files(path).keys()}
    assert touched == {str(second)}
    states = {r["id"]: r["state"] for r in buckets.read_table(spark, str(path)).filter("id in (3, 4, 7)").collect()}
    assert states == {3: "half", 4: "new", 7: "again"}


def test_cleared_tables_leave_no_rows_on_disk(spark, tmp_path):
    path = tmp_path / "jobs"
    assert buckets.read_table(spark, str(path)) is None and sinks.clear_jobs(spark, str(path)) is None
    rows = spark.createDataFrame([(i, "x") for i in range(50)], "id long, state string")
    sinks.upsert_table(rows, str(path), ["id"])
    empty = sinks.clear_jobs(spark, str(path))
    assert empty.count() == 0 and empty.columns == ["id", "state"] and not _files(path)
    sinks.upsert_table(rows, str(path), ["id"])
    assert buckets.read_table(spark, str(path)).count() == 50
    buckets.replace_table(buckets.read_table(spark, str(path)).filter("id < 5"), str(path), ["id"])
    assert buckets.read_table(spark, str(path)).count() == 5


def test_name_parts_against_brute_force(spark):
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 9))).strip() or "a" for _ in range(150)})
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = sorted((r["left_name"], r["right_name"]) for r in resolve.contained_names(nodes).collect())
    assert got == sorted((x, y) for x in names for y in names if x != y and x in y)


def test_a_hot_key_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        rows = spark.range(0, 100_000, 1, 8).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.expr("string(id % 500)")).alias("k"))
        links = resolve.star_links(rows, F.col("k"), "id", "x")
        found = links.collect()
        assert "skew=true" in links._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    groups = {}
    for i in range(100_000):
        groups.setdefault("hot" if i % 10 < 9 else str(i % 500), []).append(i)
    assert sorted((r["left_id"], r["right_id"]) for r in found) == sorted((g[0], i) for g in groups.values() for i in g[1:])
