"""Lookups over several company tables: values against a plain loop, and the joins they cost."""

import random

from pyspark.sql import functions as F

from leadloom.operators import enrich
from leadloom.schema import as_records

NUMBER = "27ABCDE1234F1Z5"
FIELDS = ["contact_name", "turnover", "employee_count", "industry_type", "city", "additional_info", "erp_software"]
TABLES = ["directory1", "directory2", "panel", "encyclopedia", "directors"]


def records(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = ", ".join(f"{n} {'long' if n == 'ord' else 'string'}" for n in names)
    return as_records(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds))


def brute(record, tables, gst, erp):
    own, key = dict(record), record["company_name"].lower()
    if len(own["company_name"]) < 3:
        return own

    def fill(row, info):
        for f in FIELDS:
            if f == "additional_info" and info:
                own[f] = " | ".join(x for x in (own[f], row.get(f)) if x)
            elif own[f] == "":
                own[f] = row.get(f) or ""

    for name in TABLES:
        if name == "panel" and NUMBER in own["additional_info"] and gst:
            fill(gst, True)
        lacks = {"directory1": "contact_name turnover", "directory2": "contact_name turnover", "directors": "contact_name",
                 "encyclopedia": "contact_name turnover employee_count industry_type"}.get(name)
        if key in tables[name] and (lacks is None or any(own[f] == "" for f in lacks.split())):
            fill(tables[name][key], name.startswith("directory"))
    if own["erp_software"] == "":
        own["erp_software"] = erp.get(key, "")
    return own


def frames(spark, tables, gst, erp):
    made = {n: spark.createDataFrame([(key, *[row.get(f) for f in FIELDS]) for key, row in rows.items()],
                                     ", ".join(f"{c} string" for c in ["name_key", *FIELDS])) for n, rows in tables.items()}
    made["gst"] = spark.createDataFrame([(NUMBER, *[gst.get(f) for f in FIELDS])], ", ".join(f"{c} string" for c in ["gstin", *FIELDS]))
    made["erp"] = spark.createDataFrame(list(erp.items()), "name_key string, erp_software string")
    keyed = {n: t.withColumn("name_key", enrich.lookup_key(F.col("name_key"))) if "name_key" in t.columns else t for n, t in made.items()}
    return enrich.Lookups(**keyed)


def test_seven_tables_equal_a_plain_loop(spark):
    chance = random.Random(5)
    names = [f"company {i:02d}" for i in range(40)]

    def some(text):
        return chance.choice([None, "", text, text])

    tables = {n: {k: {f: some(f"{n} {f}") for f in FIELDS if f not in ("erp_software", "additional_info")}
                  | {"additional_info": chance.choice([None, "", f"note of {n}", f"number {NUMBER}"])}
                  for k in names if chance.random() < 0.7} for n in TABLES}
    gst = {"city": "Pune", "additional_info": "registered", "turnover": "from registry"}
    erp = {k: "SAP" for k in names if chance.random() < 0.5}
    rows = [{"ord": i, "company_name": chance.choice([*names, "ab", ""]),
             **{f: chance.choice(["", "", f"own {f}"]) for f in FIELDS}} for i in range(300)]
    got = {r["ord"]: r.asDict() for r in enrich.enrich_lookup(records(spark, rows), frames(spark, tables, gst, erp)).collect()}
    assert len(got) == len(rows)
    for row in rows:
        want = brute(row, tables, gst, erp)
        assert {f: got[row["ord"]][f] for f in FIELDS} == {f: want[f] for f in FIELDS}, row


def test_two_joins_and_no_added_columns(spark):
    row = {"ord": 1, "company_name": "Acme Pumps"}
    tables = {n: {"acme pumps": {"contact_name": "A"}} for n in TABLES}
    own = records(spark, [row])
    out = enrich.enrich_lookup(own, frames(spark, tables, {"city": "Pune"}, {"acme pumps": "SAP"}))
    assert out.columns == own.columns
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("Join ") == 2


def test_empty_keys_of_tables_match_nothing(spark):
    own = records(spark, [{"ord": 1, "company_name": "---"}, {"ord": 2, "company_name": "Acme Pumps"}])
    panel = spark.createDataFrame([("", "none"), (None, "none")], "name_key string, turnover string")
    assert {r["turnover"] for r in enrich.enrich_lookup(own, enrich.Lookups(panel=panel)).collect()} == {""}
