"""Record views that Spark derives from the given tables; ``sqltext`` states the same views for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import contacts, text as t
from leadloom.schema import as_records, record
from leadloom.session import spread

# wording given to customer and supplier rows by key, so that addresses, facts and contacts have something to find:
# prefix, phone, address, description, info
PHRASES = [
    ("Acme", "+91 98765 12345", "12 MG Road, Bengaluru, Karnataka 560001",
     "Manufacturer of industrial pumps with over 250 employees and an annual turnover: Rs. 12.5 crore across 8 branches.",
     "Runs SAP for finance. GSTIN 29ABCDE1234F1Z5"),
    ("Blue Star", "022-27541234", "Plot 7, Andheri East, Mumbai 400069",
     "Software company and consulting house, team of 45, operates in 3 cities and serves retail clients.",
     "CEO: Ravi Kumar | uses Tally ERP"),
    ("Cobalt", "(415) 555-2671", "500 Market Street, San Francisco, California 94105",
     "Logistics and warehouse operator headquartered in Chicago, revenue 40 million, employs over 1,200 staff.",
     "Oracle Fusion in use"),
    ("Delta", "+44 20 7946 0958", "221B Baker Street, London NW1 6XE, UK",
     "Healthcare services group based in Leeds, with hospital and pharma units and 90 professionals.", ""),
    ("Everest", "98765", "Salt Lake, Kolkata, West Bengal",
     "Food and bakery brand, biscuits and snacks; workforce of over 600 people in 12 stores.",
     "Managing Director: Anita Sharma"),
    ("Falcon", "1111111111", "King Street, Toronto, Ontario",
     "Furniture and interior design studio located in pune, it is a small team.", "busy season contact"),
    ("Granite", "919812345678", "",
     "Real estate and construction company from jaipur rajasthan with 15 offices.", "Founder: Vikram Singh"),
    ("Helio", "", "Tech Village, Whitefield", "Short text.", "Dynamics 365 rollout"),
    ("Indigo", "09812345678", "Sonipat, Haryana",
     "Textiles and garments exporter, fabric and yarn, turnover of 90 lakh, uses Odoo.", "Odoo partner | Zoho Books"),
    ("Jasmine", "+1 212 555 0187", "350 Fifth Avenue, New York, NY 10118",
     "Finance and insurance advisory, lorem ipsum placeholder text that should be dropped.", ""),
    ("Kestrel", "9812345670", "Lakeside - Shimla - Himachal Pradesh - 171001",
     "Organic seeds and farming supplies for agriculture, 20 member team.", "MARG ERP and netsuite"),
]
_FIELDS = "slot int, prefix string, phone string, address string, description string, info string"


TEXT_TABLES = {"pages", "documents", "conversations"}  # much work per row


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def page_records(spark: SparkSession, sf: str) -> DataFrame:
    """One raw record per page: title, address, contacts, host and text."""
    text, url = F.col("_text"), F.col("url")
    own = pages(spark, sf).select("page_id", "url", t.page_title(F.col("html")).alias("_title"),
                                  t.squeeze(t.page_text(F.col("html"))).alias("_text"))
    return own.select(*record(
        ord=F.col("page_id"), company_name=F.col("_title"), website=url, email=contacts.best_email(text),
        phone=contacts.best_phone(text), description=text, source=t.url_host(url),
        additional_info=F.concat(F.lit("web profile: "), url),
    ))


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *p) for n, p in enumerate(PHRASES)], _FIELDS)


def entity_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers as raw records, worded by key; nation as country."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("country"))
    customers = table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("ord"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"),
        F.col("c_mktsegment").alias("industry"), F.lit("customers").alias("source"))
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("ord"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nk"),
        F.lit("").alias("industry"), F.lit("suppliers").alias("source"))
    both = spread(customers.unionByName(suppliers), rows=True).join(F.broadcast(nation), "nk")
    worded = both.withColumn("slot", F.pmod("k", F.lit(len(PHRASES))).cast("int")).join(
        F.broadcast(phrases(spark)), "slot")
    tail = F.when(F.col("industry") == "", "Supply House").otherwise(F.concat(F.initcap("industry"), F.lit(" Works")))
    host = F.lower(F.replace("prefix", F.lit(" "), F.lit("")))
    group = F.pmod("k", F.lit(37)).cast("string")
    return as_records(worded.select(
        "ord", F.concat_ws(" ", "prefix", tail).alias("company_name"),
        F.concat(F.lit("http://www."), host, group, F.lit(".co.in/")).alias("website"),
        F.concat(F.lit("Sales"), group, F.lit("@"), host, F.lit(".co.in")).alias("email"),
        "phone", "address", "industry", "description", F.col("info").alias("additional_info"), "source",
        F.when(F.pmod("k", F.lit(5)) == 0, F.col("country")).otherwise("").alias("country"),
    ))
