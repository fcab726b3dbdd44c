"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python tests/side_by_side.py [sf] [name ...]
"""

from __future__ import annotations

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, job, sql: str | None):
    """(ok, message) for one query."""
    start = time.time()
    df = job(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no sql, {spent:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    duck_spent = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} / {len(want)} rows\n   spark {str(only_got)[:700]}\n   duck  {str(only_want)[:700]}"
    return True, f"{len(got)} rows equal, {spent:.1f}s, duck {duck_spent:.1f}s"


def session():
    from pyspark.sql import SparkSession

    from leadloom.session import RECOMMENDED_CONF

    settings = {**RECOMMENDED_CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, sql = session(), duck(sf_dir), entry.oracle_sql()
    bad = 0
    for name, job in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, message = compare(spark, con, sf_dir, job, sql.get(name))
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:500]}"
        bad += not ok
        print("ok " if ok else "BAD", name, message, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
