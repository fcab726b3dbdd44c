import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from side_by_side import session

    return session()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate an expression over one text value."""
    from pyspark.sql import functions as F

    def run(expression, text, **others):
        row = {"x": text, **others}
        schema = ", ".join(f"{k} string" for k in row)
        return spark.createDataFrame([tuple(row.values())], schema).select(expression(F.col("x")).alias("y")).first()["y"]

    return run
