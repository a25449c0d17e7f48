import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.streaming.stateStore.stateSchemaCheck", "false").config("spark.sql.streaming.noDataMicroBatches.enabled", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


def _cell(v):
    import pandas as pd

    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([str(x) for x in v])
    return f"{float(v):.8g}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)


def normal(pdf):
    """Columns by name, values as text, rows in order."""
    d = pdf[sorted(pdf.columns)].copy()
    for c in d.columns:
        d[c] = d[c].map(_cell)
    return d.sort_values(list(d.columns)).reset_index(drop=True)
