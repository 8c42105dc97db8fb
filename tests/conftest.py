import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def normal(pdf):
    """Rows of a pandas frame as sorted tuples, columns by name, nulls and numbers alike whatever their types."""

    def cell(x):
        if pd.isna(x):
            return "~"
        return repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)]
    pdf = pdf.astype({c: float for c in pdf.columns if str(pdf[c].dtype) == "Int64"})
    whole = {c for c in pdf.columns if str(pdf[c].dtype).startswith("float") and (pdf[c].dropna() % 1 == 0).all()}
    return sorted(tuple(cell(float(x)) if c in whole and not pd.isna(x) else cell(x) for c, x in zip(pdf.columns, r, strict=True)) for r in pdf.itertuples(index=False))


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    for c in left.columns:  # whole numbers compare alike as integers and as floats with nulls
        if any(str(x[c].dtype).lower().startswith(("int", "float")) for x in (left, right)):
            left[c], right[c] = left[c].astype("Float64").astype(float), right[c].astype("Float64").astype(float)
    assert normal(left) == normal(right)
