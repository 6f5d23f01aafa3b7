"""Every registered candle query against its oracle SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
KNOWN, ORACLE = __spark_entry__.queries(), __spark_entry__._candles()[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    def text(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x):.4f}"
        return str(x)

    return Counter(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    mine = KNOWN[name](spark, SF).toPandas()
    theirs = con.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


def test_whole_vectors(spark):
    assert KNOWN["ensemble_mean"](spark, SF).count() == 64
    assert {r.n for r in KNOWN["bsq_tokens"](spark, SF).groupBy("vec_id").agg({"g": "count"}).toDF("vec_id", "n").collect()} == {4}


def test_whole_draws():
    assert "range(0, 10000) a(draw)" in ORACLE["bootstrap_intervals"] and "range(0, 10000) a(draw)" in ORACLE["decisions"]
