import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(spark_df, sql, sf_dir):
    """Whether a query and its SQL give the same rows, floats to nine digits."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    r = con.sql(sql)
    columns = sorted(spark_df.columns)
    assert columns == sorted(r.columns)

    def norm(v):
        if isinstance(v, float):
            return None if v != v else float("%.9g" % v)
        return float("%.9g" % v) if hasattr(v, "as_tuple") else v

    at = [r.columns.index(c) for c in columns]
    left = sorted((tuple(norm(x[c]) for c in columns) for x in spark_df.collect()), key=str)
    right = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert left == right
