import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return lambda q: con.execute(q).df()


def same(left, right):
    """Whether two pandas tables hold the same rows in any order."""
    def rows(t):
        cols = sorted(t.columns)
        return cols, sorted(tuple(None if v != v else (v.tolist() if hasattr(v, "tolist") else v) for v in r) for r in t[cols].itertuples(index=False)) if len(t) else []

    (a, x), (b, y) = rows(left), rows(right)
    return a == b and list(map(str, x)) == list(map(str, y))
