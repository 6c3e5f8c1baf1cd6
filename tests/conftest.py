import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v != v:
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_rows(frame, relation) -> None:
    """The two results hold the same rows under the same column names."""
    a, b = frame.toPandas(), relation.df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = [sorted(tuple(map(_plain, r)) for r in x[cols].astype(object).itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]
