import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def comparable(rows):
    def one(v):
        return repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, small, duck):
    """Whether a query's rows are those of its SQL."""

    def check(f, sql):
        df = f(spark, small)
        got = duck.execute(sql)
        names = [x[0] for x in got.description]
        assert set(names) == set(df.columns)
        want = comparable(got.fetchall())
        assert comparable(tuple(r[n] for n in names) for r in df.collect()) == want

    return check
