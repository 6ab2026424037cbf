import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def as_rows(rows):
    f = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(repr(tuple(f(x) for x in r)) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows of a query over the views, or over other tables given by name."""

    def check(df, sql, **tables):
        c = duck
        if tables:
            import duckdb

            c = duckdb.connect()
            for name, arrow in tables.items():
                c.register(name, arrow)
        columns = sorted(df.columns)
        want = c.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert as_rows(tuple(r) for r in df.select(*columns).collect()) == as_rows(want)

    return check
