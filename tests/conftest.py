import pytest

from reachlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


@pytest.fixture
def hot(spark):
    """Treat keys with more than a few rows as hot, to run the paths meant for skewed data."""
    spark.conf.set("reachlake.hot.rows", "5")
    yield
    spark.conf.unset("reachlake.hot.rows")


def rows(df):
    return sorted(tuple(r) for r in df.collect())
