import pytest

from apidrift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as a sorted list of tuples in the given column order."""

    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    return collect
