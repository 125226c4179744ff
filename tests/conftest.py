import pytest

from lectern.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "lectern-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture
def rows():
    """Rows of a DataFrame as a set of tuples, or a list where repeats matter."""

    def read(df, *columns, repeats=False):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=repr) if repeats else set(got)

    return read
