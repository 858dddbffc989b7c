import pytest

from courtside.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", **{
        "spark__master": "local[4]", "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate columns on one row."""

    def evaluate(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    return evaluate
