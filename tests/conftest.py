import pytest

from loomshed.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
