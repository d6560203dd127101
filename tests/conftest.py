import pytest

from threadloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=2, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
