import pytest

from docloom.session import local_session, ship_code


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    ship_code(session)
    yield session
    session.stop()
