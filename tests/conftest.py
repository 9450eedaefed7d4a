"""One small local session for all tests."""

import pytest

from corpusmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "corpusmill-tests", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
