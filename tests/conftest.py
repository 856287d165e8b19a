from __future__ import annotations

import pytest

from tabloom.session import local_session, tune


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    tune(session)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
