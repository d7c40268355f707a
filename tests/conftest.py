import tempfile

import pytest

from linkloom.runtime import session


@pytest.fixture(scope="session")
def spark():
    made = session("linkloom-tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="linkloom-tests-"))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def rows_of():
    return lambda df, *columns: sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
