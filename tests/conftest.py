import pytest

from plumbline.session import local_session
from plumbline.sources.local import local_frame


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A small DataFrame from rows and a schema."""
    return lambda rows, ddl: local_frame(spark, rows, ddl)


def spec(rule_type, **kwargs):
    return {"type": f"expect_{rule_type}", "kwargs": kwargs}
