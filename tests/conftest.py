import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()
