import pytest

from wayfare.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4"})
