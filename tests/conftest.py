import pytest


@pytest.fixture(scope="session")
def spark():
    from tessella.session import get_spark

    return get_spark(master="local[4]", shuffle_partitions=4)
