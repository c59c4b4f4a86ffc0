import pytest

from lumigraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.enabled", "true")
    return s
