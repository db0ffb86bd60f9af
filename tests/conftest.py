import pytest

from rasterloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
