import pytest

from quern.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    here = tmp_path_factory.mktemp("spark")
    session = get_spark("tests", cpus=8, **{"spark.sql.warehouse.dir": f"{here}/warehouse", "spark.checkpoint.dir": f"file://{here}/checkpoints"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
