import pytest

from jobweft.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.maxMetadataStringLength": "10000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
