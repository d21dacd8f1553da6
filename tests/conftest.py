import pytest

from meterline.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="meterline-tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
           "spark.sql.maxMetadataStringLength": "2000",  # plans that tests read are not cut
           "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
