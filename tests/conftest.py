import os

import pytest

os.environ.setdefault("SIEVELAKE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievelake.session import build_session

    session = build_session(2, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
