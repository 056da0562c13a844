import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, 4, "4g", **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    yield session
    session.stop()
