import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leafmill.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build
