from __future__ import annotations

import pytest

from murmura.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
