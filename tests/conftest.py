import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session
    from tidemark.streaming import enable_state_store

    session = local_session(cpus=8, shuffle_partitions=2, **{"spark.default.parallelism": "2"})
    enable_state_store(session)
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    from tidemark.sources.tables import Store

    return Store(spark, str(tmp_path / "tables"))
