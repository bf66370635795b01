import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from slink.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=8, partitions=4, app="slink-tests", shared=tmp_path_factory.mktemp("shared").as_uri())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
