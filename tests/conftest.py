import pytest

from siltworks.session import build_session, ensure_checkpoint_dir


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
