import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from retailstream.session import local_session

    session = local_session("4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return FOLDER


def rows(frame, *columns):
    """Rows as sorted plain tuples."""
    selected = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in selected.collect()), key=repr)
