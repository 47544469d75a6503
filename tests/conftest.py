import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldwright.session import local_session, scratch_run  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A session with a shared folder of its own, in which the tests leave nothing."""
    session, shared = local_session("*", 8), tmp_path_factory.mktemp("shared")
    session.sparkContext.setCheckpointDir(str(shared))
    with scratch_run(session, "tests"):
        yield session
    assert not glob.glob(f"{shared}/*/foldwright/*")
