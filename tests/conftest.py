import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from msgsift.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="msgsift-test-ckpt-")
    s = local_session(4, 8, checkpoint_dir=ckpt)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="msgsift-test-")
