import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetscope.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)  # unset in tests: a local one is created
    yield s
    s.stop()


@pytest.fixture()
def tmp_path_str():
    return tempfile.mkdtemp(prefix="fleetscope-test-")
