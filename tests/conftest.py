import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import ensure_checkpoint_dir, get_spark
    s = get_spark("quarry-tests", master="local[4]", shuffle_partitions=4,
                  extra={"spark.ui.enabled": "false"})
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="quarry-test-")
